"""The pipeline: each stage against a brute-force version of it, on a small corpus with planted cases."""

import collections
import random
import re

import pytest

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"v{r.randrange(6000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    lines = ["\n".join(prose(1000 * i + k, 30) for k in range(6)) for i in range(40)]
    words = lines[1].split()
    passage = "\n".join(prose(90_000 + k, 20) for k in range(12))
    texts = [
        *lines, lines[0], " ".join([*words[:90], "new", *words[91:]]), "too short", "", None, "word " * 200, prose(7, 60) + " " + prose(555, 30) + " " + prose(8, 60),
        lines[2] + "\n" + passage, lines[3].replace("v", "u") + "\n" + passage,
    ]
    rows = [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)] + [(None, prose(77, 80), None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, prose(555, 30)), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        seen[name] = before, {r.doc_id: r["text"] if "text" in r else r for r in rows}

    before, after = seen["quality_rules"]  # nothing can be certified from 40 labels, so the base rule alone rejects
    for i, text in before.items():
        w = WORD.findall(text or "")
        grams = list(zip(w, w[1:], w[2:], strict=False))
        counts = collections.Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(3)}
        assert (i in after) == (len(w) >= 50 and 100 * len(covered) <= 50 * len(w))
    assert None in after

    before, after = seen["line_dedup"]
    assert 40 in before and not set(after.get(40, "").split("\n")) & set(prose(0, 30))
    assert sum(prose(90_000 + 5, 20) in (t or "") for t in before.values()) == 2
    assert sum(prose(90_000 + 5, 20) in (t or "") for t in after.values()) == 1
    clean = set(range(4, 40))
    assert all(after[i] == before[i] for i in clean)

    before, after = seen["near_duplicates"]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in before.items()}
    for i in before:
        twins = [j for j in before if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        if not twins:
            assert i in after
        else:
            assert (i in after) == (i == min([i, *twins]))
    assert clean <= set(after)

    before, after = seen["decontamination"]
    assert set(before) - set(after) == {46}

    before, after = seen["packing"]
    assert set(after) == set(before)
    assert all(r.n_tokens == len(WORD.findall(before[i])) <= r.bucket_length for i, r in after.items())


def test_run_gives_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "bucket", "bucket_length", "batch", "position"]


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
    assert docs.count() == 0
