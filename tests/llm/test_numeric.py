"""Whitening, token files and spelling variants against brute-force versions, and on odd tables."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacantia.llm import tokenfile, variants, whitening

# 11 whitening


def vectors_of(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<float>")


def check_whitening(vectors, got, most):
    """Against numpy's eigenvectors of the covariance over the distinct integer vectors."""
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000 for i, v in enumerate(vectors)}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, s = len(fit), fit.sum(axis=0)
    cov = np.cov((fit - 1_000_000).T.astype(float), bias=True)
    e, u = np.linalg.eigh(cov)
    rows = collections.defaultdict(dict)
    for r in got:
        rows[r.component][r.vec_id] = r
    assert len(rows) == min(most, int((e > 1e-9 * e.max()).sum()))
    for c, found in rows.items():
        assert len(found) == len(vectors)
        sign = 0
        for i, r in found.items():
            z = (n * x[i] - s) @ u[:, -c] / n / np.sqrt(e[-c])
            sign = sign or (np.sign(z * r.whitened) if abs(z) > 1e-3 else 0)
            assert r.n == n and r.deviation == int(((n * x[i] - s) ** 2).sum())
            assert abs(z * (sign or 1) - r.whitened) < 1e-6
            assert abs(r.explained / (e[-c] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 6)) * [3, 2, 1.5, 1, 0.7, 0.4]).tolist()
    vectors += vectors[:40]  # repeated rows count once in the fit
    check_whitening(vectors, whitening.whiten(vectors_of(spark, vectors).repartition(3), most=4).collect(), 4)


def test_whitening_of_deficient_rank(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(-20, 20, size=(50, 2))
    vectors = (np.column_stack([a[:, 0], a[:, 1], a[:, 0], np.full(50, 3)]) / 64).tolist()
    check_whitening(vectors, whitening.whiten(vectors_of(spark, vectors)).collect(), 16)


def test_equal_eigenvalues_get_an_orthogonal_basis(spark):
    """The corners of an octahedron: three equal eigenvalues, any basis will do."""
    vectors = [[s * (k == i) for i in range(3)] for k in range(3) for s in (1.0, -1.0)]
    got = whitening.whiten(vectors_of(spark, vectors)).collect()
    z = np.zeros((6, 3))
    for r in got:
        z[r.vec_id, r.component - 1] = r.whitened
        assert abs(r.explained - 1 / 3) < 1e-12 and r.identity_error < 1e-12
    assert np.allclose(z.T @ z / 6, np.eye(3))


def test_whitening_of_odd_vectors(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 0.0], 1), (6, [1.0, 2.0, 3.0], 1), (None, [0.5, 2.0], 1), (7, [0.25, -2.0], 1), (7, [0.25, -2.0], 1), (8, [3e30, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, x int")
    got = whitening.whiten(df, carry=("vec_id", "x")).collect()
    assert collections.Counter(r.vec_id for r in got if r.component == 1) == {None: 1, 7: 2, 8: 1}
    assert {r.deviation for r in got if r.vec_id == 8} == {None}  # beyond 63 bits
    for part in ("1 = 0", "vec_id = 7", "vec_id = 1"):  # no rows, one distinct vector, no usable vector
        assert whitening.whiten(df.where(part)).collect() == []


def test_characteristic_polynomial(spark):
    rng = random.Random(2)
    m = np.array([[rng.randrange(-9, 10) for _ in range(5)] for _ in range(5)], object)
    m = m.dot(m.T)
    poly = whitening.characteristic_polynomial(spark, m)

    def det(a):
        return a[0][0] if len(a) == 1 else sum((-1) ** j * a[0][j] * det([[*row[:j], *row[j + 1 :]] for row in a[1:]]) for j in range(len(a)))

    for t in (-3, 0, 1, 77):
        assert sum(c * t**k for k, c in enumerate(poly)) == det((t * np.eye(5, dtype=int).astype(object) - m).tolist())
    roots = np.linalg.eigvalsh(m.astype(float))[::-1]
    for rank, root in enumerate(roots, 1):
        if root > 1e-6:
            assert abs(whitening.isolate(poly, rank, 100)[0] / 2**100 / root - 1) < 1e-9


def test_repeated_and_zero_roots():
    poly = [0, -750, 1075, -590, 156, -20, 1]  # x (x-2) (x-3) (x-5)^3
    found = [whitening.isolate(poly, k, 64) for k in range(1, 7)]
    assert [(f[0] / 2**64, f[1], f[2]) for f in found[:5]] == [(5, 1, 3), (5, 1, 3), (5, 1, 3), (3, 4, 4), (2, 5, 5)]
    assert found[5] is None


# 12 token files


@pytest.fixture(scope="module")
def plain_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


TEXTS = [
    "A plain text, with words; and signs...", None, "", " ", "  two blanks  and\n\nlines \n", "don't 's'll é😀 ½ ñandú", "tab\there\x0b\x1c\x00end", "<|endoftext|> inside <|endoftext|>", "same", "same", "x" * 3000,
    "word and more " * 9000, "trailing \n", "\n \n", "a b　c", "'s", " 's ,'s.'s",
]


def test_pieces_have_the_tokens_of_whole_texts(plain_ids):
    rng = random.Random(3)
    alphabet = [*"ab ,.'\n\t 1é \x1c\x00 ", "'s", "  ", "\n\n", "<|endoftext|>", " word", "word,"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    tokens = tokenfile.Tokens(None)
    for _ in range(2):  # the second time from memory
        assert [r.tolist() for r in tokens.encode(pa.array(texts))] == [plain_ids(t) for t in texts]


def test_rare_pieces_are_forgotten(plain_ids, monkeypatch):
    monkeypatch.setattr(tokenfile, "PIECES", 40)
    tokens = tokenfile.Tokens(None)
    for k in range(30):
        texts = [f"common words here and w{k}{i}, too" for i in range(10)]
        assert [r.tolist() for r in tokens.encode(pa.array(texts))] == [plain_ids(t) for t in texts]
    assert len(tokens.place) < 80


@pytest.mark.parametrize("n", [0, 1, 17, 1000, 70_000])
def test_blocks_round_trip_and_decode_in_part(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_256).astype(np.uint32)
    table = tokenfile.Frequencies.scale(*np.unique(ids, return_counts=True))
    assert table.width.sum() == (1 << table.bits if n else 0)
    block = tokenfile.encode_block(ids, table, 4096)
    assert tokenfile.decode_block(block, table).tolist() == ids.tolist()
    for first, last in ((0, 0), (n // 3, n // 2), (n - 1, n), (n // 2, n + 5)):
        assert tokenfile.decode_block(block, table, max(first, 0), last).tolist() == ids[max(first, 0) : last].tolist()
    if n:
        damaged = bytearray(block)
        damaged[len(block) // 2] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            tokenfile.decode_block(bytes(damaged), table)


def test_many_rare_ids_keep_their_slots():
    counts = [10**12, *[1] * 60_000]
    table = tokenfile.Frequencies.scale(range(len(counts)), counts)
    assert table.width.min() == 1 and table.width.sum() == 1 << table.bits
    ids = np.array([0, 59_999, 60_000, 0, 0, 7], np.uint32)
    assert tokenfile.decode_block(tokenfile.encode_block(ids, table), table).tolist() == ids.tolist()


def test_checksums_join():
    for a, b in ((b"", b"abc"), (b"hello", b""), (b"x" * 1000, b"yz" * 777)):
        assert tokenfile.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("block", [tokenfile.BLOCK, 1000])  # small blocks: documents go on in the next ones
def test_files_in_order_of_documents(spark, plain_ids, block):
    order = random.Random(1).sample(range(len(TEXTS)), len(TEXTS))
    docs = spark.createDataFrame([(i * 7 - 20, TEXTS[i], "z") for i in order], "doc_id bigint, text string, ids string").repartition(3)
    files = tokenfile.write_ids(docs, block=block, segment=256)
    got = {r.id: r for r in tokenfile.read_documents(spark, files).collect()}
    stream = []
    for i, text in enumerate(TEXTS):
        ids = [*plain_ids(text), 0]
        r = got.pop(i * 7 - 20)
        assert (r.start, r.n_tokens, r.ids_crc32) == (len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        stream += ids
    assert not got
    assert tokenfile.read_range(spark, files, 0, 10**9).tolist() == stream
    assert tokenfile.read_range(spark, files, 1500, 4000).tolist() == stream[1500:4000]
    pieces = sorted(tokenfile.read_ids(spark, files).collect(), key=lambda r: (r.start, r.skip))
    assert [int(v) for r in pieces for v in np.frombuffer(r.ids, "<u4")] == stream


def test_files_of_odd_tables(spark, odd, plain_ids):
    got = tokenfile.read_documents(spark, tokenfile.write_ids(odd)).orderBy("start").collect()
    assert len(got) == odd.count()
    assert [r.id for r in got] == sorted((r.doc_id for r in odd.collect()), key=lambda v: (v is not None, v or 0))
    assert [b.start for b in got[1:]] == list(itertools.accumulate(r.n_tokens for r in got))[:-1]
    sizes = collections.Counter((r.doc_id, len(plain_ids(r.text)) + 1) for r in odd.collect())
    assert collections.Counter((r.id, r.n_tokens) for r in got) == sizes
    assert tokenfile.read_documents(spark, tokenfile.write_ids(odd.where("1 = 0"))).collect() == []


# 13 spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


@pytest.mark.parametrize("hot", [variants.HOT, 2])  # every chunk is taken further
def test_variants_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(variants, "HOT", hot)
    rng = random.Random(hot)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(300)} | {"", "a", "b", "ab", "ba", "prefixword", "prefixwords", "prefixwore"}
    counts = {w: rng.choice([1, 2, 5, 25, 30, 150, 700, 4000]) for w in words}
    got = variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()
    assert {tuple(r) for r in got} == brute_variants(counts)
    pairs = [tuple(sorted((r.word, r.other))) for r in variants.near_pairs(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()]
    assert len(pairs) == len(set(pairs)) == sum(one_edit(a, b) for a, b in itertools.combinations(counts, 2))


def test_words_of_texts(spark, odd):
    texts = {1: "Reading reading REÁDING, reading-readings read", 2: None, 3: "", None: "reading Ñandúes ñandúes x×y÷z", 4: "reading " * 500}
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id bigint, text string, word int")
    for every, least in ((None, 1), (3, 1), (None, 2)):
        want = collections.Counter()
        for key, text in texts.items():
            for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
                run = "".join(c.lower() if c.isascii() else c for c in run)
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                if every and h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                want[run] += len(run) >= 6
        got = {r.word: r.n for r in variants.count_words(df, min_count=least, drop_every=every).collect()}
        assert got == {w: n for w, n in want.items() if n >= least}
    assert variants.group_variants(variants.count_words(odd)).count() == 0
    assert variants.group_variants(variants.count_words(odd.where("1 = 0"))).collect() == []


def test_long_chains_end_at_the_root(spark):
    words = ["a" * (6 + k) for k in range(12)]
    counts = {w: 5**k for k, w in enumerate(words)}
    got = {r.word: r.root for r in variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()}
    assert set(got.values()) == {words[-1]}
