"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the longest phrases that
occur in the automaton's text; the fewer phrases, normalised by length, the closer the language. The automaton's
transitions are a table over a small alphabet, in which a failing transition goes on from the root and counts a phrase,
so thousands of text pieces take one step together.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the training sample: rows and characters of each language; languages; characters told apart.
ROWS, CHARACTERS, LANGUAGES, ALPHABET = 400, 24_000, 64, 72
#: Texts are parsed in pieces of so many characters, each from the root.
PIECE = 512
_built: dict[str, tuple] = {}


def training_sample(labelled: DataFrame, lang: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict[str, str]:
    """For each language a text of at most `CHARACTERS`, from at most `ROWS` rows: whole texts in hash order, as long as
    they fit. A bounded model input: the choice looks at ids and sizes first, then reads the chosen texts only."""
    key = F.xxhash64(F.lit("language"), id_col, text_col)
    fits = labelled.where(F.col(lang).isNotNull() & F.length(text_col).between(40, CHARACTERS // 3)).select(F.col(lang).alias("lang"), key.alias("k"), F.length(text_col).alias("n"))
    sizes = {r["lang"]: r["count"] for r in fits.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages don't fit the model")
    # hashes are even, so a share of them gives each language about twice the rows wanted, whatever its size
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, min(1.0, 2 * ROWS / n)).otherwise(share)
    drawn = fits.where(F.col("k").cast("double") / 2.0**64 + 0.5 <= share).distinct().collect()  # copies of a row share its hash
    room, taken = {name: CHARACTERS for name in sizes}, dict.fromkeys(sizes, 0)
    chosen = []
    for row in sorted(drawn, key=lambda r: (r["lang"], r["k"])):
        if taken[row["lang"]] < ROWS and row["n"] + 1 <= room[row["lang"]]:
            room[row["lang"]] -= row["n"] + 1
            taken[row["lang"]] += 1
            chosen.append(row["k"])
    if not chosen:
        return {}
    # bounded by ROWS for each language, so small enough to be sent to all executors
    picked = F.broadcast(labelled.sparkSession.createDataFrame([(k,) for k in chosen], "k bigint"))
    rows = labelled.withColumn("k", key).join(picked, "k", "left_semi").select(F.col(lang).alias("lang"), "k", F.col(text_col).alias("text")).distinct().collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["k"])):
        texts.setdefault(row["lang"], []).append(row["text"])
    return {name: "\n".join(parts) for name, parts in texts.items()}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of a sequence; state 0 is the root."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return moves


def _model(name: str, texts: dict[str, str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, code of each character, the joint table, each root; built once in a Python worker.

    An entry of the table is twice the next state, plus one if a phrase ends before the character.
    """
    if name in _built:
        return _built[name]
    languages = sorted(texts)
    lowered = {lang: texts[lang].lower() for lang in languages}
    everything = np.frombuffer("".join(lowered.values()).encode("utf-32-le"), np.uint32)
    points, counts = np.unique(everything, return_counts=True)
    common = sorted(points[np.argsort(-counts, kind="stable")][: ALPHABET - 1].tolist())
    code = np.full(0x110001, ALPHABET - 1, np.uint8)
    code[common] = np.arange(len(common))
    tables, roots, start = [], [], 0
    for lang in languages:
        moves = suffix_automaton(code[np.frombuffer(lowered[lang].encode("utf-32-le"), np.uint32)].tolist())
        root = np.zeros(ALPHABET, np.int64)
        for c, to in moves[0].items():
            root[c] = start + to
        root[root == 0] = start
        part = np.tile((2 * root + 1).astype(np.int32), (len(moves), 1))
        for state, row in enumerate(moves):
            if row:
                part[state, list(row)] = 2 * (start + np.fromiter(row.values(), np.int64, len(row)))
        tables.append(part)
        roots.append(start)
        start += len(moves)
    _built.clear()
    _built[name] = languages, code, np.concatenate(tables) if tables else np.zeros((1, ALPHABET), np.int32), np.array(roots, np.int64)
    return _built[name]


def phrases(texts: list[str], code: np.ndarray, table: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns)."""
    out = np.zeros((len(texts), len(roots)), np.int64)
    pieces, owner = [], []
    for i, text in enumerate(texts):
        codes = code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        for at in range(0, len(codes), PIECE):
            pieces.append(codes[at : at + PIECE])
            owner.append(i)
    flat = table.reshape(-1)
    order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k]))
    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        sizes = np.array([len(pieces[k]) for k in part])
        grid = np.full((int(sizes[0]), len(part)), 0, np.uint8)
        for column, k in enumerate(part):
            grid[: sizes[column], column] = pieces[k]
        alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        whose = np.array([owner[k] for k in part])
        for lang, root in enumerate(roots):
            state = np.full(len(part), root, np.int64)
            count = np.ones(len(part), np.int64)
            for step in range(int(sizes[0])):
                n = alive[step]
                move = flat[state[:n] * ALPHABET + grid[step, :n]]
                count[:n] += move & 1
                state[:n] = move >> 1
            np.add.at(out[:, lang], whose, count)
    return out


def identify(docs: DataFrame, texts: dict[str, str], text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`carry`, ``lang_pred``, ``score`` (0 to 1: how far the second best is behind) and ``n_phrases``.

    `texts` is the training text of each language. The fewest phrases, divided by the mean phrase length to be expected
    of that much training text (its logarithm), win; ties go to the first language by name. A text that is null or has
    no letter, and any text without a model, is ``und`` with score 0. Texts are read whole, row by row.
    """
    name = hashlib.sha1(json.dumps(texts, sort_keys=True).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(texts)
    schema = T.StructType([*docs.select(*carry).schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_phrases", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, code, table, roots = _model(name, sent.value)
        scale = np.array([np.log(max(2, len(sent.value[lang]))) for lang in languages])
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                column = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                known = np.array([bool(languages) and any(map(str.isalpha, t)) for t in column], bool)
                counts = np.zeros((len(column), max(1, len(languages))), np.int64)
                if known.any():
                    counts[known] = phrases([t for t, ok in zip(column, known, strict=True) if ok], code, table, roots)
                cost = counts * scale if len(languages) else counts
                best = np.argmin(cost, axis=1)
                ranked = np.sort(cost, axis=1)
                second = ranked[:, 1] if cost.shape[1] > 1 else np.full(len(column), np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(known, np.clip(1 - ranked[:, 0] / np.maximum(second, 1e-9), 0, 1), 0.0)
                said = [languages[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
                made = [pa.array(said), pa.array(score), pa.array(np.where(known, counts[np.arange(len(column)), best], 0))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[f.name for f in schema])

    return docs.select(*carry, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: CRC-32 of the id's text modulo 3 is 1 (never for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
