"""SimHash near-duplicates: fingerprints, vantage-point shards, exact pairs within a Hamming radius, groups.

A fingerprint of ``64 * n_words`` bits has a bit set if more than half the text's shingles have it set in their hash.
Equal fingerprints are joined first, so copies cost one row. A vantage-point tree fitted on a bounded sample
(`SAMPLE` fingerprints) splits the space by Hamming distance to a vantage fingerprint; a node is split only while its
triangle bound really prunes. Every fingerprint goes to its own shard, and also visits each shard that a fingerprint
within the radius could be in, so no pair is lost. Inside a shard the same tree is grown further, in memory, down to
small leaves whose pairs are compared. Shards above `SHARD` rows are compared in blocks of rows, by several tasks. A
task returns a spanning forest of the links it found, never all pairs of a group.

`representatives` takes such groups as candidates only; their texts are then compared by their shingle sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import components, written

SEED = 42
#: Fingerprints the shared part of the tree is fitted on, the rows wanted in a shard, those compared at once, and the
#: pairs compared in full at once.
SAMPLE, SHARD, LEAF, PAIRS = 8192, 16384, 192, 1 << 16
_hash = functools.partial(xxhash.xxh64_intdigest, seed=SEED)


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 of each `width`-word shingle of UTF-8 bytes, A-Z lower-cased; a shorter text is one shingle."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = [b" ".join(words)] if len(words) <= width else list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    return np.fromiter(map(_hash, grams), np.uint64, len(grams))


def _further(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """`hashes` in column 0, and in each further column a mix of them with multipliers of its own."""
    out = np.empty((len(hashes), n_words), np.uint64)
    out[:, 0] = hashes
    folded = hashes ^ (hashes >> np.uint64(29))
    for w in range(1, n_words):
        mixed = folded * np.uint64(_hash(f"a{w}") | 1)
        out[:, w] = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(_hash(f"b{w}") | 1)
    return out


def fingerprint(hashes: np.ndarray, n_words: int = 1) -> np.ndarray:
    """The majority bits of `hashes` as `n_words` 64-bit words; further words hash the hashes again."""
    counts = np.zeros(64 * n_words, np.int64)
    for at in range(0, len(hashes), 32 * 255):
        part = _further(hashes[at : at + 32 * 255], n_words)
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        # sums of at most 255 rows fit the bytes they are made of
        for row in range(0, len(bits), 255):
            counts += np.add.reduce(bits[row : row + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), width: int = 3, n_words: int = 1, distinct: bool = False) -> DataFrame:
    """`carry`, ``bits`` (array of bigint, the fingerprint's words) and ``n_shingles`` for each row.

    With `distinct`, each different shingle counts once. A null or blank text has fingerprint zero and no shingles. Texts are read whole; extra columns are not carried.
    """
    schema = docs.select(*carry).schema.add("bits", T.ArrayType(T.LongType())).add("n_shingles", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            bits, counts = np.zeros((batch.num_rows, n_words), np.int64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(texts):
                hashes = shingle_hashes(text.as_py() or b"", width)
                hashes = np.unique(hashes) if distinct else hashes
                bits[i], counts[i] = fingerprint(hashes, n_words).view(np.int64), len(hashes)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n_words)
            lists = pa.ListArray.from_arrays(ends, pa.array(bits.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(counts)], names=[f.name for f in schema])

    return docs.select(*carry, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _split(points: np.ndarray, radius: int) -> tuple[np.ndarray, int] | None:
    """A vantage point and a boundary for `points`, or None where the triangle bound would prune too little."""
    best = None
    for at in (0, len(points) // 3, 2 * len(points) // 3):
        d = _distance(points, points[at])
        mu = int(np.median(d))
        inside = d <= mu
        visits = np.count_nonzero(~inside & (d - radius <= mu)) / len(d)
        share = max(np.count_nonzero(inside), np.count_nonzero(~inside)) / len(d) + visits
        if best is None or share < best[0]:
            best = share, points[at], mu
    return best[1:] if best and best[0] < 0.9 else None


def grow_tree(points: np.ndarray, radius: int, depth: int) -> list | None:
    """A nested vantage-point tree ``[vantage words, boundary, inside, outside]``; None is a leaf."""
    if depth <= 0 or len(points) < 16 or (cut := _split(points, radius)) is None:
        return None
    vantage, mu = cut
    inside = _distance(points, vantage) <= mu
    return [vantage.tolist(), mu, grow_tree(points[inside], radius, depth - 1), grow_tree(points[~inside], radius, depth - 1)]


def _sides(d: np.ndarray, mu: int, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Who goes inside, who outside, and who is on its own side. A pair parted here meets inside if both are at home."""
    own = d <= mu
    inside = own | (d - radius <= mu)
    outside = ~own | (~home & (d + radius > mu))
    return inside, outside, own


def route(bits: np.ndarray, tree: list | None, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, rows, at home)`` for each shard that rows of `bits` belong to or visit."""
    todo = [(1, tree, np.arange(len(bits)), np.ones(len(bits), bool))]
    while todo:
        shard, node, rows, home = todo.pop()
        if not len(rows):
            continue
        if node is None:
            yield shard, rows, home
            continue
        vantage, mu, *kids = node
        inside, outside, own = _sides(_distance(bits[rows], np.array(vantage, np.uint64)), mu, home, radius)
        todo.append((2 * shard, kids[0], rows[inside], (home & own)[inside]))
        todo.append((2 * shard + 1, kids[1], rows[outside], (home & ~own)[outside]))


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the groups of `i` and `j`, in place; a root is its group's smallest member."""
    while len(i):
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        a, b = parent[i], parent[j]
        apart = a != b
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def _compare(bits: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int, ratio: float | None, parent: np.ndarray) -> None:
    """Unite every row of `x` with the rows of `y` in the radius (and with sizes in the ratio).

    The first words are compared for all pairs, so many that unlike texts already differ by more than the radius there;
    the rest only where they do not.
    """
    lead = min(bits.shape[1], int(np.ceil((2 * radius + 4 * np.sqrt(2 * radius)) / 64)))
    if ratio:
        x, y = x[np.argsort(size[x], kind="stable")], y[np.argsort(size[y], kind="stable")]
    for at in range(0, len(x), 128):
        part, other = x[at : at + 128], y
        if ratio:
            other = y[np.searchsorted(size[y], ratio * size[part[0]]) : np.searchsorted(size[y], size[part[-1]] / ratio, side="right")]
        for to in range(0, len(other), 1 << 14):
            block = other[to : to + (1 << 14)]
            near = np.zeros((len(part), len(block)), np.int16)
            for w in range(lead):
                near += np.bitwise_count(bits[part, w][:, None] ^ bits[block, w][None, :])
            i, j = np.nonzero(near <= radius)
            i, j = part[i], block[j]
            if lead < bits.shape[1] and len(i):
                close = np.concatenate([_distance(bits[i[k : k + PAIRS]], bits[j[k : k + PAIRS]]) <= radius for k in range(0, len(i), PAIRS)])
                i, j = i[close], j[close]
            if ratio:
                fits = np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j])
                i, j = i[fits], j[fits]
            _unite(parent, i, j)


def forest(bits: np.ndarray, size: np.ndarray, home: np.ndarray, other: np.ndarray, radius: int, ratio: float | None = None) -> np.ndarray:
    """For each row the root of its group, from all links between a row at home and a row among the others."""
    parent = np.arange(len(bits))
    todo = [(np.flatnonzero(home), np.flatnonzero(other), 0)]
    while todo:
        x, y, depth = todo.pop()
        if not len(x) or not len(y):
            continue
        if len(x) * len(y) > LEAF * LEAF and depth < 64 and (cut := _split(bits[x[:: max(1, len(x) // 512)]], radius)):
            dx, dy = _distance(bits[x], cut[0]), _distance(bits[y], cut[0])
            todo.append((x[dx <= cut[1]], y[dy - radius <= cut[1]], depth + 1))
            todo.append((x[dx > cut[1]], y[dy + radius > cut[1]], depth + 1))
        else:
            _compare(bits, size, x, y, radius, ratio, parent)
    _unite(parent, parent.copy(), np.arange(len(bits)))
    return parent


def links(nodes: DataFrame, radius: int, ratio: float | None = None, shard: int = SHARD) -> DataFrame:
    """Links ``(a, b)`` between the nodes ``(node, bits, n_shingles)``: a spanning forest of all links of each task.

    With `ratio`, only nodes whose shingle counts are in that ratio link; bands of counts (each visiting the next) then
    part the nodes before the tree does.
    """
    spark = nodes.sparkSession
    n_words = len((nodes.select("bits").first() or [[0]])[0])
    total = nodes.count()
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("bits").collect()], np.int64).reshape(-1, n_words).view(np.uint64)
    tree = grow_tree(sample, radius, min(9, max(0, int(np.ceil(np.log2(max(1, total) / shard))) + 2)))
    base = np.log(1 / ratio) if ratio else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_words)
            size = batch.column(2).to_numpy(zero_copy_only=False)
            for leaf, rows, home in route(words.view(np.uint64), tree, radius):
                band = np.floor(np.log(np.maximum(1, size[rows])) / base).astype(np.int64) if ratio else np.zeros(len(rows), np.int64)
                for step in (0, 1) if ratio else (0,):
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(rows), leaf, np.int64)), pa.array(band + step), pa.array(home if not step else np.zeros(len(rows), bool))], names=[*batch.schema.names, "leaf", "band", "home"])

    dealt = written(nodes.select("node", "bits", "n_shingles").mapInArrow(deal, "node bigint, bits array<bigint>, n_shingles bigint, leaf bigint, band bigint, home boolean"), "dealt")
    blocks = dealt.groupBy("leaf", "band").agg(F.ceil(F.count("*") / (2 * shard)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    row = ["node", "bits", "n_shingles", "leaf", "band"]
    cut = dealt.join(blocks, ["leaf", "band"]).withColumn("own", own)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    others = cut.select(*row, "home", F.lit(True).alias("other"), every.alias("i"), F.col("own").alias("j"), "own")
    homes = cut.where("home and blocks > 1").select(*row, "home", F.lit(False).alias("other"), F.col("own").alias("i"), every.alias("j"), "own").where("j <> own")
    tasks = others.withColumn("home", F.expr("home and i = own")).union(homes).drop("own")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.array(pdf["bits"].tolist(), np.int64).reshape(-1, n_words).view(np.uint64)
        node = pdf["node"].to_numpy()
        root = forest(bits, pdf["n_shingles"].to_numpy(), pdf["home"].to_numpy(), pdf["other"].to_numpy(), radius, ratio)
        linked = node != node[root]
        return pd.DataFrame({"a": node[linked], "b": node[root][linked]})

    return written(tasks.groupBy("leaf", "band", "i", "j").applyInPandas(compare, "a bigint, b bigint"), "pairs")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, n_words: int = 1, radius: int = 2, ratio: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """`id_col`, `carry`, ``bits``, ``n_shingles``, ``group`` and ``component_id`` for every row of `docs`.

    ``component_id`` is the smallest id reachable over links of at most `radius` differing bits, the row's own
    included; ids of null count for nothing, so it is null only if the whole group has none. Null and blank texts
    share the zero fingerprint. Repeated rows stay. Extra columns are dropped unless carried.
    """
    rows = written(fingerprints(docs, text_col, (id_col, *carry), width, n_words).withColumn("node", F.col("bits")[0] if n_words == 1 else F.xxhash64("bits")), "fingerprints")
    # with the ratio, sizes matter too: nodes are told apart by both, so that equal bits of unlike sizes don't merge
    if ratio:
        rows = rows.withColumn("node", F.xxhash64("bits", "n_shingles"))
    nodes = written(rows.groupBy("node").agg(F.min(id_col).alias("least"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n_shingles")), "nodes")
    roots = components(links(nodes, radius, ratio))
    grouped = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    members = written(grouped.join(lowest, "root").select("node", F.col("root").alias("group"), "component_id"), "members")
    return rows.join(members, "node").select(id_col, *carry, "bits", "n_shingles", "group", "component_id")


def _similar(bits: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """For each row the root of its group, from all pairs of a row of `left` and one of `right` with similar sets.

    `sets` has the different shingles of each row as small numbers. Pairs outside the radius, and pairs already in one
    group, are not counted out.
    """
    size = np.array([len(x) for x in sets])
    parent, marked = np.arange(len(sets)), np.zeros(max((int(x.max()) + 1 for x in sets if len(x)), default=1), bool)
    symmetric = np.array_equal(left, right)
    right = right[np.argsort(size[right], kind="stable")]
    left = right if symmetric else left
    sorted_size = size[right]

    def roots(rows: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := parent[rows], rows):
            rows = up
        return rows

    for k, row in enumerate(left):
        low = k + 1 if symmetric else np.searchsorted(sorted_size, similarity * size[row] - 1e-9)
        found = right[low : np.searchsorted(sorted_size, size[row] / similarity + 1e-9, side="right")]
        found = found[_distance(bits[found], bits[row]) <= radius]
        root = roots(np.array([row]))
        found = found[roots(found) != root]
        if not len(found):
            continue
        marked[sets[row]] = True
        starts = np.concatenate([[0], np.cumsum(size[found])[:-1]])
        shared = np.add.reduceat(marked[np.concatenate([sets[x] for x in found])], starts, dtype=np.int64)
        marked[sets[row]] = False
        ends = roots(found[shared >= similarity * (size[row] + size[found] - shared) - 1e-9])
        if len(ends):
            parent[np.append(ends, root)] = min(int(root[0]), int(ends.min()))
    return roots(parent)


def verified_links(texts: DataFrame, radius: int, similarity: float, width: int, rows: int = 2048, shingles: int = 1 << 20) -> DataFrame:
    """Links ``(a, b)`` between texts ``(node, text, bits, n_shingles, group)`` whose shingle sets are really similar.

    Only members of one group are compared. Small groups share tasks of about `shingles` shingles; a group above that or
    above `rows` members is cut into blocks, and each pair of blocks is a task. A task returns a spanning forest.
    """
    sizes = written(texts.groupBy("group").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w")).where("m > 1"), "sizes")
    total = sizes.agg(F.sum("w")).first()[0] or 0
    blocks = F.greatest(F.ceil(F.col("m") / rows), F.ceil(F.col("w") / shingles)).cast("int")
    task = F.when(F.col("blocks") > 1, F.col("group")).otherwise(F.pmod(F.xxhash64("group"), F.lit(max(16, 2 * total // shingles))))
    dealt = texts.join(sizes.select("group", blocks.alias("blocks")), "group").withColumn("task", task)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"))))
    dealt = dealt.withColumn("pair", pair).select("node", "text", "bits", "group", "own", "blocks", "task", "pair.i", "pair.j")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(t.encode(), width)) for t in pdf["text"]]
        ends = np.cumsum([len(x) for x in sets])
        numbers = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], ends[:-1])
        bits = np.array(pdf["bits"].tolist(), np.int64).view(np.uint64)
        node, own = pdf["node"].to_numpy(), pdf["own"].to_numpy()
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a, b = [], []
        for at in pdf.groupby("group", sort=False).indices.values():
            home = own[at]
            root = _similar(bits[at], [numbers[k] for k in at], np.flatnonzero(home == i), np.flatnonzero(home == j), radius, similarity)
            linked = root != np.arange(len(at))
            a.append(node[at[linked]])
            b.append(node[at[root[linked]]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return written(dealt.groupBy(F.col("blocks") > 1, "task", "i", "j").applyInPandas(compare, "a bigint, b bigint"), "verified")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, n_words: int = 8, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row of each near-duplicate group, all columns kept.

    Rows link when the Jaccard similarity of their sets of different shingles is `similarity` or more, counted exactly.
    Fingerprints of the sets only find candidates: with J the similarity, the angle between two sets is at most
    acos(2J / (1 + J)), fingerprints differ in that share of pi, and the radius is four standard errors above. The row
    with the smallest id stays (ties: smallest text hash; one of equal rows). Rows without words have nothing to
    compare, are no near-duplicates, and stay.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bound = int(64 * n_words * share + 4 * np.sqrt(64 * n_words * share * (1 - share)))
    names = [f"_c{i}" for i in range(len(docs.columns))]  # by position, so that no column of `docs` can clash
    plain = docs.toDF(*names)
    given = docs.columns
    id_col, text_col, key = names[given.index(id_col)], names[given.index(text_col)], "_hash"
    has_words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    worded = plain.where(has_words).withColumn(key, F.xxhash64(id_col, text_col))
    rows = written(fingerprints(worded.select(F.col(id_col).alias("id"), F.col(key).alias("h"), F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text")), "text", ("id", "h", "node"), width, n_words, True), "fingerprints")
    texts = rows.groupBy("node").agg(F.min("h").alias("h"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n_shingles")).withColumn("print", F.xxhash64("bits", "n_shingles"))
    texts = written(texts, "texts")
    prints = written(texts.groupBy(F.col("print").alias("node")).agg(F.first("bits").alias("bits"), F.first("n_shingles").alias("n_shingles")), "prints")
    near = components(links(prints, bound, similarity)).select(F.col("node").alias("print"), F.col("root"))
    grouped = written(texts.join(near, "print", "left").withColumn("group", F.coalesce("root", "print")).drop("print", "root"), "grouped")
    several = grouped.groupBy("group").agg(F.count("*").alias("m")).where("m > 1").select("group")
    wanted = written(grouped.join(several, "group", "left_semi"), "wanted")
    # one row's text for each different text that has a candidate
    found = worded.select(F.col(key).alias("h"), F.col(text_col).alias("text")).join(wanted, "h").dropDuplicates(["h", "node"])
    roots = components(verified_links(written(found, "candidates"), bound, similarity, width))
    best = rows.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "h")).alias("s"))
    chosen = worded.join(best.select(F.col("s.h").alias(key)), key, "left_semi").dropDuplicates([key, id_col])
    return chosen.select(*names).union(plain.where(~has_words)).toDF(*given)
