"""Token-id files: static range asymmetric numeral systems over one shared frequency table.

`write_ids` tokenises every text, sorts the documents by id, and writes blocks of about a million ids. All blocks share
one frequency table, counted over all documents and scaled to a power of two. A block is coded on its own: up to 1,024
interleaved coder states ("lanes"; id ``i`` belongs to lane ``i % lanes``) share one stream of 32-bit words. Every
`SEGMENT` ids a checkpoint keeps the lanes' states, the place in the stream and a CRC-32 of the ids, so segments decode
on their own, in any order, and damage is noticed where it is. `read_documents`, `read_ids` and `read_range` read the files back.

A folder of files holds three tables: ``blocks`` (Parquet as the container: one row per block, its index of documents
and its payload in the format of `encode_block`), ``parts`` (where each part of the sorted stream starts) and ``table``
(the frequency table). Only Spark reads and writes them, so any store that Spark reaches will do.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import written
from vacantia.session import work_folder

#: Ids in a block and between checkpoints, most lanes, and the coder's lower state bound.
BLOCK, SEGMENT, LANES, LOW = 1 << 20, 1 << 18, 1024, np.uint64(1 << 31)
#: Distinct pieces a worker remembers before it starts anew, and bytes of text tokenised at once.
PIECES, BYTES = 500_000, 4_000_000
HEAD = struct.Struct("<4sHHIIQI")
MAGIC, VERSION = b"RANS", 1
_WORD32 = np.uint64(32)


# ---- frequency tables ---------------------------------------------------------------------------
class Frequencies:
    """Frequencies of the ids that occur, scaled to sum to ``2**bits``, each at least 1."""

    def __init__(self, ids: Sequence[int], scaled: Sequence[int], bits: int) -> None:
        self.ids, self.bits = np.asarray(ids, np.uint32), bits
        scaled = np.asarray(scaled, np.uint64)
        size = int(self.ids.max(initial=0)) + 1
        self.width, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.width[self.ids], self.start[self.ids] = scaled, np.cumsum(scaled) - scaled
        self.slots = np.repeat(self.ids, scaled.astype(np.int64))
        self.crc = zlib.crc32(np.stack([self.ids.astype("<u4"), scaled.astype("<u4")]).tobytes() + bytes([bits]))

    @classmethod
    def scale(cls, ids: Sequence[int], counts: Sequence[int]) -> Frequencies:
        """The table for `counts` of `ids` (ascending). The slots left over or short go to the largest counts."""
        counts = np.asarray(counts, np.float64)
        bits = max(20, int(len(counts)).bit_length() + 2)
        scaled = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * (1 << bits))).astype(np.int64)
        short = (1 << bits) - int(scaled.sum())
        order = np.argsort(-counts, kind="stable")
        if short > 0 and len(order):
            scaled[order[0]] += short
        for at in order:
            if short >= 0:
                break
            taken = min(-short, int(scaled[at]) // 2)
            scaled[at] -= taken
            short += taken
        return cls(ids, scaled, bits)


# ---- blocks -------------------------------------------------------------------------------------
def encode_block(ids: np.ndarray, table: Frequencies, segment: int = SEGMENT) -> bytes:
    """`ids` as one self-contained block: header, checkpoints, words, and a CRC-32 of all that.

    Steps of one id per lane are encoded from the last to the first, as decoding runs the other way.
    """
    n = len(ids)
    lanes = int(min(LANES, max(16, 1 << max(0, (n // 64).bit_length() - 1))))
    per = max(1, segment // lanes)
    steps, mask = -(-n // lanes), (1 << 32) - 1
    if n and (int(ids.max()) >= len(table.width) or not table.width[ids].all()):
        raise ValueError("an id is missing from the frequency table")
    width, start = table.width[ids], table.start[ids]
    limit, shift = width << np.uint64(63 - table.bits), np.uint64(table.bits)
    state, words, marks, count = np.full(lanes, LOW), [], [], 0
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, step * lanes + lanes)
        x, f = state[: b - a], width[a:b]
        full = np.flatnonzero(x >= limit[a:b])
        if len(full):
            words.append((x[full] & np.uint64(mask)).astype("<u4"))
            count += len(full)
            x[full] >>= _WORD32
        quotient, rest = np.divmod(x, f)
        state[: b - a] = (quotient << shift) + rest + start[a:b]
        if step % per == 0:
            marks.append((count, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
    raw = ids.astype("<u4")
    body = [HEAD.pack(MAGIC, VERSION, lanes, per, len(marks), n, table.crc)]
    for k, (used, states) in enumerate(reversed(marks)):
        body.append(struct.pack("<II", len(stream) - used, zlib.crc32(raw[k * per * lanes : (k + 1) * per * lanes].tobytes())))
        body.append(states.astype("<u8").tobytes())
    body.append(stream.tobytes())
    packed = b"".join(body)
    return packed + struct.pack("<I", zlib.crc32(packed))


def decode_block(block: bytes, table: Frequencies, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids `first` to `last` (exclusive; all by default) of a block, from only the segments that hold them."""
    if zlib.crc32(memoryview(block)[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a block is damaged")
    magic, version, lanes, per, n_marks, n, crc = HEAD.unpack_from(block)
    if (magic, version) != (MAGIC, VERSION) or crc != table.crc:
        raise ValueError("not a block of this format and frequency table")
    last = n if last is None else min(last, n)
    span, mark = per * lanes, 8 + 8 * lanes
    at = HEAD.size + n_marks * mark
    stream = np.frombuffer(block, "<u4", (len(block) - 4 - at) // 4, at)
    found = []
    for k in range(first // span, -(-last // span) if last > first else first // span):
        place, wanted = struct.unpack_from("<II", block, HEAD.size + k * mark)
        state = np.frombuffer(block, "<u8", lanes, HEAD.size + k * mark + 8).astype(np.uint64)
        ids = _decode(stream, place, state, min(span, n - k * span), table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != wanted:
            raise ValueError("a segment is damaged")
        found.append(ids[max(0, first - k * span) : last - k * span])
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def _decode(stream: np.ndarray, place: int, state: np.ndarray, n: int, table: Frequencies) -> np.ndarray:
    """`n` ids from the states of a checkpoint and the words from `place`."""
    lanes, shift, low = len(state), np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    out = np.empty(n, np.uint32)
    for a in range(0, n, lanes):
        x = state[: min(lanes, n - a)]
        slot = x & low
        ids = table.slots[slot]
        out[a : a + lanes] = ids
        x = table.width[ids] * (x >> shift) + slot - table.start[ids]
        empty = np.flatnonzero(x < LOW)
        if len(empty):
            x[empty] = (x[empty] << _WORD32) | stream[place : place + len(empty)]
            place += len(empty)
        state[: len(x)] = x
    return out


# ---- tokens -------------------------------------------------------------------------------------
#: Runs without white space, each with the blank before it, and white space as a byte-level pre-tokeniser divides it.
_PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space side by side, or other than blanks and line ends; the last four count as white space only here, not in the tokenizer.
_ADJACENT, _SPACES, _CONTROLS = ("  ", "\n\n", " \n", "\n "), "\t\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000", "\0\x1c\x1d\x1e\x1f"
#: A word and signs behind it, always tokens of their own (but for an apostrophe, which may begin a contraction).
_TAILED = re.compile(r"( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)")
_loaded: dict[str | None, Tokens] = {}


class Tokens:
    """A tokenizer that encodes each distinct piece of text once. Texts with a special token's string are encoded whole."""

    def __init__(self, path: str | None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        # pieces are independent only under this pre-tokeniser and without a normaliser; a line end tells joined ones apart
        plain = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if plain and len(newline) == 1 else None
        self._forget()

    def _forget(self, kept: Sequence[str] = (), ids: np.ndarray | None = None, sizes: np.ndarray | None = None) -> None:
        """Remember only the pieces `kept`, with their ids one behind the other."""
        self.place: defaultdict[str, int] = defaultdict(None, {piece: i for i, piece in enumerate(kept)})
        self.place.default_factory = self.place.__len__
        self.ids = np.empty(0, self.dtype) if ids is None else ids
        self.size = np.empty(0, np.int64) if sizes is None else sizes
        self.first, self.used = np.cumsum(self.size) - self.size, np.zeros(len(self.size), np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at `places`, one behind the other, and where each ends."""
        sizes = self.size[places]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.first[places] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _append(self, places: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.first[places], self.size[places] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        self.ids = np.concatenate([self.ids, ids])

    def _learn(self) -> None:
        """The tokens of the pieces met for the first time. White space is encoded singly, all else joined by line ends; a
        word with signs behind it is the word and the signs."""
        known = len(self.size)
        fresh = list(self.place)[known:]
        blank, tailed, halves = [], [], []
        for i, piece in enumerate(fresh, known):
            if found := _TAILED.fullmatch(piece):
                tailed.append(i)
                halves += [self.place[found[1]], self.place[found[2]]]
            elif not piece or piece.isspace():
                blank.append(i)
        fresh = list(self.place)[known:]
        more = np.zeros(len(fresh), np.int64)
        self.first, self.size, self.used = np.append(self.first, more), np.append(self.size, more), np.append(self.used, more)
        if blank:
            parts = self._whole([fresh[i - known] for i in blank])
            self._append(np.array(blank), np.concatenate(parts), np.array(list(map(len, parts)), np.int64))
        others = np.ones(len(fresh), bool)
        others[np.array(blank + tailed, np.int64) - known] = False
        words = np.flatnonzero(others)
        if len(words):
            ids = self._whole(["\n".join([fresh[i] for i in words.tolist()])])[0]
            inside = ids != self.newline
            ends = np.append(np.flatnonzero(~inside), len(ids))
            self._append(words + known, ids[inside], np.diff(ends, prepend=-1) - 1)
        if tailed:
            ids, ends = self._gather(np.array(halves))
            self._append(np.array(tailed), ids, np.diff(ends[1::2], prepend=0))

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text (none may be null).

        A piece is a run without white space with the blank before it, or a line end; each different one is looked up
        once. Texts with other white space are divided by a pattern, and those with control characters or special tokens encoded whole.
        """
        if self.newline is None:
            return self._whole(texts.to_pylist())
        if len(self.place) > PIECES:  # keep what was used more than once, but not more than half
            often = np.flatnonzero(self.used > max(1, int(np.partition(self.used, -(PIECES // 2))[-(PIECES // 2)])))
            names = list(self.place)
            self._forget([names[i] for i in often.tolist()], self._gather(often)[0], self.size[often])
        plain = texts.to_pylist()
        whole = [i for i, t in enumerate(plain) if any(c in t for c in _CONTROLS) or any(c in t for c in self.special)]
        spaced = [i for i, t in enumerate(plain) if any(c in t for c in _ADJACENT) or any(c in t for c in _SPACES)]
        given = dict(zip(whole, self._whole([plain[i] for i in whole]), strict=True))
        odd = {i: list(map(self.place.__getitem__, _PIECE.findall(plain[i]))) for i in spaced if i not in given}
        easy = np.ones(len(plain), bool)
        easy[whole + spaced] = False
        split = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts.filter(pa.array(easy)), " ", "\0 "), "\n", "\0\n\0"), "\0")
        coded = split.flatten().dictionary_encode()
        names = np.fromiter(map(self.place.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        self._learn()
        flat = np.concatenate([names[coded.indices.to_numpy()], np.fromiter(chain.from_iterable(odd.values()), np.int64)])
        self.used += np.bincount(flat, minlength=len(self.used))
        ids, ends = self._gather(flat)
        counts = np.concatenate([pc.list_value_length(split).to_numpy(zero_copy_only=False), np.fromiter(map(len, odd.values()), np.int64)]).astype(np.int64)
        bounds = np.concatenate(([0], ends))[np.cumsum(np.append(0, counts))].tolist()
        for k, i in enumerate(chain(np.flatnonzero(easy).tolist(), odd)):
            given[i] = ids[bounds[k] : bounds[k + 1]]
        return [given[i] for i in range(len(plain))]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` of about `BYTES` each."""
    first = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    yield first, len(texts)


def tokenize(docs: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",), tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """`carry` and ``ids`` (little-endian integers, `end_id` last) for each row; a null text counts as empty.

    Integers have 16 bits if the vocabulary allows it, else 32. `tokenizer` is the path of a file of the tokenizers
    library that every executor has; by default the public byte-level one with 50,257 ids.
    """
    schema = docs.select(*[docs[f"`{c}`"] for c in carry]).schema.add("ids", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = Tokens(tokenizer)
        tokens = _loaded[tokenizer]
        end = np.array([end_id], tokens.dtype).tobytes()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in _slices(texts):
                ids = [row.tobytes() + end for row in tokens.encode(pc.fill_null(texts.slice(a, b - a), ""))]
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:-1]], pa.array(ids, pa.binary())], names=[f.name for f in schema])

    return docs.select(*[docs[f"`{c}`"] for c in carry], docs[f"`{text_col}`"].alias("_text")).mapInArrow(run, schema)


# ---- files --------------------------------------------------------------------------------------
def _flat(ids: pa.Array, dtype: str) -> np.ndarray:
    """All ids of a binary column in a row, without a copy."""
    offsets = np.frombuffer(ids.buffers()[1], "<i4", len(ids) + 1, 4 * ids.offset)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(ids.buffers()[2], dtype, (offsets[-1] - offsets[0]) // size, offsets[0]) if len(ids) else np.empty(0, dtype)


def _counted(ids: DataFrame, dtype: str) -> DataFrame:
    """``id, n`` over all rows of a binary column; each task passes on at most the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1, np.int64)
        for batch in batches:
            found = np.bincount(_flat(batch.column(0), dtype))
            if len(found) > len(totals):
                totals, found = found, totals
            totals[: len(found)] += found
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at], pa.int64())], names=["id", "n"])

    return ids.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _load_table(spark: SparkSession, folder: str) -> Frequencies:
    """The frequency table: one row per id of the vocabulary that occurs, whatever the number of documents."""
    rows = sorted(spark.read.parquet(f"{folder}/table").collect())
    return Frequencies([r["id"] for r in rows], [r["width"] for r in rows], rows[0]["bits"] if rows else 20)


def write_ids(
    docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, block: int = BLOCK, segment: int = SEGMENT,
) -> str:
    """Write the ids of all `docs` in ascending order of `id_col`; returns the folder.

    Null ids come first; rows with the same id keep the order in which the input lists them, and one id may hold any share of the rows: its rows are
    ranged by their place too. A document longer than a block continues in the next ones. Only ids are shuffled, not texts.
    Without rows there are no blocks. Extra columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or work_folder(spark)
    plain = docs.select(docs[f"`{id_col}`"].alias("id"), F.monotonically_increasing_id().alias("at"), docs[f"`{text_col}`"].alias("text"))
    tokens = written(tokenize(plain, "text", ("id", "at"), tokenizer, end_id), "tokens")
    dtype = Tokens(tokenizer).dtype
    counts = sorted(_counted(tokens.select("ids"), dtype).collect())  # at most the vocabulary
    table = Frequencies.scale([r["id"] for r in counts], [r["n"] for r in counts])
    spark.createDataFrame(
        [(int(i), int(w), table.bits) for i, w in zip(table.ids, table.width[table.ids], strict=True)] if counts else [], "id bigint, width bigint, bits int",
    ).coalesce(1).write.parquet(f"{folder}/table")
    sent = spark.sparkContext.broadcast((table.ids, table.width[table.ids] if counts else [], table.bits))
    entry = T.StructType([T.StructField("id", tokens.schema["id"].dataType), T.StructField("skip", T.LongType()), T.StructField("n", T.LongType()), T.StructField("n_tokens", T.LongType())])
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("docs", T.ArrayType(entry)), T.StructField("payload", T.BinaryType()),
    ])
    sizes = [pa.field(c, pa.int64()) for c in ("skip", "n", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, start = Frequencies(*sent.value), TaskContext.get().partitionId(), 0
        held, index, room = [], [], block

        def flush() -> pa.RecordBatch:
            nonlocal held, index, room, start
            ids = np.concatenate(held)
            row = [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([index], pa.list_(pa.struct([pa.field("id", id_type), *sizes]))), pa.array([encode_block(ids, table, segment)], pa.binary())]
            start, held, index, room = start + len(ids), [], [], block
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, raw in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(raw.as_buffer(), dtype)
                skip = 0
                while skip < len(ids):
                    take = ids[skip : skip + room]
                    held.append(take)
                    index.append({"id": key.as_py(), "skip": skip, "n": len(take), "n_tokens": len(ids)})
                    skip, room = skip + len(take), room - len(take)
                    if not room:
                        yield flush()
        if held:
            yield flush()

    ordered = tokens.repartitionByRange("id", "at").sortWithinPartitions("id", "at").select("id", "ids")
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{folder}/blocks")
    sent.destroy()
    parts = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids")
    parts.select("part", "n_ids", before.alias("base")).coalesce(1).write.parquet(f"{folder}/parts")  # one row per part
    return folder


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with ``start`` counted over all parts. There is one row in `parts` for each task that wrote blocks."""
    blocks, parts = spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/parts")
    return blocks.join(parts.select("part", "base"), "part").withColumn("start", F.col("base") + F.col("start")).select("start", "n_ids", "docs", "payload")


def _decoded(spark: SparkSession, folder: str, as_sums: bool) -> DataFrame:
    """One row per document and block: ``id``, ``start`` (of the document, over all), ``skip`` (ids in blocks before),
    ``n`` (ids here), ``n_tokens`` (of the document), and ``ids`` here as binary or their CRC-32 ``crc``."""
    table = _load_table(spark, folder)
    sent = spark.sparkContext.broadcast((table.ids, table.width[table.ids] if len(table.ids) else [], table.bits))
    rows = _placed(spark, folder)
    id_field = rows.schema["docs"].dataType.elementType["id"]
    last = T.StructField("crc", T.LongType()) if as_sums else T.StructField("ids", T.BinaryType())
    schema = T.StructType([id_field, *[T.StructField(c, T.LongType()) for c in ("start", "skip", "n", "n_tokens")], last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Frequencies(*sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode_block(batch.column(3)[i].as_py(), table).astype("<u4")
                entries = batch.column(2)[i].values
                skip, n, n_tokens = (entries.field(k).to_numpy() for k in (1, 2, 3))
                ends = np.cumsum(n)
                begin = batch.column(0)[i].as_py() + ends - n - skip
                rows = (ids[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True))
                made = pa.array([zlib.crc32(row) for row in rows], pa.int64()) if as_sums else pa.array([row.tobytes() for row in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([entries.field(0), pa.array(begin, pa.int64()), pa.array(skip), pa.array(n), pa.array(n_tokens), made], names=schema.names)

    return rows.mapInArrow(run, schema)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``id, start, skip, n, n_tokens, ids``: each document's ids (little-endian 32-bit), a row for each block that holds some."""
    return _decoded(spark, folder, False)


def read_range(spark: SparkSession, folder: str, first: int, last: int) -> np.ndarray:
    """Ids `first` to `last` (exclusive) of the whole stream. Only the blocks and segments that hold them are decoded; the
    caller asks for as many as fit the driver."""
    table = _load_table(spark, folder)
    held = _placed(spark, folder).where((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first)).select("start", "payload")
    found = [decode_block(r["payload"], table, max(0, first - r["start"]), last - r["start"]) for r in sorted(held.collect(), key=lambda r: r["start"])]
    return np.concatenate(found) if found else np.empty(0, np.uint32)


# ---- checksums of documents ---------------------------------------------------------------------
def crc_join(a: int, b: int, n: int) -> int:
    """The CRC-32 of two strings joined, from those of the first and of the second, which has `n` bytes.

    `n` zero bytes after the first string are a linear map over bits; its powers of two are built by squaring.
    """
    step = [0xEDB88320, *[1 << i for i in range(31)]]  # one zero bit
    for _ in range(3):
        step = [_sum_bits(step, row) for row in step]
    while n:
        if n & 1:
            a = _sum_bits(step, a)
        step, n = [_sum_bits(step, row) for row in step], n >> 1
    return a ^ b


def _sum_bits(matrix: list[int], bits: int) -> int:
    found = 0
    for row in matrix:
        if bits & 1:
            found ^= row
        bits >>= 1
    return found


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: ``id``, ``start``, ``n_tokens`` and ``ids_crc32`` of its little-endian ids, as decoded.

    Documents within one block are summed where they are decoded; only those that span blocks are grouped, as sums.
    """
    pieces = written(_decoded(spark, folder, True), "pieces")
    whole = F.col("n") == F.col("n_tokens")
    result = T.StructType([*pieces.schema[:2], pieces.schema["n_tokens"], T.StructField("ids_crc32", T.LongType())])

    def joined(group: pa.Table) -> pa.Table:
        rows = group.sort_by("skip")
        crc = 0
        for piece, n in zip(rows["crc"].to_pylist(), rows["n"].to_pylist(), strict=True):
            crc = crc_join(crc, piece, 4 * n)
        return pa.Table.from_arrays([rows[c].slice(0, 1) for c in ("id", "start", "n_tokens")] + [pa.array([crc], pa.int64())], names=result.names)

    return pieces.where(whole).select("id", "start", "n_tokens", F.col("crc").alias("ids_crc32")).union(pieces.where(~whole).groupBy("start").applyInArrow(joined, result))
