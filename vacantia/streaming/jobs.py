"""Structured Streaming jobs: exact request admission, continuous first-wins dedupe, page statistics."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vacantia.operators.crawl import HOUR_US, MAX_PER_HOUR, micros
from vacantia.session import work_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PACKED = T.StructType([T.StructField("packed", T.BinaryType())])
PLACE = T.StructType([T.StructField("us", T.LongType()), T.StructField("request_id", T.LongType())])
ADMISSION = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("request_id", T.LongType()), T.StructField("us", T.LongType()),
    T.StructField("admitted", T.BooleanType()), T.StructField("used", T.IntegerType()), T.StructField("next_slot_min", T.IntegerType()),
])
#: Waiting requests in one block of state (up to twice as many before it is split), and requests taken from a batch at once.
BLOCK, AT_ONCE = 4096, 65_536
_admission = Row(*ADMISSION.names)


def _pack(rows: Sequence[int] | np.ndarray) -> tuple[bytes]:
    return (np.asarray(rows, "<i8").tobytes(),)


class HourlyAdmission(StatefulProcessor):
    """Rolling-hour budget of one key, decided in event-time order whatever the batches.

    Requests wait until the watermark has passed them. Then they are taken in order of time and id, so the answers
    don't depend on how files fell into batches. What waits (as much as the lateness allows) lies in blocks of requests
    that follow each other in time, named in a directory by their first request. A new request touches its own block; a timer
    reads the blocks it settles, one after the other, and rewrites at most the one it stops in. So a busy key costs a
    task one block, the directory (a few bytes per block) and the admitted requests of the last hour (never more than
    the budget). One timer is set per key, for its first waiting request, or else an hour after its last admitted one.
    """

    def __init__(self, max_per_hour: int, block: int = BLOCK) -> None:
        self.max_per_hour, self.block = max_per_hour, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", PACKED)
        self.directory = handle.getValueState("directory", PACKED)
        self.waiting = handle.getMapState("waiting", PLACE, PACKED)

    @staticmethod
    def _unpacked(value: tuple | None, width: int) -> np.ndarray:
        return np.frombuffer(value[0] if value else b"", "<i8").reshape(-1, width)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        starts = self._unpacked(self.directory.get(), 2).tolist()
        head = starts[0] if starts else None
        pairs = ([row.us, row.request_id] for row in rows)
        while fresh := sorted(islice(pairs, AT_ONCE)):
            self._insert(starts, fresh)
        if head is None or starts[0] < head:
            self.handle.registerTimer(starts[0][0] // 1000 + 1)
        self.directory.update(_pack(starts))
        return iter(())

    def _insert(self, starts: list[list[int]], fresh: list[list[int]]) -> None:
        """Put sorted requests into their blocks, splitting those that grow too long; `starts` follows."""
        end = len(fresh)
        for at in range(max(len(starts) - 1, 0), -1, -1):  # from the last block back, so that places in `starts` hold
            begin = bisect_left(fresh, starts[at], 0, end) if at else 0
            if begin == end:
                continue
            name = tuple(starts[at]) if starts else None
            held = self._unpacked(self.waiting.getValue(name), 2).tolist() if name else []
            merged = sorted(held + fresh[begin:end]) if held else fresh[begin:end]
            size = self.block if len(merged) > 2 * self.block else len(merged)
            pieces = [merged[i : i + size] for i in range(0, len(merged), size)]
            if name and name != tuple(merged[0]):
                self.waiting.removeKey(name)
            for piece in pieces:
                self.waiting.updateValue(tuple(piece[0]), _pack(piece))
            starts[at : at + 1] = [piece[0] for piece in pieces]
            end = begin

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        settled = mark * 1000 - 1000  # a request is settled once the watermark has passed its whole millisecond
        starts = self._unpacked(self.directory.get(), 2).tolist()
        recent = deque(self._unpacked(self.recent.get(), 1)[:, 0].tolist())
        read = 0
        while read < len(starts) and starts[read][0] // 1000 * 1000 <= settled:
            name = tuple(starts[read])
            block = self._unpacked(self.waiting.getValue(name), 2)
            n = int(np.searchsorted(block[:, 0] // 1000 * 1000, settled, side="right"))
            for us, request_id in block[:n].tolist():
                while recent and recent[0] <= us - HOUR_US:
                    recent.popleft()
                admitted = len(recent) < self.max_per_hour
                minutes = None if admitted else math.ceil((recent[0] + HOUR_US - us) / 60_000_000)
                if admitted:
                    recent.append(us)
                yield _admission(key[0], request_id, us, admitted, len(recent), minutes)
            self.waiting.removeKey(name)
            if n < len(block):
                self.waiting.updateValue(tuple(block[n].tolist()), _pack(block[n:]))
                starts[read] = block[n].tolist()
                break
            read += 1
        if read < len(starts):
            self.directory.update(_pack(starts[read:]))
            self.handle.registerTimer(starts[read][0] // 1000 + 1)
        else:
            self.directory.clear()
            while recent and recent[0] <= mark * 1000 - HOUR_US:
                recent.popleft()
            if recent:
                self.handle.registerTimer((recent[-1] + HOUR_US) // 1000 + 1)
        if recent:
            self.recent.update(_pack(recent))
        else:
            self.recent.clear()

    def close(self) -> None:
        pass


def stream_budget(stream: DataFrame, *, key: str = "key", request: str = "request_id", ts: str = "ts", max_per_hour: int = MAX_PER_HOUR, late: str = "1 day", block: int = BLOCK) -> DataFrame:
    """Each request admitted or refused by the rolling-hour budget of its key, in event-time order.

    `late` is how far a request may arrive behind the newest one; a decision is emitted once the watermark, that far
    behind, has passed it. `block` is the number of waiting requests of a key held in memory at once. The state store must be RocksDB (`run_available` sees to that).
    """
    timed = stream.select(
        F.col(key).cast("string").alias("key"), F.col(request).cast("bigint").alias("request_id"), micros(F.col(ts)).alias("us"),
        F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    return timed.groupBy("key").transformWithState(
        statefulProcessor=HourlyAdmission(min(max_per_hour, MAX_PER_HOUR), block), outputStructType=ADMISSION, outputMode="Append", timeMode="EventTime")


def stream_offers(stream: DataFrame, *, key: str = "slug", ts: str = "ts", order: list[str] | None = None, horizon: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The first card of each key in each `horizon` of time: the one with the smallest `order` columns (by default its
    time), whichever arrived first. A period is emitted once the watermark, `late` behind the newest card, passes it."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    first = F.min_by(F.struct(*[c for c in stream.columns if c != key]), F.struct(*(order or [ts])))
    return timed.groupBy(F.window(ts, horizon), key).agg(first.alias("first")).select(key, "first.*")


def stream_page_stats(
    stream: DataFrame, *, ts: str = "ts", new: str = "new", outcome: str = "outcome", bucket: str = "10 minutes", late: str = "10 minutes",
) -> DataFrame:
    """Cards, new offers and errors per time bucket, emitted once a bucket is complete."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, bucket)).agg(
        F.count("*").alias("cards"), F.count_if(F.col(new)).alias("new"), F.count_if(F.col(outcome) != "ok").alias("errors"),
    ).select(F.col("window.start").alias("bucket_start"), "cards", "new", "errors")


def read_stream(spark: SparkSession, folder: str, table: str, *, files_per_batch: int = 64) -> DataFrame:
    """A Parquet table as a stream of files, a bounded number per micro-batch."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # as a pattern, the path may be one file or a folder of them
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{table}.parque[t]")


def run_available(stream: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Run a stream over all data there is, into a written table, and read that back."""
    spark = stream.sparkSession
    folder = work_folder(spark)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start(f"{folder}/table"))
    if before is None:
        spark.conf.unset(setting)
    else:
        spark.conf.set(setting, before)
    query.awaitTermination()
    return spark.read.schema(schema or stream.schema).parquet(f"{folder}/table")
