"""Crawl audits: first-wins dedupe, pages and stop rules, enrichment, run statistics, request-log policy."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from vacantia.session import written

# ---- fixed values: limits of a run --------------------------------------------------------------
MAX_PAGES = 400
PAGES_WITHOUT_NEW = 3
RETRY_STATUS = (403, 429, 500, 502, 503, 504)
BLOCK_STATUS = (403, 429)
BACKOFF_BASE_S = 2.0
RETRY_AFTER_MAX_S = 300.0
MAX_RETRIES = 4
MAX_PER_HOUR = 240
HOUR_US = 3_600_000_000
DETAIL_FIELDS = ("description", "salary_min", "salary_max", "published_at", "valid_through", "external_id")


# ---- dedupe -------------------------------------------------------------------------------------
def dedupe_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of every key by `order` (unique positions); rows with a NULL key are all kept.

    An aggregate instead of a ranking window: repeats collapse before the shuffle, so a key that holds
    a large share of the rows costs one row per input task.
    """
    position = F.struct(*order)
    firsts = df.groupBy(F.col(key).alias("_key"), F.when(F.col(key).isNull(), position).alias("_unkeyed"))
    return firsts.agg(F.min_by(F.struct(*df.columns), position).alias("_row")).select("_row.*")


# ---- running totals -----------------------------------------------------------------------------
def running_total(
    df: DataFrame, index: str, value: str, out: str, *, by: Sequence[str] = (), width: int = 65_536,
) -> DataFrame:
    """Running sum of `value` along an integer `index`, unique within `by`, without one task seeing a
    whole series.

    Rows are summed per block of `width` indexes and per block of blocks; each window then covers one
    block, and only the top level (one row per ``width**2`` indexes) is ordered as a whole.
    """
    rows = df.withColumn("_b1", F.floor(F.col(index) / width))
    level1 = rows.groupBy(*by, "_b1").agg(F.sum(value).alias("_s1")).withColumn("_b2", F.floor(F.col("_b1") / width))
    level2 = level1.groupBy(*by, "_b2").agg(F.sum("_s1").alias("_s2"))
    before = (Window.unboundedPreceding, -1)
    base2 = F.coalesce(F.sum("_s2").over(Window.partitionBy(*by).orderBy("_b2").rowsBetween(*before)), F.lit(0))
    base1 = F.coalesce(F.sum("_s1").over(Window.partitionBy(*by, "_b2").orderBy("_b1").rowsBetween(*before)), F.lit(0))
    offsets = (
        level1.join(level2.select(*by, "_b2", base2.alias("_base2")), [*by, "_b2"])
        .select(*by, "_b1", (base1 + F.col("_base2")).alias("_base"))
    )
    inside = F.sum(value).over(Window.partitionBy(*by, "_b1").orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(offsets, [*by, "_b1"]).withColumn(out, F.col("_base") + inside).drop("_b1", "_base")


def new_per_page(cards: DataFrame, *, page: str = "page", key: str = "slug") -> DataFrame:
    """Per page: cards, new keys, duplicates, and the running number of offers."""
    counted = cards.groupBy(page).agg(F.count("*").alias("cards"), F.count_if(F.col(key).isNull()).alias("_unkeyed"))
    firsts = (
        cards.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(page).alias(page))
        .groupBy(page).agg(F.count("*").alias("_first"))
    )
    new = F.coalesce(F.col("_first"), F.lit(0)) + F.col("_unkeyed")
    pages = counted.join(firsts, page, "left").select(
        page, "cards", new.alias("new"), (F.col("cards") - new).alias("duplicates"))
    return running_total(pages, page, "new", "offers_so_far")


def stop_reason(
    page_log: DataFrame, *, by: Sequence[str] = (), max_pages: int | None = None, page: str = "page",
    cards: str = "cards", new: str = "new", last_page: str = "last_page", outcome: str | None = None,
) -> DataFrame:
    """Where each run stops: ``(by…, page, reason, pages, offers)``.

    Rules in order on each page: a failed request (`outcome`: blocked, error, robots, interrupted), no
    cards, the last page announced on page 1, the page cap, three pages in a row without a new offer.
    Only pages up to the cap are read, so every window holds at most that many rows.
    """
    cap = min(max_pages, MAX_PAGES) if max_pages and max_pages > 0 else MAX_PAGES
    log = page_log.where(F.col(page) <= cap)
    run = Window.partitionBy(*by).orderBy(page) if by else Window.orderBy(page)
    announced = F.first(F.when(F.col(page) == 1, F.col(last_page)), ignorenulls=True).over(
        run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    stale = F.sum((F.col(new) == 0).cast("int")).over(run.rowsBetween(-(PAGES_WITHOUT_NEW - 1), 0)) == PAGES_WITHOUT_NEW
    reason = F.when(F.col(cards) == 0, "empty").when(F.col(page) >= F.col("_last"), "last_page").when(
        F.col(page) >= cap, "max_pages").when(F.col("_stale"), "no_new")
    if outcome:
        reason = F.coalesce(F.when(F.col(outcome) != "ok", F.col(outcome)), reason)
    marked = log.withColumn("_last", announced).withColumn("_stale", stale).withColumn("_reason", reason)
    first = F.min(F.when(F.col("_reason").isNotNull(), F.struct(F.col(page).alias("page"), F.col("_reason").alias("reason"))))
    reached = marked.withColumn("_stop", first.over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    walked = reached.where(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop.page")))
    return walked.groupBy(*by, F.col("_stop.page").alias("page"), F.col("_stop.reason").alias("reason")).agg(
        F.count_if(F.col(cards) > 0).alias("pages"), F.sum(new).alias("offers"))


# ---- enrichment and run statistics --------------------------------------------------------------
def _present(name: str, df: DataFrame) -> Column:
    """The value of a detail column, empty text counting as absent."""
    return F.nullif(F.col(name), F.lit("")) if dict(df.dtypes)[name] == "string" else F.col(name)


def enrich(
    offers: DataFrame, details: DataFrame, *, key: str = "slug", order: Sequence[str] = (), limit: int | None = None,
    fields: Sequence[str] = DETAIL_FIELDS,
) -> DataFrame:
    """Offers with the non-empty fields of their detail page; `enriched` says whether there were any.

    With `limit`, only the first offers by `order` are enriched. `enriched` is NULL where no detail was
    asked for or none was fetched, false where the detail page gave nothing.
    """
    found = details.select(
        F.col(key), *[_present(f, details).alias(f"_d_{f}") for f in fields],
    ).withColumn("enriched", F.coalesce(*[F.when(F.col(f"_d_{f}").isNotNull(), True) for f in fields], F.lit(False)))
    if limit and limit > 0:
        found = found.join(offers.orderBy(*order).limit(limit).select(key), key, "left_semi")
    joined = offers.join(found, key, "left")
    merged = [
        F.coalesce(F.col(f"_d_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in offers.columns
    ]
    return joined.select(*merged, "enriched")


def crawl_stats(cards: DataFrame, page_log: DataFrame, offers: DataFrame | None = None) -> DataFrame:
    """One row: pages, offers, duplicates, enriched, errors, blocked, total_reported, last_page, requests,
    duration_s and status (OK, PARTIAL, ERROR).

    `page_log`: page, cards, outcome, total, last_page, requests, seconds. `offers`: output of
    :func:`enrich` (its `enriched` false counts as an error).
    """
    from_cards = cards.agg(F.count("*").alias("cards"), F.count_distinct("slug").alias("offers"))
    first = F.col("page") == 1
    from_log = page_log.agg(
        F.count_if(F.col("cards") > 0).alias("pages"),
        F.count_if(F.col("outcome").isin("error", "blocked")).alias("listing_errors"),
        F.max(F.col("outcome") == "blocked").alias("blocked"),
        F.max(F.col("outcome") == "robots").alias("stopped"),
        F.max(F.when(first, F.col("total"))).alias("total_reported"),
        F.max(F.when(first, F.col("last_page"))).alias("last_page"),
        F.sum("requests").alias("requests"),
        F.round(F.sum("seconds"), 1).alias("duration_s"),
    )
    parts = from_cards.unionByName(from_log, allowMissingColumns=True)
    if offers is not None:
        from_details = offers.agg(
            F.count_if("enriched").alias("enriched"), F.count_if(~F.col("enriched")).alias("detail_errors"))
        parts = parts.unionByName(from_details, allowMissingColumns=True)
    else:
        parts = parts.withColumns({"enriched": F.lit(0).cast("bigint"), "detail_errors": F.lit(0).cast("bigint")})
    row = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    errors = F.col("listing_errors") + F.col("detail_errors")
    problem = (errors > 0) | F.col("blocked") | F.col("stopped")
    return row.select(
        "pages", "offers", (F.col("cards") - F.col("offers")).alias("duplicates"), "enriched", errors.alias("errors"),
        F.when(~problem, "OK").when(F.col("offers") > 0, "PARTIAL").otherwise("ERROR").alias("status"),
        "blocked", "total_reported", "last_page", "requests", "duration_s",
    )


def per_page_measure(page_log: DataFrame) -> DataFrame:
    """``per_page`` on the first page that has a next one, and the highest last page seen."""
    return page_log.agg(
        F.min_by(F.when(F.col("has_next"), F.col("cards")), F.when(F.col("has_next"), F.col("page"))).alias("per_page"),
        F.max("last_page").alias("last_page"),
    )


# ---- request-log policy -------------------------------------------------------------------------
def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less or zoned timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def _in_blocks(log: DataFrame, us: str, reach: int, width: int) -> DataFrame:
    """Rows with their block of time `_block`; those within `reach` of the block's end once more in the next one as
    context (`_own` false). A busy key is thereby split by time instead of filling one task."""
    block = F.floor(F.col(us) / width)
    near_end = (block + 1) * width - F.col(us) <= reach
    places = F.array_compact(F.array(
        F.struct(block.alias("_block"), F.lit(True).alias("_own")),
        F.when(near_end, F.struct((block + 1).alias("_block"), F.lit(False).alias("_own"))),
    ))
    return log.select("*", F.inline(places))


#: What the scan adds to a row, and what it tells of a partition (`_sum` is null on rows).
_SCAN = {
    "_part": pa.int32(), "_later": pa.int64(), "_head": pa.bool_(), "_next": pa.int64(),
    "_sum": pa.int64(), "_tail": pa.int64(), "_whole": pa.bool_(), "_last_t": pa.int64(), "_last_key": pa.string(),
}


def _scan_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A pass over changes (``_key, _t, _d`` first, then the columns of a request) in descending order.

    Each arrival gets ``_later``, the sum of the changes after its moment within the partition, and ``_next``, the
    departure that follows it; ``_head`` marks the moment with which the partition begins, which the partition before
    may share. A last row tells the partition's sum, its last moment, and the sum where that began.
    """
    part = TaskContext.get().partitionId()
    total, at_moment, moment, departure, first, types = 0, 0, None, None, None, {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, t, d, index = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(), np.arange(n)
        codes, opening = keys.dictionary_encode().indices.to_numpy(), (keys[0].as_py(), int(t[0]))
        new = np.append(moment != opening, (codes[1:] != codes[:-1]) | (t[1:] != t[:-1]))
        before = total + np.cumsum(d) - d
        began = np.maximum.accumulate(np.where(new, index, -1))  # the row with which each row's moment began
        later = np.where(began < 0, at_moment, before[began])
        gone = np.maximum.accumulate(np.where(d < 0, index, -1))  # the last departure up to each row
        following = pa.array(np.where(gone < 0, departure or 0, t[gone]), mask=(gone < 0) & (departure is None))
        first = first or opening
        in_head = opening == first and moment in (None, first)
        head = np.logical_and.accumulate(~new | (index == 0)) if in_head else np.zeros(n, bool)
        total, at_moment, moment = int(before[-1] + d[-1]), int(later[-1]), (keys[n - 1].as_py(), int(t[-1]))
        departure = following[n - 1].as_py()
        arrived = pa.array(np.flatnonzero(d > 0))
        kept = [c for i, c in enumerate(batch.columns) if i != 2]
        types = {f.name: f.type for i, f in enumerate(batch.schema) if i != 2} | _SCAN
        made = [pa.array(np.full(n, part, np.int32)), pa.array(later), pa.array(head), following, *[pa.nulls(n, types[c]) for c in list(_SCAN)[4:]]]
        yield pa.RecordBatch.from_arrays([c.take(arrived) for c in [*kept, *made]], names=list(types))
    if first is not None:
        facts = {"_key": first[0], "_t": first[1], "_part": part, "_sum": total, "_tail": at_moment, "_whole": moment == first, "_last_t": moment[1], "_last_key": moment[0], "_next": departure}
        yield pa.RecordBatch.from_arrays([pa.array([facts.get(name)], kind) for name, kind in types.items()], names=list(types))


def hourly_budget(log: DataFrame, *, key: str = "key", ts: str = "ts", max_per_hour: int = MAX_PER_HOUR) -> DataFrame:
    """Per request: demand in the trailing hour (itself included), whether that is over budget, and the
    minutes until the oldest request of the hour leaves the window.

    Every request arrives once and departs an hour later. Demand is what has arrived and not departed; as all departs
    in the end, that is what departs later less what arrives later. So one pass over the changes, ranged over
    the partitions by key and time and sorted backwards, gives it: each partition sums its own changes, the sums of the
    partitions (one row each) are added once, and no row is joined to another. The next departure is that of the oldest request in the hour. A busy key or hour spans
    as many partitions as its rows need. Requests without a time have no demand.

    This counts demand; which requests an exact limiter admits depends on earlier refusals and is the
    stateful `stream_budget`.
    """
    cap, names = min(max_per_hour, MAX_PER_HOUR), [f"_c{i}" for i in range(len(log.columns))]
    plain = log.toDF(*names)
    rows = plain.withColumns({"_t": micros(F.col(names[log.columns.index(ts)])), "_key": F.coalesce(F.col(names[log.columns.index(key)]).cast("string"), F.lit("\0"))})
    known = rows.where("_t is not null")
    arrivals = known.select("_key", "_t", F.lit(1).cast("bigint").alias("_d"), *names)
    departures = known.select("_key", (F.col("_t") + HOUR_US).alias("_t"), F.lit(-1).cast("bigint").alias("_d"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in plain.schema])
    changes = arrivals.union(departures)
    # backwards; of one moment the arrivals first, as departures count before them
    order = [F.desc("_key"), F.desc("_t"), F.desc("_d")]
    ranged = changes.repartitionByRange(*order, F.xxhash64(*names)).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_t", T.LongType()), *plain.schema, *[T.StructField(name, from_arrow_type(kind)) for name, kind in _SCAN.items()]])
    scanned = written(ranged.mapInArrow(_scan_changes, schema), "demand")
    parts = sorted(scanned.where("_sum is not null").select("_part", "_key", "_t", "_sum", "_tail", "_whole", "_last_key", "_last_t", "_next").collect())
    bases, base, began, last, departure = [], 0, 0, None, None
    for p in parts:  # one row per partition
        shared = last == (p["_key"], p["_t"])
        head = began if shared else base
        bases.append((p["_part"], base, head, departure))
        began = head if p["_whole"] and shared else base + p["_tail"]
        base, last, departure = base + p["_sum"], (p["_last_key"], p["_last_t"]), p["_next"] if p["_next"] is not None else departure
    placed = log.sparkSession.createDataFrame(bases, "_part int, _base bigint, _head_base bigint, _carried bigint")
    demand = -(F.col("_later") + F.when(F.col("_head"), F.col("_head_base")).otherwise(F.col("_base")))
    over = F.col("demand") > cap
    found = (
        scanned.where("_sum is null").join(F.broadcast(placed), "_part").withColumn("demand", demand).withColumn("over_budget", over)
        .withColumn("next_slot_min", F.when(over, F.ceil((F.coalesce("_next", "_carried") - F.col("_t")) / 60_000_000)))
        .select(*names, "demand", "over_budget", "next_slot_min")
    )
    untimed = rows.where("_t is null").select(*names, *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema[-3:]])
    return found.union(untimed).toDF(*log.columns, "demand", "over_budget", "next_slot_min")


def spacing_violations(log: DataFrame, *, key: str = "key", ts: str = "ts", min_gap_s: float = 1.5) -> DataFrame:
    """Requests sent less than `min_gap_s` after the previous one of the same key, with the gap.

    Only the gap before a request matters, so a key is cut into blocks of a few gaps, each with the last gap of the
    block before as context.
    """
    gap = int(min_gap_s * 1_000_000)
    rows = _in_blocks(log.withColumn("_us", micros(F.col(ts))), "_us", gap, max(4 * gap, 10_000_000))
    previous = F.lag("_us").over(Window.partitionBy(key, "_block").orderBy("_us", F.col("_own")))
    return (
        rows.withColumn("gap_us", F.col("_us") - previous).where(F.col("_own") & (F.col("gap_us") < gap))
        .drop("_us", "_block", "_own")
    )


def attempt_outcomes(
    log: DataFrame, *, request: str = "request_id", attempt: str = "attempt", status: str = "status",
    retry_after: str = "retry_after", ts: str = "ts", delay_s: float = 2.0, max_retries: int = MAX_RETRIES,
) -> DataFrame:
    """Per logical request: attempts, final status, outcome (ok, http_error, blocked, error) and how many
    retries came earlier than the backoff (2·2^n s) or, where the attempt before named one, its Retry-After
    (at least the delay between requests).

    A null status is a network error: it is retried like a retryable status, and as the last attempt it is
    an error. A Retry-After over the limit blocks a request that still had retries left. Attempts are matched
    to the one before by an equi join on (request, attempt), so no request id has to fit in one task.
    """
    narrow = log.select(request, attempt, status, retry_after, micros(F.col(ts)).alias("_us"))
    retried = F.col(status).isNull() | F.col(status).isin(*RETRY_STATUS)
    asked = F.when(F.col(status).isNotNull(), F.col(retry_after))
    wait = F.when(asked.isNotNull(), F.greatest(asked, F.lit(delay_s))).otherwise(BACKOFF_BASE_S * F.pow(F.lit(2.0), F.col(attempt)))
    before = narrow.where(retried).select(
        request, (F.col(attempt) + 1).alias(attempt), F.col("_us").alias("_prev"), wait.alias("_wait"))
    early = (F.col("_us") - F.col("_prev")) < F.col("_wait") * 1_000_000
    last = F.max_by(F.struct(status, retry_after, attempt), F.col(attempt))
    grouped = narrow.join(before, [request, attempt], "left").groupBy(request).agg(
        F.count("*").alias("attempts"), last.alias("_last"), F.count_if(early).alias("early_retries"))
    final = F.col(f"_last.{status}")
    told_off = (F.col(f"_last.{retry_after}") > RETRY_AFTER_MAX_S) & (F.col(f"_last.{attempt}") < max_retries)
    outcome = (
        F.when(final.isNull(), "error").when(final.isin(*RETRY_STATUS) & told_off, "blocked")
        .when(final.isin(*BLOCK_STATUS), "blocked").when(final.isin(*RETRY_STATUS), "error")
        .when(final >= 400, "http_error").otherwise("ok")
    )
    return grouped.select(request, "attempts", final.alias("final_status"), outcome.alias("outcome"), "early_retries")
