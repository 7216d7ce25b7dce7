import random

from pyspark.sql import functions as F

from vacantia.streaming import jobs as J


def test_admission_does_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, i * 120 + rng.randrange(100)) for i in range(120)]
    end = ("z", 999, 120 * 120 + 200_000)  # moves the watermark past all others
    dealt = rows[:]
    rng.shuffle(dealt)
    for part in range(6):  # unordered files
        chunk = dealt[part::6] + ([end] if part == 5 else [])
        spark.createDataFrame(chunk, "key string, request_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in.parquet"))
    results = []
    for n, block in ((1, 7), (2, J.BLOCK), (64, 3), (64, J.BLOCK)):  # small blocks are split, and settled in part
        stream = J.read_stream(spark, str(tmp_path), "in", files_per_batch=n)
        results.append({r.request_id: r for r in J.run_available(J.stream_budget(stream, max_per_hour=5, late="1 day", block=block)).collect()})
    got = results[-1]
    assert got.keys() == {r[1] for r in rows}
    assert all(result.keys() == got.keys() and all(tuple(result[i]) == tuple(got[i]) for i in got) for result in results)
    admitted = {"a": [], "b": []}
    for key, i, s in sorted(rows, key=lambda r: (r[2], r[1])):
        recent = [t for t in admitted[key] if t > s - 3600]
        ok = len(recent) < 5
        assert got[i].admitted == ok, i
        if ok:
            admitted[key].append(s)
        else:
            assert got[i].next_slot_min == -(-(recent[0] + 3600 - s) // 60)


def test_first_card_wins_whatever_arrives_first(spark, tmp_path):
    rows = [("a", 60, 2), ("a", 0, 1), ("b", 700, 5), ("b", 800, 4), ("z", 400_000, 9)]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], "slug string, s bigint, pos int").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in.parquet"))
    stream = J.read_stream(spark, str(tmp_path), "in", files_per_batch=1)
    got = J.run_available(J.stream_offers(stream, order=["pos"], late="1 day")).collect()
    assert sorted((r.slug, r.pos) for r in got) == [("a", 1), ("b", 4)]


def test_dedupe_and_stats(spark, tmp_path):
    rows = [("a", 0, True, "ok"), ("a", 60, False, "ok"), ("b", 700, True, "error"), ("c", 5000, True, "ok")]
    spark.createDataFrame(rows, "slug string, s bigint, new boolean, outcome string").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("slug string, s bigint, new boolean, outcome string, ts timestamp").parquet(str(tmp_path / "in"))
    stats = J.run_available(J.stream_page_stats(stream)).orderBy("bucket_start").collect()
    assert [(r.cards, r.new, r.errors) for r in stats] == [(2, 1, 0), (1, 1, 1)]
