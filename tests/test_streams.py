"""Streams over several runs: late and tied ticks, bounded state, duplicates beyond the watermark."""

import random

from pyspark.sql import functions as F

from tidemark.operators import odds
from tidemark.streaming import batches, changes

HOUR = 3_600_000_000
SCHEMA = "series string, event bigint, observed_at bigint, price bigint, open boolean, part bigint"


def ticks(rng, n):
    """Ticks that come up to five hours late, many at one instant, some alike."""
    rows = []
    for i in range(n):
        at = rng.randrange(240) * HOUR // 2
        price = None if i % 7 == 0 else rng.randrange(3) + (1 << 60)
        rows.append((f"s{rng.randrange(4)}", i, at, price, price is not None, (at + rng.randrange(6) * HOUR) // (24 * HOUR)))
    return rows


def test_changes_are_corrected_over_runs(spark, folder):
    """After every run the changes that stand are those of the batch operator over what has come, and state stays small."""
    changes.prepare(spark)
    rows = ticks(random.Random(1), 400)
    df = spark.createDataFrame(rows, SCHEMA)
    progress, corrected = [], 0
    for i, path in enumerate(batches.arrivals(df, "part", folder)):
        stream = batches.read_stream(spark, path, df.drop("part").schema)
        told = changes.change_only(stream, ["series"], "observed_at", "event", ["price", "open"], "8 hours")
        progress += batches.write_available(told, folder)
        out = spark.read.parquet(folder + "/out")
        come = df.filter(F.col("part") <= i).selectExpr("series AS series_id", "event AS event_id", "observed_at", "price AS price_c", "open AS is_available")
        want = odds.change_only(come, ["series_id"], ["event_id"])
        assert sorted((r.event, r.price) for r in changes.stands(out, "event", "price", "open").collect()) == sorted((r.event_id, r.price_c) for r in want.collect())
        corrected = out.filter("change = -1").count()
    assert i >= 4 and corrected > 0
    state = [op["numRowsTotal"] for p in progress for op in p["stateOperators"]]
    dropped = sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
    assert dropped == 0 and state[-1] < 150 and max(state[len(state) // 2 :]) <= 2 * max(state[: len(state) // 2]) + 20


def test_settling_keeps_what_later_ticks_need():
    ticks = [(1, 0, "a", False), (1, 1, "b", False), (5, 0, "b", False), (9, 0, "a", False)]
    assert changes.settle(ticks, 5) == [(5, 0, "b", True), (9, 0, "a", False)] and changes.settle(ticks, 0) == ticks
    kept = changes.settle(ticks, 5)
    merged, told = changes.corrections(kept, [(7, 0, "a", False), (7, 1, "a", False)])
    assert told == [(9, 0, "a", -1), (7, 0, "a", 1)] and len(merged) == 4
    assert changes.corrections([], [(3, 2, "x", False), (3, 1, "y", False)])[1] == [(3, 1, "y", 1), (3, 2, "x", 1)]
    assert changes.corrections([], []) == ([], [])


def test_bodies_once_for_ever(spark, folder):
    """Copies inside a batch, inside the watermark and far beyond it; a state store that forgets the old ones."""
    rng = random.Random(2)
    rows = [(f"h{rng.randrange(60)}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "body_hash string, i bigint").select("body_hash", F.timestamp_micros(F.col("i") * HOUR).alias("fetched_at"), F.floor(F.col("i") / 60).alias("part"))
    for path in batches.arrivals(df, "part", folder):
        batches.dedup_bodies(batches.read_stream(spark, path, df.drop("part").schema), folder, "5 hours")
    out = spark.read.parquet(folder + "/out")
    assert out.count() == out.select("body_hash").distinct().count() == df.select("body_hash").distinct().count()
    assert out.select("batch").distinct().count() > 2
    empty = df.limit(0)
    assert list(batches.arrivals(empty, "part", folder + "/none")) == []


def test_late_rows_are_counted_behind_the_delay(spark, folder):
    rows = [(0, 10 * HOUR), (0, 2 * HOUR), (1, 9 * HOUR), (1, 7 * HOUR), (1, 30 * HOUR), (2, 28 * HOUR), (2, 27 * HOUR - 1)]
    df = spark.createDataFrame(rows, "part bigint, at bigint")
    for path in batches.arrivals(df, "part", folder):
        batches.run_available(batches.read_stream(spark, path, df.drop("part").schema), folder, batches.late_rows_step("at", 24 * HOUR, 2 * HOUR))
    got = {r.window // (24 * HOUR): (r.on_time, r.late) for r in batches.output(spark, folder).groupBy("window").agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late")).collect()}
    assert got == {0: (3, 1), 1: (2, 1)}


def test_series_of_a_group_share_state_but_not_ticks(spark, folder):
    """200 series in 3 groups over several runs: the batch operator's changes, and no more stored lists than groups."""
    changes.prepare(spark)
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(200)}", rng.randrange(2), i, (1 + rng.randrange(96)) * HOUR, rng.randrange(2)) for i in range(1500)]
    df = spark.createDataFrame(rows, "series string, side int, event bigint, observed_at bigint, price bigint")
    for path in batches.arrivals(df.withColumn("part", F.floor(F.col("observed_at") / (32 * HOUR))), "part", folder):
        stream = batches.read_stream(spark, path, df.schema)
        told = changes.change_only(stream, ["series", "side"], "observed_at", "event", ["price"], "8 hours", groups=3)
        batches.write_available(told, folder)
    got = changes.stands(spark.read.parquet(folder + "/out"), "series", "side", "event", "price").collect()
    series = F.struct("series", "side").alias("series_id")
    want = odds.change_only(df.select(series, "side", "series", "observed_at", F.col("event").alias("event_id"), F.col("price").alias("price_c"), F.lit(True).alias("is_available")), ["series_id"], ["event_id"])
    assert sorted(map(tuple, got)) == sorted((r.series, r.side, r.event_id, r.price_c) for r in want.collect())
    kept = spark.read.format("statestore").option("stateVarName", "ticks").load(folder + "/checkpoint")
    assert len({r["key"]["_group"] for r in kept.select("key").collect()}) == 3
