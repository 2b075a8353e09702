"""Registered queries: streaming forms, run over the whole tables with everything available now."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.plans.views import DAY_US, HOUR_US
from tidemark.session import shared_dir
from tidemark.streaming import batches, changes


def _stream(spark, sf_dir, table: str):
    schema = views.table(spark, sf_dir, table).schema
    return batches.read_stream(spark, f"{sf_dir}/{table}.parquet*", schema)


def _root(spark, name: str) -> str:
    return f"{shared_dir(spark)}/stream/{name}-{uuid.uuid4().hex}"


#: Arrivals come in slices of so long; each is one run of a stream, continued at its checkpoint.
SLICE_US = 8 * DAY_US


def _slice(arrives: str) -> Column:
    return F.floor((F.col(arrives) - views.EPOCH_2024) / SLICE_US)


@query("stream_dedup_bodies", ["bodies"], "SELECT body_hash, count(*) AS rows, min(fetched_at) AS first_fetched FROM (SELECT body_hash, min(fetched_at) AS fetched_at FROM bodies GROUP BY body_hash) GROUP BY body_hash")
def stream_dedup_bodies(spark, sf_dir):
    """Each body once over several runs, copies lying far beyond the watermark of two days."""
    bodies = views.bodies(spark, sf_dir).select("body_hash", F.timestamp_micros("fetched_at").alias("fetched_at"), "doc_id")
    span = bodies.agg(F.max("doc_id")).first()[0] or 0
    root = _root(spark, "dedup")
    for folder in batches.arrivals(bodies.withColumn("part", F.floor(F.col("doc_id") * 4 / (span + 1))), "part", root):
        batches.dedup_bodies(batches.read_stream(spark, folder, bodies.schema), root, "2 days")
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("body_hash").agg(F.count(F.lit(1)).alias("rows"), F.unix_micros(F.min("fetched_at")).alias("first_fetched"))


@query("stream_change_only", ["ticks"], """SELECT event_id, price_c, is_available FROM (SELECT *, row_number() OVER w AS i, lag(price_c) OVER w AS pp, lag(is_available) OVER w AS pa FROM ticks
 WINDOW w AS (PARTITION BY series_id, source, price_kind ORDER BY observed_at, event_id))
 WHERE i = 1 OR price_c IS DISTINCT FROM pp OR is_available IS DISTINCT FROM pa""")
def stream_change_only(spark, sf_dir):
    """Ticks in the order they became known, up to six hours late, over several runs of one stateful processor."""
    changes.prepare(spark)
    ticks = views.ticks(spark, sf_dir).select("series_id", "source", "price_kind", "observed_at", "event_id", "price_c", "is_available", "known_at")
    root = _root(spark, "changes")
    for folder in batches.arrivals(ticks.withColumn("part", _slice("known_at")), "part", root):
        stream = batches.read_stream(spark, folder, ticks.schema)
        told = changes.change_only(stream, ["series_id", "source", "price_kind"], "observed_at", "event_id", ["price_c", "is_available"], "12 hours")
        batches.write_available(told, root)
    return changes.stands(spark.read.parquet(f"{root}/out"), "event_id", "price_c", "is_available")


@query("stream_revise", ["rev"], "SELECT key_id, source, p1, known_at, superseded_at FROM rev")
def stream_revise(spark, sf_dir):
    """Closed revisions emitted by the stream, and the open ones its state holds."""
    log = _stream(spark, sf_dir, "events").selectExpr(
        "CAST(user_id % 50 AS INT) AS key_id", "event_type AS source", "event_id", f"{views.micros('ts')} AS known_at",
        "CAST(floor(value) AS BIGINT) % 3 AS p1",
    )
    root = _root(spark, "revisions")
    last = batches.run_available(log, root, batches.revise_step(["key_id", "source"], ["p1"], ["event_id"]))
    names = ["key_id", "source", "p1", "known_at"]
    open_rows = batches.state(spark, root, last).select(*names, F.lit(None).cast("bigint").alias("superseded_at"))
    return batches.output(spark, root).select(*names, "superseded_at").unionByName(open_rows)


#: How far the late-data watermark lies behind the newest instant.
DELAY_US = 2 * HOUR_US


@query("stream_late_data", ["ticks"], f"""+ cut AS (SELECT observed_at AS o, (known_at - {views.EPOCH_2024}) // {SLICE_US} AS slice FROM ticks),
 newest AS (SELECT slice, max(max(o)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM cut GROUP BY slice)
 SELECT o // {DAY_US} * {DAY_US} AS "window", count(*) FILTER (mark IS NULL OR o >= mark - {DELAY_US}) AS on_time, count(*) FILTER (o < mark - {DELAY_US}) AS late
 FROM cut JOIN newest USING (slice) GROUP BY 1""")
def stream_late_data(spark, sf_dir):
    """Ticks per day, on time or behind the watermark that earlier runs left."""
    ticks = views.ticks(spark, sf_dir).select("event_id", F.col("observed_at").alias("at"), "known_at")
    root = _root(spark, "late")
    for folder in batches.arrivals(ticks.withColumn("part", _slice("known_at")), "part", root):
        batches.run_available(batches.read_stream(spark, folder, ticks.schema), root, batches.late_rows_step("at", DAY_US, DELAY_US))
    return batches.output(spark, root).groupBy("window").agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))
