"""Derived test inputs over the driver tables, as DataFrames and as DuckDB CTEs.

The domain tables (matches, revision log, price ticks, ...) are computed from
the generic tables with integer and string arithmetic only, so both engines
agree exactly. Every view is a plain projection: its size follows its table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.shape import spread
from tidemark.session import prepare

EPOCH_2024 = 1704067200000000
DAY_US = 86400000000
HOUR_US = 3600000000
BOOKS = range(6)
DEVELOPMENT_SEASONS = (1995, 1996, 1997, 1998)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> str:
    return f"unix_micros(CAST({column} AS TIMESTAMP))"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One played match: id, scope, home, away, k (kickoff micros), hg, ag, season."""
    return (
        table(spark, sf_dir, "orders")
        .selectExpr(
            "o_orderkey AS id",
            "o_orderpriority AS scope",
            "CAST(o_custkey % 20 AS INT) AS home",
            "CAST((o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS INT) AS away",
            f"{micros('o_orderdate')} + (o_orderkey % 4) * {HOUR_US} AS k",
            "o_custkey AS c",
            "CAST(year(o_orderdate) AS INT) AS season",
        )
        .selectExpr(
            "id", "scope", "home", "away", "k",
            "CAST((id * 31 + c * 17) % (2 + home % 4) AS INT) AS hg",
            "CAST((id * 13 + c * 7) % (2 + away % 3) AS INT) AS ag",
            "season",
        )
    )


def revlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id % 50 AS INT) AS key_id",
        "event_type AS source",
        "event_id",
        f"{micros('ts')} AS known_at",
        "CAST(floor(value) AS BIGINT) % 3 AS p1",
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = micros("ts")
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "user_id AS series_id",
        "event_type AS source",
        f"{us} AS observed_at",
        f"{us} + (event_id % 7) * {HOUR_US} AS known_at",
        f"CASE WHEN event_id % 13 = 0 THEN {us} + (event_id % 7) * {HOUR_US} + {DAY_US} END AS superseded_at",
        "event_id % 11 <> 0 AS is_available",
        "CASE WHEN event_id % 11 <> 0 THEN 101 + (CAST(floor(value) AS BIGINT) % 5) * 25 END AS price_c",
        "CASE event_id % 4 WHEN 0 THEN 'provider_closing' WHEN 1 THEN 'exchange_sp' ELSE 'observed' END AS price_kind",
        f"{EPOCH_2024} + (user_id % 25 + 3) * {DAY_US} AS kickoff",
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six closing 1X2 quotes per match, prices in cents."""
    b = F.explode(F.array(*[F.lit(i) for i in BOOKS])).alias("book")
    return (
        spread(matches(spark, sf_dir).select("id"), "id")
        .select("id", b)
        .selectExpr(
            "id", "book",
            "120 + (id * 7 + book * 3) % 200 AS home_c",
            "280 + (id * 3 + book) % 120 AS draw_c",
            "150 + (id * 5 + book * 11) % 300 AS away_c",
        )
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    own = nation.selectExpr("lower(n_name) AS alias_norm", "CAST(n_nationkey AS INT) AS team_id", "'A' AS source")
    shared = nation.filter("n_nationkey % 5 = 0").selectExpr(
        "lower(n_name) AS alias_norm", "CAST(100 + n_nationkey AS INT) AS team_id", "CAST(NULL AS STRING) AS source"
    )
    return own.unionByName(shared)


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")

    def part(step: int, base: int) -> DataFrame:
        return nation.filter(f"n_nationkey % {step} = 0").selectExpr(
            "lower(n_name) AS external_id",
            f"CAST({base} + n_nationkey AS INT) AS internal_id",
            f"{EPOCH_2024} AS known_at",
            "CAST(NULL AS BIGINT) AS superseded_at",
        )

    return part(4, 200).unionByName(part(8, 300))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).selectExpr(
        "c_custkey AS ref_id",
        "CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) "
        "WHEN 2 THEN concat('  ', n_name, ' ') ELSE concat(n_name, 'x') END AS name",
    )


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source", "sha2(text, 256) AS body_hash", "length(text) AS n_chars_body",
        f"{EPOCH_2024} + doc_id * {HOUR_US} AS fetched_at",
    )


# The same views as DuckDB SQL. A registered query's SQL twin starts with the
# CTEs it needs; see `with_views`.
SQL_VIEWS = {
    "m": f"""SELECT o_orderkey AS id, o_orderpriority AS scope, CAST(o_custkey % 20 AS INT) AS home,
 CAST((o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS INT) AS away,
 epoch_us(o_orderdate) + (o_orderkey % 4) * {HOUR_US} AS k,
 CAST((o_orderkey * 31 + o_custkey * 17) % (2 + o_custkey % 20 % 4) AS INT) AS hg,
 CAST((o_orderkey * 13 + o_custkey * 7) % (2 + (o_custkey % 20 + 1 + o_orderkey % 19) % 20 % 3) AS INT) AS ag,
 CAST(year(o_orderdate) AS INT) AS season FROM orders""",
    "revlog": """SELECT CAST(user_id % 50 AS INT) AS key_id, event_type AS source, event_id,
 epoch_us(ts) AS known_at, CAST(floor(value) AS BIGINT) % 3 AS p1 FROM events""",
    "rev": """SELECT key_id, source, p1, known_at,
 lead(known_at) OVER (PARTITION BY key_id, source ORDER BY known_at, event_id) AS superseded_at
 FROM (SELECT *, lag(p1) OVER (PARTITION BY key_id, source ORDER BY known_at, event_id) AS prev FROM revlog) t
 WHERE prev IS NULL OR prev <> p1""",
    "ticks": f"""SELECT event_id, user_id AS series_id, event_type AS source, epoch_us(ts) AS observed_at,
 epoch_us(ts) + (event_id % 7) * {HOUR_US} AS known_at,
 CASE WHEN event_id % 13 = 0 THEN epoch_us(ts) + (event_id % 7) * {HOUR_US} + {DAY_US} END AS superseded_at,
 event_id % 11 <> 0 AS is_available,
 CASE WHEN event_id % 11 <> 0 THEN 101 + (CAST(floor(value) AS BIGINT) % 5) * 25 END AS price_c,
 CASE event_id % 4 WHEN 0 THEN 'provider_closing' WHEN 1 THEN 'exchange_sp' ELSE 'observed' END AS price_kind,
 {EPOCH_2024} + (user_id % 25 + 3) * {DAY_US} AS kickoff FROM events""",
    "books": """SELECT m.id, b.b AS book, 120 + (m.id * 7 + b.b * 3) % 200 AS home_c,
 280 + (m.id * 3 + b.b) % 120 AS draw_c, 150 + (m.id * 5 + b.b * 11) % 300 AS away_c
 FROM m CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5)) AS b(b)""",
    "aliases": """SELECT lower(n_name) AS alias_norm, CAST(n_nationkey AS INT) AS team_id, 'A' AS source FROM nation
 UNION ALL SELECT lower(n_name), CAST(100 + n_nationkey AS INT), CAST(NULL AS VARCHAR) FROM nation
 WHERE n_nationkey % 5 = 0""",
    "mappings": f"""SELECT lower(n_name) AS external_id, CAST(200 + n_nationkey AS INT) AS internal_id,
 {EPOCH_2024} AS known_at, CAST(NULL AS BIGINT) AS superseded_at FROM nation WHERE n_nationkey % 4 = 0
 UNION ALL SELECT lower(n_name), CAST(300 + n_nationkey AS INT), {EPOCH_2024}, CAST(NULL AS BIGINT)
 FROM nation WHERE n_nationkey % 8 = 0""",
    "refs": """SELECT c_custkey AS ref_id, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name)
 WHEN 2 THEN concat('  ', n_name, ' ') ELSE concat(n_name, 'x') END AS name
 FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "bodies": f"""SELECT doc_id, source, sha256(text) AS body_hash, length(text) AS n_chars_body,
 {EPOCH_2024} + doc_id * {HOUR_US} AS fetched_at FROM documents""",
}

_NEEDS = {"rev": ("revlog",), "books": ("m",)}


def with_views(names: Iterable[str], body: str) -> str:
    """Prefix `body` with the CTEs it reads; `body` may itself start with more CTEs after '+'."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = [f"{name} AS ({SQL_VIEWS[name]})" for name in ordered]
    body = body.strip()
    start = "WITH RECURSIVE " if re.search(r"\bFROM it\b", body) else "WITH "
    if body.startswith("+"):
        return start + ",\n".join(ctes) + ",\n" + body[1:].strip()
    return start + ",\n".join(ctes) + "\n" + body
