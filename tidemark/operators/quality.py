"""Integrity rules as queries: each returns the violating rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import GRAIN_US, neighbours
from tidemark.operators.temporal import content_differs, current_rows, null_safe_join


def duplicate_current(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Business keys with more than one open revision."""
    return current_rows(df).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent."""
    known = parent.select(F.col(key).alias(foreign)).distinct()
    return child.filter(F.col(foreign).isNotNull()).join(known, foreign, "left_anti")


def polymorphic_orphans(rows: DataFrame, registries: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose (entity_type, internal_id) is in no registry of that type."""
    known = None
    for kind, (registry, key) in registries.items():
        part = registry.select(F.lit(kind).alias("entity_type"), F.col(key).alias("internal_id")).distinct()
        known = part if known is None else known.unionByName(part)
    return rows.join(known, ["entity_type", "internal_id"], "left_anti")


def rewritten(before: DataFrame, after: DataFrame, keys: Sequence[str], frozen: Sequence[str]) -> DataFrame:
    """Keys present in both snapshots whose frozen columns differ."""
    old = before.select(*keys, F.struct(*frozen).alias("old"))
    new = after.select(*keys, F.struct(*frozen).alias("new"))
    return null_safe_join(old, new, keys, "inner").filter(content_differs(F.col("old"), F.col("new")))


def missing_months(observations: DataFrame, at: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Months without observations between the first and last (declared or seen) month."""
    month = F.trunc(F.to_date(F.timestamp_micros(at)), "month")
    seen = observations.select(month.alias("month")).distinct()
    bounds = seen.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    lo = F.lit(first).cast("date") if first else F.col("lo")
    hi = F.lit(last).cast("date") if last else F.col("hi")
    wanted = bounds.select(F.explode(F.sequence(lo, hi, F.expr("interval 1 month"))).alias("month"))
    return wanted.join(seen, "month", "left_anti")


def outside_months(observations: DataFrame, at: str, months: Sequence[str]) -> DataFrame:
    """Rows no declared month partition would take; must stay empty."""
    return observations.filter(~F.date_format(F.timestamp_micros(at), "yyyy-MM").isin(*months))


def inverted(df: DataFrame, start: str = "known_at", end: str = "superseded_at") -> DataFrame:
    """Rows whose interval ends at or before it starts."""
    return df.filter(F.col(end).isNotNull() & (F.col(end) <= F.col(start)))


def overlapping(df: DataFrame, keys: Sequence[str], tiebreak: Sequence[str] = (), grain_us: int = GRAIN_US) -> DataFrame:
    """Revisions still open when the key's next revision begins."""
    out = neighbours(df, keys, ["known_at", *tiebreak], following={"next_known": F.col("known_at")}, grain_us=grain_us)
    return out.filter(
        F.col("next_known").isNotNull() & (F.col("superseded_at").isNull() | (F.col("superseded_at") > F.col("next_known")))
    )


def without_provenance(facts: DataFrame, bodies: DataFrame, body: str = "body_hash") -> DataFrame:
    """Facts lacking a source, a body reference or a knowledge time, or whose body was never archived."""
    bare = facts.filter(F.col("source").isNull() | F.col(body).isNull() | F.col("known_at").isNull()).withColumn(
        "reason", F.lit("incomplete")
    )
    lost = orphans(facts.filter("source IS NOT NULL AND known_at IS NOT NULL"), body, bodies, body).withColumn(
        "reason", F.lit("body not archived")
    )
    return bare.unionByName(lost.select(*bare.columns))


def rule_violations(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per (row, broken rule). A rule is a condition that must not hold; NULL means it cannot be judged."""
    broken = F.filter(
        F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()]), lambda r: r.isNotNull()
    )
    return df.select(*keys, F.explode(broken).alias("rule"))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str], flagged: str) -> DataFrame:
    """Cell-level difference of two pulls of the same scope; `flagged` says whether the second pull admits a change."""

    def cells(df: DataFrame, name: str) -> DataFrame:
        listed = F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(name)) for c in columns
        ])).alias("c")
        extra = [F.col(flagged).alias("flagged")] if name == "new" else []
        return df.select(*keys, *extra, listed).select(*keys, *[c for c in ("flagged",) if extra], "c.*")

    joined = cells(before, "old").join(cells(after, "new"), [*keys, "column"], "full_outer")
    return joined.filter(content_differs(F.col("old"), F.col("new"))).withColumn(
        "flagged", F.coalesce("flagged", F.lit(False))
    )


def manifest_hash(rows: DataFrame, scope: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """One hash per scope over all identity rows, independent of row order.

    Row hashes are added up word by word, which combines before the shuffle,
    and the eight sums are hashed; no task gathers a scope.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in identity])
    digest = rows.select(*scope, F.sha2(text, 256).alias("h"))
    words = [
        F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"w{i}") for i in range(8)
    ]
    sums = digest.select(*scope, *words).groupBy(*scope).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(f"w{i}").cast("decimal(38,0)")).alias(f"w{i}") for i in range(8)]
    )
    joined = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"w{i}").cast("string") for i in range(8)])
    return sums.select(*scope, "rows", F.sha2(joined, 256).alias("manifest"))
