"""Bitemporal reads and writes.

A revision is visible from `known_at` (inclusive) to `superseded_at`
(exclusive). The rule is written here only, as text and as a column; everything
else calls it.
Writes never change a payload: a revision is closed at its successor's
`known_at`, so exactly one revision of a key is visible at every instant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import GRAIN_US, neighbours, same_key_join


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# The single definition of visibility, over the names known_at, superseded_at and cutoff.
VISIBLE_SQL = "known_at <= cutoff AND (superseded_at IS NULL OR superseded_at > cutoff)"


def visible_at(known: Column | str, superseded: Column | str, cutoff: Column | int) -> Column:
    """VISIBLE_SQL for DataFrame columns. A NULL cutoff keeps nothing."""
    cutoff = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    known, superseded = _column(known), _column(superseded)
    return (known <= cutoff) & (superseded.isNull() | (superseded > cutoff))


def as_of(df: DataFrame, cutoff: Column | int) -> DataFrame:
    """Rows as they stood at `cutoff`. A plain filter, so it reaches the scan."""
    return df.filter(visible_at("known_at", "superseded_at", cutoff))


def current_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("superseded_at").isNull())


def as_of_many(df: DataFrame, cutoffs: Sequence[int], name: str = "cutoff") -> DataFrame:
    """One pass over the table for a short list of cutoffs: each row is repeated per cutoff that sees it."""
    listed = F.array(*[F.lit(int(c)) for c in cutoffs])
    seen = F.filter(listed, lambda c: visible_at("known_at", "superseded_at", c))
    return df.select("*", F.explode(seen).alias(name))


def payload(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def content_differs(left: Column, right: Column) -> Column:
    """NULL-safe inequality of two payloads."""
    return ~left.eqNullSafe(right)


null_safe_join = same_key_join


def history_from_log(
    log: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    tiebreak: Sequence[str] = (),
    grain_us: int | None = GRAIN_US,
) -> DataFrame:
    """Turn an append log into revisions with half-open intervals, dropping repeats.

    Of several rows of a key at one instant the last by `tiebreak` stands. No task holds a key, however many rows it has.
    Where every key has few rows, `grain_us=None` orders them with one shuffle by key, or none where they lie so already.
    """
    others = [c for c in log.columns if c not in keys and c != "known_at"]
    if grain_us is None:
        return _chained(log, keys, columns, tiebreak or others)
    last = F.max_by(F.struct(*others), F.struct(*tiebreak)) if tiebreak else F.max(F.struct(*others))
    standing = log.groupBy(*keys, "known_at").agg(last.alias("__r")).select(*keys, "known_at", "__r.*").select(*log.columns)
    changed = neighbours(standing, keys, ["known_at"], previous={"__prev": payload(columns)}, grain_us=grain_us).filter(
        F.col("__prev").isNull() | content_differs(F.col("__prev"), payload(columns))
    )
    return neighbours(changed.drop("__prev"), keys, ["known_at"], following={"superseded_at": F.col("known_at")}, grain_us=grain_us)


def _chained(log: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of a log that change their key's content, each closed by the next; one sort of each key's rows."""
    ordered = Window.partitionBy(*keys).orderBy("known_at", *order)
    # Of several rows of an instant the last stands.
    standing = log.select("*", F.lead(F.struct("known_at")).over(ordered).alias("__next")).filter("__next IS NULL OR NOT (__next.known_at <=> known_at)")
    changed = standing.drop("__next").select("*", F.lag(payload(columns)).over(ordered).alias("__prev")).filter(
        F.col("__prev").isNull() | content_differs(F.col("__prev"), payload(columns))
    )
    return changed.drop("__prev").select("*", F.lead("known_at").over(ordered).alias("superseded_at"))


def compare_revisions(
    table: DataFrame, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Match the open revision of each key with at most one incoming row of the key.

    Columns: `old`, `new` (structs, either may be NULL) and `outcome`, one of
    kept, created, unchanged, revised, late. `late` marks a differing row that
    is not newer than the open revision; it would invert an interval.
    """
    names = [*keys, *columns, "known_at"]
    old = current_rows(table).select(*keys, F.struct(*names).alias("old"))
    new = incoming.select(*keys, F.struct(*names).alias("new"))
    joined = null_safe_join(old, new, keys, "full_outer")
    same = F.lit(True)
    for column in columns:
        same = same & F.col(f"old.{column}").eqNullSafe(F.col(f"new.{column}"))
    outcome = (
        F.when(F.col("new").isNull(), "kept")
        .when(F.col("old").isNull(), "created")
        .when(same, "unchanged")
        .when(F.col("new.known_at") <= F.col("old.known_at"), "late")
        .otherwise("revised")
    )
    return joined.select("old", "new", outcome.alias("outcome"))


def _chain_by_key(both: DataFrame, keys: Sequence[str], columns: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """What `revise` keeps of open (`__open`) and incoming rows, by one shuffle and one sort of each key's rows."""
    others = tiebreak or [c for c in both.columns if c not in (*keys, "known_at", "__open")]
    since = F.max(F.when(F.col("__open"), F.col("known_at"))).over(Window.partitionBy(*keys))
    log = both.select("*", since.alias("__since")).filter("__open OR __since IS NULL OR known_at > __since")
    return _chained(log, keys, columns, others)


def revise(
    table: DataFrame, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str], tiebreak: Sequence[str] = (),
    grain_us: int | None = GRAIN_US,
) -> DataFrame:
    """The table after one batch: equal content writes nothing, a difference closes and opens.

    A key may come several times; its rows are chained in time after the open
    revision, the last by `tiebreak` standing for an instant. Rows that are not
    newer than the open revision change nothing; `refused` lists them. Closed
    revisions pass by; no task holds a key, however many rows it has. Where
    every key has few rows, `grain_us=None` orders them with one shuffle by key.
    """
    names = [*keys, *columns, "known_at"]
    kind = table.schema["superseded_at"].dataType
    last = [F.lit(None).cast(incoming.schema[t].dataType).alias(t) for t in tiebreak]
    both = current_rows(table).select(*names, *last, F.lit(True).alias("__open")).unionByName(
        incoming.select(*names, *tiebreak, F.lit(False).alias("__open"))
    )
    if grain_us is None:
        chain = _chain_by_key(both, keys, columns, tiebreak)
    else:
        since = current_rows(table).groupBy(*keys).agg(F.max("known_at").alias("__since"))
        log = null_safe_join(both, since, keys, "left").filter("__open OR __since IS NULL OR known_at > __since").drop("__open", "__since")
        chain = history_from_log(log, keys, columns, tiebreak, grain_us)
    closed = table.filter(F.col("superseded_at").isNotNull()).select(*names, "superseded_at")
    return closed.unionByName(chain.select(*names, F.col("superseded_at").cast(kind).alias("superseded_at")))


def refused(table: DataFrame, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of the batch that differ from the open revision of their key without being newer than it."""
    current = current_rows(table).select(*keys, F.struct(*columns).alias("__old"), F.col("known_at").alias("__since"))
    late = null_safe_join(incoming, current, keys, "inner").filter("known_at <= __since")
    return late.filter(content_differs(F.col("__old"), payload(columns))).drop("__old", "__since")


def retract(table: DataFrame, mistakes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Close the open revision of each listed key at `retracted_at`, without a successor."""
    marks = mistakes.select(*keys, F.col("retracted_at").alias("__at"))
    joined = null_safe_join(table, marks, keys, "left")
    closes = F.col("superseded_at").isNull() & (F.col("__at") > F.col("known_at"))
    return joined.select(
        *[c for c in table.columns if c != "superseded_at"],
        F.when(closes, F.col("__at")).otherwise(F.col("superseded_at")).alias("superseded_at"),
    )


def insert_absent(table: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `incoming` whose key the table lacks, one per key, NULL key parts matching each other.

    Of several rows of a key the smallest by the other columns, in their order, stands.
    """
    others = [c for c in incoming.columns if c not in keys]
    row = F.struct(*others) if others else F.lit(True)
    # Stored keys and incoming rows meet in one aggregate, which combines them before its shuffle.
    both = incoming.select(*keys, row.alias("__r"), F.lit(False).alias("__known"))
    known = table.select(*keys, F.lit(None).cast(both.schema["__r"].dataType).alias("__r"), F.lit(True).alias("__known"))
    fresh = both.unionByName(known).groupBy(*keys).agg(F.min("__r").alias("__r"), F.max("__known").alias("__known")).filter("NOT __known")
    return fresh.select(*keys, *(["__r.*"] if others else [])).select(*incoming.columns)


def surrogate_id(keys: Sequence[str]) -> Column:
    """A reproducible id from the natural key; NULL parts are marked so they differ from empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("~")) for k in keys]
    return F.sha2(F.concat_ws("/", *parts), 256)


def valid_on(valid_from: Column | str, valid_to: Column | str, day: Column | str) -> Column:
    """Half-open valid time: from <= day < to, an open end never ends."""
    valid_from, valid_to, day = _column(valid_from), _column(valid_to), _column(day)
    return (valid_from <= day) & (valid_to.isNull() | (valid_to > day))
