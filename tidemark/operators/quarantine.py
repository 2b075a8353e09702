"""Quarantine of a batch as a closure: a refused row takes along the rows that refer to it, and those that refer to them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import same_key_join
from tidemark.session import ensure_checkpoint_dir


class Reference(NamedTuple):
    """Rows of `child` refer by `column` to the `key` of `parent`, which may be the same table."""

    child: str
    column: str
    parent: str


def closure(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], refused: Mapping[str, DataFrame], references: Sequence[Reference]) -> dict[str, DataFrame]:
    """Per table the keys that must not pass: its key columns, hops (0 for a row refused itself) and reason.

    `refused` has key columns and `rule`; of several rules of a row the smallest stands. A parent has one key column. Rounds
    go on until none adds a row; each touches only what the round before added. References may form circles; a NULL
    reference refers to nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    ensure_checkpoint_dir(spark)
    held: dict[str, DataFrame] = {}
    fresh: dict[str, DataFrame] = {}
    for name in tables:
        if name in refused:
            own = refused[name].groupBy(*keys[name]).agg(F.min("rule").alias("reason"))
            held[name] = fresh[name] = same_key_join(own, tables[name].select(*keys[name]).distinct(), keys[name], "left_semi").select(*keys[name], F.lit(0).alias("hops"), "reason").checkpoint()
    hops = 0
    while fresh:
        hops += 1
        added: dict[str, DataFrame] = {}
        for child, column, parent in references:
            if parent not in fresh:
                continue
            gone = fresh[parent].select(F.col(keys[parent][0]).alias("_gone"))
            rows = tables[child].join(gone, F.col(column) == F.col("_gone"), "left_semi").select(*keys[child], F.lit(hops).alias("hops"), F.lit(f"{parent} refused").alias("reason"))
            added[child] = rows if child not in added else added[child].unionByName(rows)
        fresh = {}
        for child, rows in added.items():
            rows = rows.groupBy(*keys[child], "hops").agg(F.min("reason").alias("reason")).select(*keys[child], "hops", "reason")
            if child in held:
                rows = same_key_join(rows, held[child].select(*keys[child]), keys[child], "left_anti")
            rows = rows.checkpoint()
            if not rows.isEmpty():
                fresh[child] = rows
                held[child] = rows if child not in held else held[child].unionByName(rows)
    return held


def split(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], held: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Accepted and quarantined rows of every table; together they are the batch. Quarantined rows tell hops and reason."""
    accepted, kept_back = {}, {}
    for name, df in tables.items():
        if name in held:
            accepted[name] = same_key_join(df, held[name].select(*keys[name]), keys[name], "left_anti")
            kept_back[name] = same_key_join(df, held[name], keys[name])
        else:
            accepted[name], kept_back[name] = df, df.limit(0).select("*", F.lit(0).alias("hops"), F.lit("").alias("reason"))
    return accepted, kept_back


def write(accepted: Mapping[str, DataFrame], kept_back: Mapping[str, DataFrame], root: str) -> None:
    """Both halves as tables: `root`/accepted/<name> and `root`/quarantine/<name>."""
    for half, parts in (("accepted", accepted), ("quarantine", kept_back)):
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(f"{root}/{half}/{name}")
