"""Change-only ticks of a stream, corrected when a late tick changes what its neighbours are compared with.

The state of a series is the ticks the watermark has not passed yet and the last one it has, so it holds no more than the
watermark's delay of history. A tick is compared with the one before it as soon as it comes. A late one that lands between
two others may be a change itself and may make or unmake its successor's change: both are told, as `change` 1 and -1. The
sum over a tick's rows says whether it stands. Ticks behind the watermark are left out by Spark and counted in its progress.

Series are dealt by a hash over `GROUPS` groups, and a group's series share one state list and one timer: a call into the
state store costs the same for one series as for hundreds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TICK = "at bigint, tie bigint, content string, settled boolean"

Tick = tuple[int, int, str, bool]


def settle(ticks: list[Tick], watermark_us: int) -> list[Tick]:
    """Ticks in order, those the watermark has passed replaced by the last of them."""
    passed = [t for t in ticks if t[0] <= watermark_us]
    return [(*t[:3], True) for t in passed[-1:]] + ticks[len(passed) :]


def standing(ticks: list[Tick]) -> dict[tuple[int, int], str]:
    """Instant, tie and content of the open ticks that differ from the one before them."""
    return {t[:2]: t[2] for before, t in zip([None, *ticks], ticks) if not t[3] and (before is None or before[2] != t[2])}


def corrections(ticks: list[Tick], fresh: list[Tick]) -> tuple[list[Tick], list[tuple[int, int, str, int]]]:
    """All ticks in order, and what the fresh ones change: (at, tie, content, 1 or -1)."""
    merged = sorted([*ticks, *fresh], key=lambda t: t[:2])
    was, now = standing(ticks), standing(merged)
    gone = [(*k, was[k], -1) for k in was if k not in now]
    return merged, gone + [(*k, now[k], 1) for k in now if k not in was]


#: Groups of series that share a state list. A stream's checkpoint is tied to it.
GROUPS = 2048


class ChangeOnly(StatefulProcessor):
    """One group of series: `keys` tell them apart, `kinds` are the keys' types as DDL."""

    def __init__(self, keys: Sequence[str], kinds: str):
        self.keys, self.kinds = list(keys), kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ticks = handle.getListState("ticks", f"{self.kinds}, {_TICK}")

    def _held(self) -> dict[tuple, list[Tick]]:
        held: dict[tuple, list[Tick]] = {}
        for row in self.ticks.get() if self.ticks.exists() else ():
            *series, at, tie, content, settled = row
            held.setdefault(tuple(series), []).append((int(at), int(tie), content, bool(settled)))
        return held

    def _keep(self, held: dict[tuple, list[Tick]], watermark_us: int) -> int | None:
        """Store what later ticks need; the newest instant the watermark has not passed."""
        kept = {series: settle(ticks, watermark_us) for series, ticks in held.items()}
        self.ticks.put([(*series, *t) for series, ticks in kept.items() for t in ticks])
        return max((ticks[-1][0] for ticks in kept.values() if not ticks[-1][3]), default=None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh: dict[tuple, list[Tick]] = {}
        for part in rows:
            series = zip(*[part[k].tolist() for k in self.keys])
            for s, a, t, c in zip(series, part["at"].tolist(), part["tie"].tolist(), part["content"].tolist()):
                fresh.setdefault(s, []).append((a, t, c, False))
        held, told = self._held(), []
        for s, ticks in fresh.items():
            held[s], changed = corrections(held.get(s, []), ticks)
            told += [(*s, *c) for c in changed]
        newest = self._keep(held, timerValues.getCurrentWatermarkInMs() * 1000)
        if newest is not None:  # come back when the watermark has passed all of them
            self.handle.registerTimer(newest // 1000 + 1)
        yield self._rows(told)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.ticks.exists():
            self._keep(self._held(), timerValues.getCurrentWatermarkInMs() * 1000)
        yield self._rows([])

    def _rows(self, told: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(told, columns=[*self.keys, "at", "tie", "content", "change"])
        return out.astype({"at": "int64", "tie": "int64", "content": "object", "change": "int64"})


def change_only(
    ticks: DataFrame, keys: Sequence[str], at: str, tie: str, columns: Sequence[str], delay: str, groups: int = GROUPS
) -> DataFrame:
    """A stream of ticks as a stream of changes: keys, `at`, `tie`, columns and change (1 or -1).

    `at` is a bigint of microseconds, `tie` a bigint that orders ticks of one instant. Keys must not be NULL. The session must
    use the store of `prepare`. `groups`, the number of state lists, must stay the same over a stream's runs.
    """
    content = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    group = F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group")
    rows = ticks.select(group, *keys, F.col(at).alias("at"), F.col(tie).alias("tie"), content.alias("content"), F.timestamp_micros(at).alias("_instant")).withWatermark("_instant", delay)
    kinds = ", ".join(f"{k} {ticks.schema[k].dataType.simpleString()}" for k in keys)
    out = rows.groupBy("_group").transformWithStateInPandas(
        statefulProcessor=ChangeOnly(keys, kinds), outputStructType=f"{kinds}, at bigint, tie bigint, content string, change bigint", outputMode="Append", timeMode="EventTime",
    )
    kind = ", ".join(f"{c} {ticks.schema[c].dataType.simpleString()}" for c in columns)
    back = F.from_json("content", kind)
    return out.withColumn("_c", back).select(*keys, F.col("at").alias(at), F.col("tie").alias(tie), "_c.*", "change")


def prepare(spark: SparkSession) -> None:
    """Let stateful processors keep their state on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def stands(changes: DataFrame, *by: str) -> DataFrame:
    """The changes that stand after all corrections, one row each."""
    return changes.groupBy(*by).agg(F.sum("change").alias("change")).filter("change = 1").drop("change")
