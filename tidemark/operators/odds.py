"""Price ticks and what is derived from them. The model never imports this module."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.operators.ordered import carry_forward, earlier_totals, neighbours, same_key_join
from tidemark.operators.temporal import as_of, content_differs, current_rows

SOLVER_STEPS = 60
# Selections that make a market whole.
MARKET_WIDTH = {"1x2": 3, "over_under": 2, "btts": 2, "asian_handicap": 2}


def _latest(ticks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Last tick per series; ties go to the larger (source, price_kind, price). Combines before the shuffle."""
    row = F.struct("observed_at", "source", "price_kind", "price_c", "is_available")
    return ticks.groupBy(*by).agg(F.max(row).alias("t")).select(*by, "t.*")


def latest_tick_as_of(ticks: DataFrame, at: int) -> DataFrame:
    """Per series the last observed tick that was known and observed by `at`."""
    seen = as_of(ticks, at).filter((F.col("observed_at") <= at) & (F.col("price_kind") == "observed"))
    return _latest(seen, ["series_id"])


def last_before_kickoff(ticks: DataFrame, bound: str = "kickoff") -> DataFrame:
    """Per series the last observed, open tick strictly before `bound` (the kickoff, or the instant play began)."""
    kept = current_rows(ticks).filter((F.col("price_kind") == "observed") & (F.col("observed_at") < F.col(bound)))
    return _latest(kept, ["series_id", bound])


#: What orders ticks of one series at one instant.
TIES = ("source", "price_kind", "event_id")


def price_path(ticks: DataFrame, ties: Sequence[str] = TIES) -> DataFrame:
    """Every tick of a series with its position in time order, ticks of one instant in the order of `ties`.

    Positions come from running counts, not from one long list; only an instant's own ticks are numbered in a window.
    """
    before = earlier_totals(ticks, ["series_id"], "observed_at", {"position": F.lit(1).cast("bigint")})
    place = F.row_number().over(Window.partitionBy("series_id", "observed_at").orderBy(*ties))
    return same_key_join(ticks.withColumn("__place", place), before, ["series_id", "observed_at"]).withColumn("position", F.col("position") + F.col("__place")).drop("__place")


def change_only(ticks: DataFrame, keys: Sequence[str] = ("series_id", "source", "price_kind"), tiebreak: Sequence[str] = ("event_id",)) -> DataFrame:
    """Ticks whose price or availability differs from the series' previous tick."""
    content = F.struct("price_c", "is_available")
    out = neighbours(ticks, list(keys), ["observed_at", *tiebreak], previous={"__prev": content})
    return out.filter(F.col("__prev").isNull() | content_differs(F.col("__prev"), content)).drop("__prev")


def step_price(ticks: DataFrame, instants: DataFrame, ties: Sequence[str] = TIES) -> DataFrame:
    """Price of each series at each asked instant: its last tick carried forward; a suspended tick gives NULL.

    `instants`: series_id, at. Ticks at exactly `at` count; of ticks at one instant the last by `ties` holds.
    """
    state = F.struct("is_available", "price_c")
    rows = ticks.select("series_id", F.col("observed_at").alias("at"), F.lit(0).alias("probe"), *ties, state.alias("state"))
    none = [F.lit(None).cast(rows.schema[t].dataType).alias(t) for t in ties]
    probes = instants.select("series_id", "at", F.lit(1).alias("probe"), *none, F.lit(None).cast(rows.schema["state"].dataType).alias("state"))
    carried = carry_forward(rows.unionByName(probes), ["series_id"], ["at", "probe", *ties], "state", "held")
    return carried.filter("probe = 1").select(
        "series_id", "at", F.when(F.col("held.is_available"), F.col("held.price_c")).alias("price_c"),
        F.col("held").isNotNull().alias("quoted"),
    )


def lay_without_exchange(series: DataFrame, bookmakers: DataFrame) -> DataFrame:
    return series.filter("side = 'lay'").join(bookmakers.filter("kind <> 'exchange'"), "bookmaker_id", "left_semi")


# Expressions over one market's prices as an array of decimal odds.
def raw_probabilities(prices: Column) -> Column:
    return F.transform(prices, lambda d: F.lit(1.0) / d)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def devig_multiplicative(raw: Column, overround: Column) -> Column:
    return F.transform(raw, lambda p: p / overround)


def devig_additive(raw: Column, overround: Column) -> Column:
    return F.transform(raw, lambda p: p - (overround - 1) / F.size(raw))


def _solve(raw: pd.Series, low: float, high: float, total_at) -> pd.Series:
    """Root of a falling total(x) = 1 for every market of a batch at once; short markets are padded with zeros."""
    width = int(raw.map(len).max())
    p = np.stack([np.pad(np.asarray(r, dtype=float), (0, width - len(r))) for r in raw])
    lo, hi = np.full(len(p), low), np.full(len(p), high)
    for _ in range(SOLVER_STEPS):
        mid = (lo + hi) / 2
        above = total_at(p, mid[:, None]).sum(1) > 1
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return pd.Series((lo + hi) / 2, index=raw.index)


@F.pandas_udf(DoubleType())
def power_exponent(raw: pd.Series) -> pd.Series:
    """k with sum(p^k) = 1; the sum falls as k grows."""
    return _solve(raw, 0.01, 50.0, lambda p, k: np.where(p > 0, np.power(p, k), 0.0))


@F.pandas_udf(DoubleType())
def _shin_root(raw: pd.Series) -> pd.Series:
    return _solve(
        raw, 0.0, 0.999999,
        lambda p, z: np.where(p > 0, (np.sqrt(z * z + 4 * (1 - z) * p * p / p.sum(1, keepdims=True)) - z) / (2 * (1 - z)), 0.0),
    )


def devig_power(raw: Column, exponent: Column) -> Column:
    return F.transform(raw, lambda p: F.pow(p, exponent))


def _shin(raw: Column, overround: Column, z: Column) -> Column:
    return F.transform(raw, lambda p: (F.sqrt(z * z + 4 * (1 - z) * p * p / overround) - z) / (2 * (1 - z)))


def shin_share(raw: Column, overround: Column) -> Column:
    """Insider share z in [0, 1) with probabilities summing to 1; NULL without a positive margin."""
    return F.when(overround > 1, _shin_root(raw))


def devig_shin(raw: Column, overround: Column, z: Column) -> Column:
    return F.when(z.isNotNull(), _shin(raw, overround, z))


def consensus(quotes: DataFrame, market: Sequence[str], width: Column, max_age_us: int | None = None, now: Column | None = None) -> DataFrame:
    """Fair probability per selection over books: remove each book's margin, average log-odds, renormalise.

    `quotes`: market keys (exact period, type and line), book, selection, price
    (double), is_available, observed_at. `width` is the number of selections
    that make the market whole. Suspended quotes, stale ones and books without
    the whole market are left out.
    """
    fresh = quotes.filter("is_available AND price IS NOT NULL")
    if max_age_us is not None:
        fresh = fresh.filter(now - F.col("observed_at") <= max_age_us)
    # One shuffle and one sort by market serve all steps: their groups are that order's prefixes, and no lists are built.
    first = Window.partitionBy(*market).orderBy("book", "selection", F.desc("observed_at"), F.desc("price"))
    same = F.col("book").eqNullSafe(F.lag("book").over(first)) & F.col("selection").eqNullSafe(F.lag("selection").over(first))
    # A book's latest quote of a selection stands, so repeated quotes can't pass for a whole market.
    latest = fresh.select(*market, "book", "selection", "observed_at", "price", width.alias("__width")).withColumn(
        "__again", F.lag(F.lit(True)).over(first).isNotNull() & same
    ).filter("NOT __again")
    book = Window.partitionBy(*market, "book")
    fair = latest.select(
        *market, "selection", "price", F.sum(1 / F.col("price")).over(book).alias("__over"),
        F.count(F.lit(1)).over(book).alias("__n"), F.max("__width").over(book).alias("__width"),
    ).filter("__n = __width").select(*market, "selection", (1 / F.col("price") / F.col("__over")).alias("p"))
    odds = fair.groupBy(*market, "selection").agg(
        F.avg(F.ln(F.col("p") / (1 - F.col("p")))).alias("l"), F.count(F.lit(1)).alias("books")
    ).withColumn("p", 1 / (1 + F.exp(-F.col("l"))))
    return odds.select(*market, "selection", "books", (F.col("p") / F.sum("p").over(Window.partitionBy(*market))).alias("p_fair"))


def edge(p_model: Column, p_fair: Column) -> Column:
    return p_model - p_fair


def relative_edge(p_model: Column, p_fair: Column) -> Column:
    return p_model / p_fair - 1


def expected_value(p_model: Column, price: Column, is_exchange: Column, commission: Column) -> Column:
    """Per unit stake; an exchange without a stated commission is refused (NULL)."""
    exchange = p_model * (price - 1) * (1 - commission) - (1 - p_model)
    return F.when(is_exchange, exchange).otherwise(p_model * price - 1)


def kelly(p_model: Column, price: Column) -> Column:
    return (p_model * price - 1) / (price - 1)


def recommended_stake(full_kelly: Column, cap: float) -> Column:
    """A quarter of full Kelly, never negative, never above the cap."""
    return F.least(F.greatest(full_kelly / 4, F.lit(0.0)), F.lit(cap))


def closing_line_value(price_taken: Column, p_close_fair: Column) -> Column:
    return price_taken * p_close_fair - 1
