"""Score distributions as column expressions.

A fixture's two goal rates give two truncated Poisson marginals; every market
is a sum over their outer product. The sums are written over the marginals, so
a market costs tens of multiplications and no 256-cell array unless one is stored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They must agree with stored predictions.
MAX_GOALS = 15
MIN_LAMBDA = 1e-6
MAX_LAMBDA = 15.0
RHO_MARGIN = 1e-6
OVER_UNDER_LINES = (0.5, 1.5, 2.5, 3.5)
TOLERANCE = 1e-9

SECONDS_PER_DAY_US = 86_400_000_000.0


def line_name(line: float) -> str:
    return str(line).replace(".", "_")


def decay_weight(age_us: Column, half_life_days: Column) -> Column:
    """0.5 ^ (age in days / half-life); exactly 1.0 without a half-life; a negative age is refused."""
    weight = F.pow(F.lit(0.5), age_us / F.lit(SECONDS_PER_DAY_US) / half_life_days)
    return (
        F.when(age_us < 0, F.raise_error(F.lit("a match after the cutoff has no weight")).cast("double"))
        .when(half_life_days.isNull(), F.lit(1.0))
        .otherwise(weight)
    )


def clamp_lambda(rate: Column) -> Column:
    """Refuse what cannot be a rate, clamp what is merely extreme."""
    bad = F.isnan(rate) | (rate < 0) | (rate == F.lit(float("inf")))
    kept = F.least(F.greatest(rate, F.lit(MIN_LAMBDA)), F.lit(MAX_LAMBDA))
    refused = F.when(bad, F.raise_error(F.lit("not a goal rate")).cast("double"))
    return refused.when(rate.isNotNull(), kept)


def poisson_pmf(rate: Column, max_goals: int = MAX_GOALS) -> Column:
    """P(X = k) for k = 0..max_goals as an array; stays in generated code."""
    base = F.exp(-rate)
    return F.array(*[base * F.pow(rate, F.lit(float(k))) / F.lit(float(math.factorial(k))) for k in range(max_goals + 1)])


def tau(home_goals: Column, away_goals: Column, lam_h: Column, lam_a: Column, rho: Column) -> Column:
    """Low-score factor: differs from 1 in four cells only."""
    return (
        F.when((home_goals == 0) & (away_goals == 0), 1.0 - lam_h * lam_a * rho)
        .when((home_goals == 0) & (away_goals == 1), 1.0 + lam_h * rho)
        .when((home_goals == 1) & (away_goals == 0), 1.0 + lam_a * rho)
        .when((home_goals == 1) & (away_goals == 1), 1.0 - rho)
        .otherwise(F.lit(1.0))
    )


def feasible_rho(lam_h: Column, lam_a: Column) -> tuple[Column, Column]:
    """Open interval in which all four factors stay positive."""
    return F.greatest(-1.0 / lam_h, -1.0 / lam_a), F.least(1.0 / (lam_h * lam_a), F.lit(1.0))


def clamp_rho(rho: Column, lam_h: Column, lam_a: Column) -> Column:
    low, high = feasible_rho(lam_h, lam_a)
    return F.least(F.greatest(rho, low + RHO_MARGIN), high - RHO_MARGIN)


def rho_is_valid(rho: Column, lam_h: Column, lam_a: Column) -> Column:
    low, high = feasible_rho(lam_h, lam_a)
    return F.coalesce(~F.isnan(rho) & (rho > low) & (rho < high), F.lit(False))


def outcome_of(home_goals: Column, away_goals: Column) -> Column:
    return F.when(home_goals > away_goals, "home").when(home_goals == away_goals, "draw").otherwise("away")


def with_markets(
    df: DataFrame,
    lam_h: str = "lambda_home",
    lam_a: str = "lambda_away",
    rho: str | None = None,
    prefix: str = "",
    scoreline: bool = False,
    max_goals: int = MAX_GOALS,
) -> DataFrame:
    """Add market probabilities from two rates, optionally corrected by `rho` (0 or NULL: unchanged).

    Adds p_home, p_draw, p_away, p_over_*, p_btts_yes, expected_home/away,
    truncated_mass, low_score (the four adjusted cells) and, on request, the
    row-major `scoreline` array. A NULL rate gives NULL markets.

    The steps are plain arithmetic on non-NULL doubles; the fold in the middle
    keeps each generated loop small enough for the JVM to compile.
    """
    n = max_goals + 1
    rates = {"h": lam_h, "a": lam_a}
    out = df.withColumns({lam_h: clamp_lambda(F.col(lam_h)), lam_a: clamp_lambda(F.col(lam_a))})
    # Powers by doubling: l^1, then l^2, then l^3..4, then l^5..8, ... one multiplication each.
    out = out.selectExpr("*", *[f"coalesce(`{c}`, {MIN_LAMBDA}D) AS __{s}p1" for s, c in rates.items()])
    done = 1
    while done < max_goals:
        upto = min(2 * done, max_goals)
        out = out.selectExpr("*", *[
            f"__{s}p{done} * __{s}p{k - done} AS __{s}p{k}" for s in rates for k in range(done + 1, upto + 1)
        ])
        done = upto
    out = out.selectExpr("*", *[f"exp(-__{s}p1) AS __{s}0" for s in rates])
    out = out.selectExpr("*", *[
        f"__{s}0 * (__{s}p{k} * {1.0 / math.factorial(k)!r}D) AS __{s}{k}" for s in rates for k in range(1, n)
    ])
    # One fold over goal counts, four at a time: mass so far on each side, and P(home scores more) from the away mass below.
    # The fold is not generated code, so what stays inside four counts is summed outside it.
    blocks = []
    for first in range(0, n, 4):
        counts = range(first, min(first + 4, n))
        inside = [f"__h{k} * ({' + '.join(f'__a{i}' for i in range(first, k))})" for k in counts[1:]]
        blocks.append(
            f"struct({' + '.join(f'__h{k}' for k in counts)} AS h, {' + '.join(f'__a{k}' for k in counts)} AS a, "
            f"{' + '.join(inside) or '0.0D'} AS win)"
        )
    start = "struct(0.0D AS h, 0.0D AS a, 0.0D AS win)"
    out = out.selectExpr(
        "*",
        f"aggregate(array({', '.join(blocks)}), {start}, "
        "(s, x) -> struct(s.h + x.h AS h, s.a + x.a AS a, s.win + x.win + x.h * s.a AS win)) AS __sum",
    ).selectExpr(
        "*", "coalesce(__sum.h, 0.0D) AS __toph", "coalesce(__sum.a, 0.0D) AS __topa", "coalesce(__sum.win, 0.0D) AS __win",
        "__hp1 AS __lh", "__ap1 AS __la",
    )
    top_h, top_a = "__toph", "__topa"
    out = out.selectExpr("*", f"coalesce(1.0D / ({top_h} * {top_a}), 0.0D) AS __inv")
    if rho is None:
        out = out.selectExpr("*", "0.0D AS __rho")
    else:
        lam1, lam2, wanted = F.col("__lh"), F.col("__la"), F.coalesce(F.col(rho), F.lit(0.0))
        kept = F.when(wanted == 0.0, F.lit(0.0)).otherwise(clamp_rho(wanted, lam1, lam2))
        out = out.withColumn("__rho", F.coalesce(kept, F.lit(0.0)))
    out = out.selectExpr(
        "*",
        "__h0 * __a0 * __inv * -__lh * __la * __rho AS __d00", "__h0 * __a1 * __inv * __lh * __rho AS __d01",
        "__h1 * __a0 * __inv * __la * __rho AS __d10", "__h1 * __a1 * __inv * -__rho AS __d11",
    )
    out = out.selectExpr("*", "coalesce(1.0D / (1.0D + __d00 + __d01 + __d10 + __d11), 0.0D) AS __z")
    out = out.selectExpr(
        "*",
        "(__win * __inv + __d10) * __z AS __home",
        f"(({' + '.join(f'__h{i} * __a{i}' for i in range(n))}) * __inv + __d00 + __d11) * __z AS __draw",
        *[f"{' + '.join(f'__a{i}' for i in range(k + 1))} AS __ca{k}" for k in range(4)],
    )
    values = {"p_home": "__home", "p_draw": "__draw", "p_away": "greatest(0.0D, 1.0D - __home - __draw)"}
    for line in OVER_UNDER_LINES:
        goals = int(line)
        under = " + ".join(f"__h{i} * __ca{goals - i}" for i in range(goals + 1))
        moved = "__d00" if goals == 0 else "__d00 + __d01 + __d10" + (" + __d11" if goals > 1 else "")
        values[f"p_over_{line_name(line)}"] = f"1.0D - (({under}) * __inv + {moved}) * __z"
    values["p_btts_yes"] = f"(({top_h} - __h0) * ({top_a} - __a0) * __inv + __d11) * __z"
    values["expected_home"] = f"(__lh * ({top_h} - __h{max_goals}) * {top_a} * __inv + __d10 + __d11) * __z"
    values["expected_away"] = f"(__la * ({top_a} - __a{max_goals}) * {top_h} * __inv + __d01 + __d11) * __z"
    values["truncated_mass"] = f"greatest(0.0D, 1.0D - {top_h} * {top_a})"
    low = ", ".join(f"(__h{i} * __a{j} * __inv + __d{i}{j}) * __z" for i in (0, 1) for j in (0, 1))
    values["low_score"] = f"array({low})"
    if scoreline:
        # Only the four low cells differ from the outer product, so all other cells cost one multiplication each.
        tail = "array(" + ", ".join(f"__a{j}" for j in range(2, n)) + ")"
        first = [
            f"array((__h{i} * __a0 * __inv + __d{i}0) * __z, (__h{i} * __a1 * __inv + __d{i}1) * __z)" for i in (0, 1)
        ]
        rest = [f"transform({tail}, q -> __h{i} * q * __inv * __z)" for i in (0, 1)]
        upper = "array(" + ", ".join(f"__h{i} * __inv * __z" for i in range(2, n)) + ")"
        whole = "array(" + ", ".join(f"__a{j}" for j in range(n)) + ")"
        values["scoreline"] = (
            f"concat({first[0]}, {rest[0]}, {first[1]}, {rest[1]}, flatten(transform({upper}, p -> transform({whole}, q -> p * q))))"
        )
    known = f"`{lam_h}` IS NOT NULL AND `{lam_a}` IS NOT NULL"
    kept = [f"`{c}`" for c in df.columns if c not in {prefix + v for v in values}]
    return out.selectExpr(*kept, *[f"CASE WHEN {known} THEN {v} END AS {prefix}{name}" for name, v in values.items()])


def cell(scoreline: Column, home_goals: Column, away_goals: Column, max_goals: int = MAX_GOALS) -> Column:
    """One cell of a stored scoreline; 0 off the grid."""
    inside = home_goals.between(0, max_goals) & away_goals.between(0, max_goals)
    index = (home_goals * (max_goals + 1) + away_goals).cast("int")
    return F.when(inside, F.get(scoreline, index)).otherwise(F.lit(0.0))


def unflatten(scoreline: Column, max_goals: int = MAX_GOALS) -> Column:
    side = max_goals + 1
    return F.transform(F.sequence(F.lit(0), F.lit(max_goals)), lambda h: F.slice(scoreline, h * side + 1, F.lit(side)))


def _masks(max_goals: int) -> dict[str, np.ndarray]:
    """Which cells of the flattened scoreline a market sums; for goal lines those under the line."""
    home, away = (x.ravel() for x in np.indices((max_goals + 1, max_goals + 1)))
    out = {"p_home": home > away, "p_draw": home == away, "p_away": home < away, "p_btts_yes": (home > 0) & (away > 0)}
    return out | {f"p_over_{line_name(line)}": home + away < line for line in OVER_UNDER_LINES}


def stored_markets(scoreline: Column, max_goals: int = MAX_GOALS) -> dict[str, Column]:
    """The markets re-derived from a stored scoreline by masked sums; NULL where cells are missing."""
    masks = _masks(max_goals)
    weights = np.stack(list(masks.values()), axis=1).astype(float)

    @F.arrow_udf("array<double>")
    def masked_sums(cells: pa.Array) -> pa.Array:
        whole = pc.fill_null(pc.equal(pc.list_value_length(cells), len(weights)), False)
        flat = cells.filter(whole).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        sums = flat.reshape(-1, len(weights)) @ weights
        ends = np.concatenate([[0], np.cumsum(whole.to_numpy(zero_copy_only=False))]) * len(masks)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sums.ravel(), pa.float64(), from_pandas=True))

    sums = masked_sums(scoreline)
    found = {name: F.get(sums, F.lit(i)) for i, name in enumerate(masks)}
    return {name: 1.0 - value if name.startswith("p_over_") else value for name, value in found.items()}


def markets_match(scoreline: str = "scoreline", max_goals: int = MAX_GOALS) -> Column:
    """Stored markets equal their re-derivation within 1e-9."""
    good = F.lit(True)
    for name, value in stored_markets(F.col(scoreline), max_goals).items():
        good = good & (F.abs(value - F.col(name)) <= TOLERANCE)
    return good
