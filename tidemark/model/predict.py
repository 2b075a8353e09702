"""Rates and market probabilities for fixtures joined to their fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.probability import MAX_GOALS, with_markets


def _at(team: str, values: str) -> Column:
    place = F.array_position(F.col("teams"), F.col(team)).cast("int")
    return F.get(F.col(values), place - 1)


def expected_goals(joined: DataFrame, min_matches: int = 4) -> DataFrame:
    """Rates from a row's own fit; a team the fit never saw is league average and flagged cold.

    Needs home, away and the fit columns on one row; adds lambda_home,
    lambda_away and cold_started (home first).
    """
    cold = {
        side: F.coalesce(_at(side, "matches") < min_matches, F.lit(True)) for side in ("home", "away")
    }
    attack = {s: F.coalesce(_at(s, "attack"), F.lit(0.0)) for s in ("home", "away")}
    defence = {s: F.coalesce(_at(s, "defence"), F.lit(0.0)) for s in ("home", "away")}
    flagged = F.filter(
        F.array(*[F.when(cold[s], F.col(s).cast("string")) for s in ("home", "away")]), lambda t: t.isNotNull()
    )
    return joined.withColumns({
        "lambda_home": F.exp(F.col("mu") + F.col("home_advantage") + attack["home"] - defence["away"]),
        "lambda_away": F.exp(F.col("mu") + attack["away"] - defence["home"]),
        "cold_started": flagged,
    })


def predict(
    fixtures: DataFrame, fits: DataFrame, on: list[str], min_matches: int = 4,
    rho: str | None = "rho", scoreline: bool = False, max_goals: int = MAX_GOALS,
) -> DataFrame:
    """Every fixture with its fit's rates and markets. The fit table has one row per key, so this is an equi-join."""
    rated = expected_goals(fixtures.join(fits, on), min_matches)
    return with_markets(rated, rho=rho, scoreline=scoreline, max_goals=max_goals)


def league_baseline(fits: DataFrame) -> DataFrame:
    """The fit with every team rating switched off: one 1X2 triple per fit."""
    rates = fits.select(
        *[c for c in ("half", "scope", "cutoff") if c in fits.columns],
        F.exp(F.col("mu") + F.col("home_advantage")).alias("lambda_home"), F.exp("mu").alias("lambda_away"),
    )
    return with_markets(rates, prefix="league_").select(
        *[c for c in rates.columns if not c.startswith("lambda")], "league_p_home", "league_p_draw", "league_p_away"
    )
