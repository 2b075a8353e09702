"""Record rules. Each dict maps a rule name to the condition that breaks it (NULL: not broken).

Use with `operators.quality.rule_violations`, or `is_clean` to keep good rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.probability import OVER_UNDER_LINES, TOLERANCE, line_name
from tidemark.functions.text import known_zone, local_date

# Vocabularies of the canonical tables.
FIXTURE_STATUSES = ("scheduled", "live", "suspended", "ft", "postponed", "abandoned", "cancelled")
RESULT_SOURCES = ("played", "awarded")
MARKET_TYPES = ("1x2", "over_under", "btts", "asian_handicap")
LINE_MARKETS = ("over_under", "asian_handicap")
PERIODS = ("ft", "ht", "2h")
SIDES = ("back", "lay")
PRICE_KINDS = ("observed", "provider_opening", "provider_closing", "exchange_sp")
BOOKMAKER_KINDS = ("bookmaker", "exchange")
COMPETITION_TYPES = ("league", "domestic_cup", "super_cup", "continental", "international")
GENDERS = ("men", "women")
TEAM_TYPES = ("club", "national")
ENTITY_TYPES = ("country", "competition", "season", "team", "venue")
MIN_PRICE, MAX_PRICE = "1.01", "100000"
STAT_SIDES = ("home", "away")
STAT_NAMES = ("shots", "shots_on_target", "corners", "fouls", "yellow_cards", "red_cards")

c = F.col


def is_clean(rules: Mapping[str, Column]) -> Column:
    good = F.lit(True)
    for condition in rules.values():
        good = good & ~F.coalesce(condition, F.lit(False))
    return good


def _one_sided(a: str, b: str) -> Column:
    return c(a).isNull() != c(b).isNull()


def fixture_rules() -> dict[str, Column]:
    """kickoff (timestamp), local_date, local_tz, leg, replay_number, home_team, away_team, status."""
    return {
        "kickoff_missing": c("kickoff").isNull(),
        "unknown_zone": ~known_zone(c("local_tz")),
        "local_date_disagrees": local_date(c("kickoff"), c("local_tz")) != c("local_date"),
        "leg_out_of_range": ~c("leg").between(1, 2),
        "negative_replay": c("replay_number") < 0,
        "team_plays_itself": c("home_team").eqNullSafe(c("away_team")),
        "unknown_status": ~c("status").isin(*FIXTURE_STATUSES),
    }


def result_rules() -> dict[str, Column]:
    pairs = [("ht_home", "ht_away"), ("aet_home", "aet_away"), ("pens_home", "pens_away")]
    names = ("ft_home", "ft_away", *[n for pair in pairs for n in pair])
    negative = F.lit(False)
    for name in names:
        negative = negative | F.coalesce(c(name) < 0, F.lit(False))
    return {
        "negative_score": negative,
        "full_time_missing": c("ft_home").isNull() | c("ft_away").isNull(),
        "half_time_one_sided": _one_sided(*pairs[0]),
        "half_time_above_full_time": (c("ht_home") > c("ft_home")) | (c("ht_away") > c("ft_away")),
        "extra_time_one_sided": _one_sided(*pairs[1]),
        "extra_time_below_full_time": (c("aet_home") < c("ft_home")) | (c("aet_away") < c("ft_away")),
        "shootout_one_sided": _one_sided(*pairs[2]),
        "shootout_without_extra_time": c("pens_home").isNotNull() & c("aet_home").isNull(),
        "shootout_level": c("pens_home") == c("pens_away"),
        "awarded_trainable": (c("result_source") == "awarded") & c("is_trainable"),
        "unknown_result_source": ~c("result_source").isin(*RESULT_SOURCES),
    }


def stats_rules(columns: list[str]) -> dict[str, Column]:
    """Only the rules whose columns the table has."""
    have = set(columns)
    rules: dict[str, Column] = {}
    counts = [f"{s}_{n}" for s in STAT_SIDES for n in STAT_NAMES if f"{s}_{n}" in have]
    if counts:
        negative = F.lit(False)
        for name in counts:
            negative = negative | F.coalesce(c(name) < 0, F.lit(False))
        rules["negative_count"] = negative
    for side in STAT_SIDES:
        if {f"{side}_shots", f"{side}_shots_on_target"} <= have:
            rules[f"{side}_on_target_above_shots"] = c(f"{side}_shots_on_target") > c(f"{side}_shots")
    if {"home_possession", "away_possession"} <= have:
        rules["possession_one_sided"] = _one_sided("home_possession", "away_possession")
        rules["possession_sum"] = ~(c("home_possession") + c("away_possession")).between(99, 101)
    if {"home_xg", "away_xg"} <= have:
        rules["negative_xg"] = (c("home_xg") < 0) | (c("away_xg") < 0)
    return rules


def odds_rules() -> dict[str, Column]:
    """market_type, line, price, is_available, side, bookmaker_kind, price_kind, convention."""
    takes_line = c("market_type").isin(*LINE_MARKETS)
    return {
        "unknown_market": ~c("market_type").isin(*MARKET_TYPES),
        "line_missing": takes_line & c("line").isNull(),
        "line_forbidden": ~takes_line & c("line").isNotNull(),
        "suspended_with_price": ~c("is_available") & c("price").isNotNull(),
        "price_out_of_range": ~c("price").between(F.lit(MIN_PRICE).cast("decimal(9,4)"), F.lit(MAX_PRICE).cast("decimal(10,4)")),
        "lay_without_exchange": (c("side") == "lay") & (c("bookmaker_kind") != "exchange"),
        "convention_missing": (c("price_kind") != "observed") & (F.coalesce("convention", F.lit("")) == ""),
    }


def bookmaker_rules() -> dict[str, Column]:
    return {
        "unknown_kind": ~c("kind").isin(*BOOKMAKER_KINDS),
        "commission_without_exchange": c("commission_rate").isNotNull() & (c("kind") != "exchange"),
        "commission_out_of_range": (c("commission_rate") < 0) | (c("commission_rate") >= 1),
    }


def competition_rules() -> dict[str, Column]:
    return {
        "unknown_type": ~c("type").isin(*COMPETITION_TYPES),
        "unknown_gender": ~c("gender").isin(*GENDERS),
        "tier_below_one": c("tier") < 1,
    }


def season_rules() -> dict[str, Column]:
    return {
        "start_year_out_of_range": ~c("start_year").between(1850, 2200),
        "dates_inverted": c("end_date") < c("start_date"),
        "label_missing": F.coalesce("label", F.lit("")) == "",
    }


def alias_rules() -> dict[str, Column]:
    return {
        "alias_empty": F.coalesce("normalized_alias", F.lit("")) == "",
        "alias_not_lower_case": c("normalized_alias") != F.lower("normalized_alias"),
        "confidence_out_of_range": ~c("confidence").between(0, 100),
    }


def prediction_rules(max_goals: int = 15) -> dict[str, Column]:
    """A stored forecast may be persisted only if none of these holds."""
    cells = c("scoreline")
    mass = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x)
    overs = [f"p_over_{line_name(line)}" for line in sorted(OVER_UNDER_LINES)]
    outside = F.lit(False)
    for name in ("p_home", "p_draw", "p_away", "p_btts_yes", *overs):
        outside = outside | c(name).isNull() | ~c(name).between(0, 1)
    rising = F.lit(False)
    for low, high in zip(overs, overs[1:]):
        rising = rising | (c(high) > c(low))
    return {
        "wrong_cell_count": F.size(cells) != (max_goals + 1) ** 2,
        # The mass is NULL when a cell is.
        "cell_out_of_range": F.when((F.array_min(cells) < 0) | (F.array_max(cells) > 1), True).when(mass.isNotNull(), False),
        "mass_not_one": F.abs(mass - 1) > TOLERANCE,
        "probability_out_of_range": outside,
        "one_x_two_not_one": F.abs(c("p_home") + c("p_draw") + c("p_away") - 1) > TOLERANCE,
        "over_ladder_rises": rising,
        "rate_not_positive": (c("lambda_home") <= 0) | (c("lambda_away") <= 0),
        "cold_flag_disagrees": c("is_cold_start") != (F.size("cold_started_teams") > 0),
        "cutoff_after_known_at": c("data_cutoff") > c("known_at"),
        "truncated_mass_out_of_range": (c("truncated_mass") < 0) | (c("truncated_mass") >= 1),
    }
