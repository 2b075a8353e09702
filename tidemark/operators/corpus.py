"""The two scans a forecast needs: training results and fixtures still to be played.

Registries (seasons, competitions, names) are small; Spark broadcasts them when
their size allows and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.temporal import as_of


def _official(names: DataFrame, side: str) -> DataFrame:
    """Current official names; without the type a team with two current names would double its matches."""
    return names.filter("valid_to IS NULL AND name_type = 'official'").select(
        F.col("team_id").alias(f"{side}_team_id"), F.col("name").alias(f"{side}_team")
    )


def _fixtures(tables: Mapping[str, DataFrame], competition: str | None, seasons: Sequence[str] | None, cutoff) -> DataFrame:
    competitions = tables["competitions"].select("competition_id", F.col("slug").alias("competition"))
    if competition is not None:
        competitions = competitions.filter(F.col("competition") == competition)
    labels = tables["seasons"] if seasons is None else tables["seasons"].filter(F.col("label").isin(*seasons))
    named = labels.join(competitions, "competition_id").select("season_id", "label", "competition")
    return (
        tables["fixtures"].select("fixture_id", "season_id", "home_team_id", "away_team_id")
        .join(named, "season_id")
        .join(as_of(tables["schedule"], cutoff).select("fixture_id", "kickoff", "status"), "fixture_id")
        .join(_official(tables["names"], "home"), "home_team_id")
        .join(_official(tables["names"], "away"), "away_team_id")
    )


def training_corpus(
    tables: Mapping[str, DataFrame], competition: str | None, seasons: Sequence[str] | None, cutoff: Column | int, source: str
) -> DataFrame:
    """Trainable results of one source as known at `cutoff`, with names and valid time.

    `competition` None takes all. The source must be named: two sources of one
    match would train on it twice.
    """
    results = (
        as_of(tables["results"], cutoff)
        .filter(F.col("is_trainable") & (F.col("source") == source))
        .select("fixture_id", "ft_home", "ft_away", "occurred_at")
    )
    valid_time = F.coalesce("occurred_at", "kickoff")
    return (
        results.join(_fixtures(tables, competition, seasons, cutoff), "fixture_id")
        .withColumn("k", valid_time)
        .filter("k IS NOT NULL")
        .select("fixture_id", "competition", F.col("label").alias("season"), "home_team", "away_team", "ft_home", "ft_away", "k")
    )


def eligible_fixtures(
    tables: Mapping[str, DataFrame], competition: str | None, data_cutoff: Column | int, cutoff: Column | int,
    seasons: Sequence[str] | None = None, statuses: Sequence[str] | None = None,
) -> DataFrame:
    """Fixtures kicking off at or after `data_cutoff`; results are never read."""
    rows = _fixtures(tables, competition, seasons, cutoff).filter(F.col("kickoff") >= data_cutoff)
    if statuses is not None:
        rows = rows.filter(F.col("status").isin(*statuses))
    return rows.select("fixture_id", "competition", F.col("label").alias("season"), "home_team", "away_team", "kickoff", "status")
