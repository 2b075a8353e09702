"""The persisted form of a forecast: one record per (fixture, model version, profile, cutoff)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.probability import MAX_GOALS, OVER_UNDER_LINES, line_name
from tidemark.functions.rules import is_clean, prediction_rules
from tidemark.model.profiles import MODEL_FAMILY, MODEL_VERSION, Config

IDENTITY = ("fixture_id", "model_version", "profile", "data_cutoff")
# What decides whether a regenerated forecast changed anything.
CONTENT = (
    "lambda_home", "lambda_away", "max_goals", "scoreline", "truncated_mass", "p_home", "p_draw", "p_away",
    *[f"p_over_{line_name(line)}" for line in OVER_UNDER_LINES], "p_btts_yes", "is_cold_start", "cold_started_teams",
    "training_matches",
)


def fit_metadata(config: Config) -> Column:
    """Everything needed to repeat the fit except the ratings, as JSON."""
    return F.to_json(F.struct(
        F.lit(MODEL_FAMILY).alias("model_family"), F.lit(MODEL_VERSION).alias("model_version"),
        F.lit(config.name).alias("profile"), F.col("scope"), F.col("data_cutoff"), F.col("training_matches"),
        F.size("teams").alias("teams"), F.col("sweeps"), F.col("converged"), F.col("log_likelihood"), F.col("mu"),
        F.col("home_advantage"), F.col("rho"), F.lit(config.half_life).cast("double").alias("decay_half_life_days"),
        F.lit(config.dixon_coles).alias("dixon_coles_enabled"), F.lit(config.min_matches).alias("cold_start_min_matches"),
    ), {"ignoreNullFields": "false"})


def artifacts(predictions: DataFrame, config: Config, known_at: Column | int) -> DataFrame:
    """Persistable records plus `valid`. `predictions` carries fixture_id, data_cutoff, fit columns and markets with scoreline."""
    rows = predictions.withColumns({
        "model_family": F.lit(MODEL_FAMILY), "model_version": F.lit(MODEL_VERSION), "profile": F.lit(config.name),
        "known_at": known_at if isinstance(known_at, Column) else F.lit(known_at), "max_goals": F.lit(MAX_GOALS),
        "is_cold_start": F.size("cold_started") > 0, "cold_started_teams": F.col("cold_started"),
        "fit_metadata": fit_metadata(config),
    })
    names = [*IDENTITY, "model_family", "known_at", *CONTENT, "fit_metadata"]
    return rows.select(*names).withColumn("valid", is_clean(prediction_rules()))
