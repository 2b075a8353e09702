"""The same estimator as DataFrame sweeps, for scopes whose pairings outgrow one task.

`fit_many` solves a scope's cutoffs inside a task and needs the scope's pairing
sums there. Here sums and parameters stay distributed: each half sweep is one
grouped sum over sides joined to the parameters, and only whether a scope still
moves reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model.profiles import Config
from tidemark.session import ensure_checkpoint_dir


def _capped(gradient: Column, curvature: Column) -> Column:
    step = F.when(curvature > 0, gradient / curvature).otherwise(0.0)
    return F.least(F.greatest(step, F.lit(-2.0)), F.lit(2.0))


def fit_distributed(pairs: DataFrame, config: Config) -> DataFrame:
    """Ratings per (scope, team). `pairs`: scope, home, away, w, wh, wa (weighted matches and goals).

    Adds mu, home_advantage, sweeps and converged of the scope to every row.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    sides = pairs.select("scope", F.explode(F.array(
        F.struct(F.col("home").alias("attacker"), F.col("away").alias("defender"), F.lit(1.0).alias("at_home"), F.col("wh").alias("goals"), F.col("w").alias("w")),
        F.struct(F.col("away").alias("attacker"), F.col("home").alias("defender"), F.lit(0.0).alias("at_home"), F.col("wa").alias("goals"), F.col("w").alias("w")),
    )).alias("s")).select("scope", "s.*").checkpoint()
    start = sides.groupBy("scope").agg(
        F.sum("goals").alias("total"), F.sum(F.col("goals") * F.col("at_home")).alias("total_home"), F.sum("w").alias("mass")
    ).filter("total > 0")
    teams = sides.groupBy("scope", F.col("attacker").alias("team")).agg(F.sum("goals").alias("scored")).join(
        sides.groupBy("scope", F.col("defender").alias("team")).agg(F.sum("goals").alias("conceded")), ["scope", "team"]
    )
    params = teams.join(start, "scope").select(
        "scope", "team", "scored", "conceded", "total", "total_home",
        F.lit(0.0).alias("att"), F.lit(0.0).alias("def"), F.ln(F.col("total") / F.col("mass")).alias("mu"),
        F.lit(0.0).alias("ha"), F.lit(0).alias("sweeps"), F.lit(False).alias("converged"),
    ).checkpoint()
    ridge = F.lit(config.ridge)
    for sweep in range(1, config.max_sweeps + 1):
        # A sweep reads the parameters several times, so its result is written before the next one starts.
        params = _sweep(sides, params, ridge, config.tolerance, sweep).checkpoint()
        if params.filter("NOT converged").isEmpty():
            break
    return params.select("scope", "team", F.col("att").alias("attack"), F.col("def").alias("defence"),
                         "mu", F.col("ha").alias("home_advantage"), "sweeps", "converged")


def _sweep(sides: DataFrame, params: DataFrame, ridge: Column, tolerance: float, number: int) -> DataFrame:
    """One pass over scopes that still move: level and home edge, attacks, defences, centring."""
    live = params.filter("NOT converged")
    leak = live.select("scope", F.col("team").alias("defender"), F.exp(-F.col("def")).alias("d"))
    # Mass an attacker meets, weighted by how leaky its opponents are; level and edge follow from it.
    met = sides.join(leak, ["scope", "defender"]).groupBy("scope", F.col("attacker").alias("team")).agg(
        F.sum(F.when(F.col("at_home") == 1, F.col("w") * F.col("d")).otherwise(0.0)).alias("at_home"),
        F.sum(F.when(F.col("at_home") == 0, F.col("w") * F.col("d")).otherwise(0.0)).alias("on_road"),
    )
    whole = Window.partitionBy("scope")
    rated = live.join(met, ["scope", "team"])
    reach = F.exp("att")
    rated = rated.withColumns({
        "home_rate": F.sum(reach * F.col("at_home")).over(whole), "away_rate": F.sum(reach * F.col("on_road")).over(whole),
    })
    mu = F.col("mu") + F.ln(F.col("total") / (F.exp("mu") * (F.exp("ha") * F.col("home_rate") + F.col("away_rate"))))
    rated = rated.withColumn("mu1", mu)
    expected_home = F.exp(F.col("mu1") + F.col("ha")) * F.col("home_rate")
    edge = F.when((F.col("total_home") > 0) & (expected_home > 0), F.ln(F.col("total_home") / expected_home)).otherwise(0.0)
    rated = rated.withColumn("ha1", F.col("ha") + edge)
    expected = F.exp("mu1") * reach * (F.exp("ha1") * F.col("at_home") + F.col("on_road"))
    rated = rated.withColumn("att1", F.col("att") + _capped(F.col("scored") - expected - ridge * F.col("att"), expected + ridge))
    fresh = rated.select("scope", F.col("team").alias("attacker"), F.exp("att1").alias("a"))
    faced = sides.join(fresh, ["scope", "attacker"]).groupBy("scope", F.col("defender").alias("team")).agg(
        F.sum(F.when(F.col("at_home") == 1, F.col("w") * F.col("a")).otherwise(0.0)).alias("from_home"),
        F.sum(F.when(F.col("at_home") == 0, F.col("w") * F.col("a")).otherwise(0.0)).alias("from_road"),
    )
    rated = rated.join(faced, ["scope", "team"])
    conceding = F.exp("mu1") * F.exp(-F.col("def")) * (F.exp("ha1") * F.col("from_home") + F.col("from_road"))
    rated = rated.withColumn("def1", F.col("def") + _capped(conceding - F.col("conceded") - ridge * F.col("def"), conceding + ridge))
    rated = rated.withColumns({"mean_a": F.avg("att1").over(whole), "mean_d": F.avg("def1").over(whole)})
    rated = rated.withColumns({
        "att2": F.col("att1") - F.col("mean_a"), "def2": F.col("def1") - F.col("mean_d"),
        "mu2": F.col("mu1") + F.col("mean_a") - F.col("mean_d"),
    })
    moved = F.greatest(F.abs(F.col("att2") - F.col("att")), F.abs(F.col("def2") - F.col("def")),
                       F.abs(F.col("mu2") - F.col("mu")), F.abs(F.col("ha1") - F.col("ha")))
    rated = rated.withColumn("stopped", F.max(moved).over(whole) < tolerance)
    after = rated.select(
        "scope", "team", "scored", "conceded", "total", "total_home", F.col("att2").alias("att"), F.col("def2").alias("def"),
        F.col("mu2").alias("mu"), F.col("ha1").alias("ha"), F.lit(number).alias("sweeps"), F.col("stopped").alias("converged"),
    )
    return after.unionByName(params.filter("converged").select(*after.columns))
