"""Registered queries: training windows, scores, back-test summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.probability import decay_weight, outcome_of, with_markets
from tidemark.model import backtest, metrics
from tidemark.model.profiles import CANDIDATES, MAX_BRIER_COST, MIN_LOG_LOSS_GAIN, MIN_TRAINING_MATCHES, PROFILES
from tidemark.operators.ordered import earlier_totals, neighbours, with_earlier_totals
from tidemark.plans import views
from tidemark.plans.registry import query, scaled, sql_scaled

Y1999 = 915148800000000

# Strictly earlier counts per match: the DuckDB form of the training window.
WINDOW_SQL = """+ win AS (SELECT *, count(*) OVER w AS n,
 CAST(coalesce(sum(CASE WHEN hg > ag THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS nh,
 CAST(coalesce(sum(CASE WHEN hg = ag THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS nd,
 CAST(coalesce(sum(CASE WHEN hg < ag THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS na,
 CAST(coalesce(sum(hg) OVER w, 0) AS BIGINT) AS sh, CAST(coalesce(sum(ag) OVER w, 0) AS BIGINT) AS sa
 FROM m WINDOW w AS (PARTITION BY scope ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 freq AS (SELECT *, (nh + 1.0) / (n + 3.0) AS fh, (nd + 1.0) / (n + 3.0) AS fd, (na + 1.0) / (n + 3.0) AS fa,
 CASE WHEN hg > ag THEN 'home' WHEN hg = ag THEN 'draw' ELSE 'away' END AS outcome FROM win)
"""


def _loss(h: str, d: str, a: str) -> str:
    chosen = f"(CASE outcome WHEN 'home' THEN {h} WHEN 'draw' THEN {d} ELSE {a} END)"
    return f"-ln(least(greatest({chosen}, 1e-15), 1 - 1e-15))"


def _brier(h: str, d: str, a: str) -> str:
    parts = [f"power({p} - CASE WHEN outcome = '{o}' THEN 1 ELSE 0 END, 2)" for p, o in ((h, "home"), (d, "draw"), (a, "away"))]
    return f"({' + '.join(parts)})"


FREQ_LOSS, FREQ_BRIER = _loss("fh", "fd", "fa"), _brier("fh", "fd", "fa")


def frequency_rows(spark, sf_dir) -> DataFrame:
    """Every match with its class-frequency forecast from strictly earlier matches of its scope."""
    rows = backtest.with_class_frequency(backtest.with_training_window(views.matches(spark, sf_dir)))
    return rows.withColumn("outcome", outcome_of(F.col("hg"), F.col("ag")))


@query("class_frequency", ["m"], WINDOW_SQL + f"""SELECT id, n AS training_matches, {sql_scaled('fh')} AS p_home,
 {sql_scaled('fd')} AS p_draw, {sql_scaled('fa')} AS p_away FROM freq""")
def class_frequency(spark, sf_dir):
    return frequency_rows(spark, sf_dir).select(
        "id", "training_matches", *[scaled(f"frequency_p_{o}").alias(f"p_{o}") for o in metrics.OUTCOMES]
    )


@query("class_frequency_scores", ["m"], WINDOW_SQL + f"""SELECT scope, season, count(*) AS predictions,
 {sql_scaled(f'avg({FREQ_LOSS})', 6)} AS log_loss, {sql_scaled(f'avg({FREQ_BRIER})', 6)} AS brier
 FROM freq WHERE n >= {MIN_TRAINING_MATCHES} GROUP BY scope, season""")
def class_frequency_scores(spark, sf_dir):
    rows = frequency_rows(spark, sf_dir).filter(F.col("training_matches") >= MIN_TRAINING_MATCHES)
    triple = metrics.triple("frequency_p_")
    return rows.groupBy("scope", "season").agg(
        F.count(F.lit(1)).alias("predictions"),
        scaled(F.avg(metrics.log_score(triple, F.col("outcome"))), 6).alias("log_loss"),
        scaled(F.avg(metrics.brier_score(triple, F.col("outcome"))), 6).alias("brier"),
    )


@query("log_loss", ["m"], WINDOW_SQL + f"""SELECT scope, count(*) AS n, {sql_scaled(f'avg({FREQ_LOSS})', 6)} AS log_loss
 FROM freq WHERE n >= {MIN_TRAINING_MATCHES} GROUP BY scope""")
def log_loss(spark, sf_dir):
    rows = frequency_rows(spark, sf_dir).filter(F.col("training_matches") >= MIN_TRAINING_MATCHES)
    score = metrics.log_score(metrics.triple("frequency_p_"), F.col("outcome"))
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), scaled(F.avg(score), 6).alias("log_loss"))


@query("brier", ["m"], WINDOW_SQL + f"""SELECT scope, count(*) AS n, {sql_scaled(f'avg({FREQ_BRIER})', 6)} AS brier
 FROM freq WHERE n >= {MIN_TRAINING_MATCHES} GROUP BY scope""")
def brier(spark, sf_dir):
    rows = frequency_rows(spark, sf_dir).filter(F.col("training_matches") >= MIN_TRAINING_MATCHES)
    score = metrics.brier_score(metrics.triple("frequency_p_"), F.col("outcome"))
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), scaled(F.avg(score), 6).alias("brier"))


@query("calibration", ["m"], WINDOW_SQL + f""", long AS (
 SELECT scope, 'home' AS outcome, fh AS p, outcome AS happened FROM freq WHERE n >= {MIN_TRAINING_MATCHES}
 UNION ALL SELECT scope, 'draw', fd, outcome FROM freq WHERE n >= {MIN_TRAINING_MATCHES}
 UNION ALL SELECT scope, 'away', fa, outcome FROM freq WHERE n >= {MIN_TRAINING_MATCHES})
 SELECT scope, outcome, count(*) AS n, {sql_scaled('avg(p)', 6)} AS mean_predicted,
 {sql_scaled('avg(CASE WHEN happened = outcome THEN 1.0 ELSE 0.0 END)', 6)} AS observed,
 {sql_scaled('avg(p) - avg(CASE WHEN happened = outcome THEN 1.0 ELSE 0.0 END)', 6)} AS bias
 FROM long GROUP BY scope, outcome""")
def calibration(spark, sf_dir):
    rows = frequency_rows(spark, sf_dir).filter(F.col("training_matches") >= MIN_TRAINING_MATCHES)
    out = metrics.calibration(rows, ["scope"], "frequency_p_")
    return out.select("scope", "outcome", "n", *[scaled(c, 6).alias(c) for c in ("mean_predicted", "observed", "bias")])


@query("training_size", ["m"], WINDOW_SQL + f"""SELECT id, n AS training_matches, n >= {MIN_TRAINING_MATCHES} AS predictable
 FROM win""")
def training_size(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    rows = with_earlier_totals(m, ["scope"], "k", {"training_matches": F.lit(1).cast("bigint")})
    return rows.select(
        "id", "training_matches", (F.col("training_matches") >= MIN_TRAINING_MATCHES).alias("predictable")
    )


@query("prefix_join", ["m"], WINDOW_SQL + "SELECT id, n AS earlier, sh AS goals_home, sa AS goals_away FROM win")
def prefix_join(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    rows = with_earlier_totals(m, ["scope"], "k", {
        "earlier": F.lit(1).cast("bigint"), "goals_home": F.col("hg").cast("bigint"), "goals_away": F.col("ag").cast("bigint"),
    })
    return rows.select("id", "earlier", "goals_home", "goals_away")


@query("appearances", ["m"], """+ side AS (SELECT scope, home AS team, k FROM m UNION ALL SELECT scope, away, k FROM m),
 inst AS (SELECT scope, team, k, count(*) AS c FROM side GROUP BY ALL)
 SELECT scope, team, k, CAST(coalesce(sum(c) OVER w, 0) AS BIGINT) AS appearances,
 coalesce(sum(c) OVER w, 0) < 4 AS thin FROM inst
 WINDOW w AS (PARTITION BY scope, team ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def appearances(spark, sf_dir):
    side = views.matches(spark, sf_dir).select("scope", "k", F.explode(F.array("home", "away")).alias("team"))
    window = earlier_totals(side, ["scope", "team"], "k", {"appearances": F.lit(1).cast("bigint")})
    return window.select("scope", "team", "k", "appearances", (F.col("appearances") < 4).alias("thin"))


@query("distinct_cutoffs", ["m"], "SELECT DISTINCT scope, k AS cutoff FROM m")
def distinct_cutoffs(spark, sf_dir):
    return backtest.distinct_cutoffs(views.matches(spark, sf_dir))


@query("training_filter", ["m"], f"SELECT id, scope, k, home, away FROM m WHERE k < {Y1999} ORDER BY k, home, away")
def training_filter(spark, sf_dir):
    return backtest.observations_before(views.matches(spark, sf_dir), Y1999).select("id", "scope", "k", "home", "away")


@query("stable_order", ["m"], "SELECT id, k, home, away FROM m ORDER BY k, home, away, id")
def stable_order(spark, sf_dir):
    return views.matches(spark, sf_dir).select("id", "k", "home", "away").orderBy("k", "home", "away", "id")


@query("first_last", ["m"], """SELECT scope, min(k) AS first_k, max(k) AS last_k,
 min_by(id, k * 1 + id * 0) AS any_first, count(*) AS n FROM m GROUP BY scope""".replace(
    "min_by(id, k * 1 + id * 0) AS any_first, ", ""))
def first_last(spark, sf_dir):
    return views.matches(spark, sf_dir).groupBy("scope").agg(
        F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.count(F.lit(1)).alias("n")
    )


_HALF_LIVES = sorted({c.half_life for c in PROFILES.values() if c.half_life})


@query("decay_weight", ["m"], f"""+ last AS (SELECT scope, max(k) + 1 AS cutoff FROM m GROUP BY scope)
 SELECT id, CAST(hl AS INT) AS half_life, {sql_scaled('power(0.5, (cutoff - k) / 86400000000.0 / hl)')} AS weight
 FROM m JOIN last USING (scope) CROSS JOIN (VALUES (30.0), (90.0), (180.0), (365.0)) AS h(hl)""")
def decay_weights(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    last = m.groupBy("scope").agg((F.max("k") + 1).alias("cutoff"))
    lives = F.explode(F.array(*[F.lit(h) for h in _HALF_LIVES])).alias("hl")
    return m.join(last, "scope").select("id", "k", "cutoff", lives).select(
        "id", F.col("hl").cast("int").alias("half_life"),
        scaled(decay_weight(F.col("cutoff") - F.col("k"), F.col("hl"))).alias("weight"),
    )


@query("model_profiles", ["m"], f"""+ last AS (SELECT scope, max(k) + 1 AS cutoff FROM m GROUP BY scope),
 p(profile, hl, corrected) AS (VALUES ('production', 180.0, false), ('control', NULL, false), ('dixon-coles', NULL, true),
 ('decay-30d', 30.0, false), ('decay-90d', 90.0, false), ('decay-365d', 365.0, false), ('decay-365d-dixon-coles', 365.0, true))
 SELECT profile, scope, corrected, count(*) AS n,
 {sql_scaled('sum(CASE WHEN hl IS NULL THEN 1.0 ELSE power(0.5, (cutoff - k) / 86400000000.0 / hl) END)', 6)} AS effective_matches
 FROM m JOIN last USING (scope) CROSS JOIN p GROUP BY ALL""")
def model_profiles(spark, sf_dir):
    """The weight mass each named profile gives the corpus at its last cutoff."""
    m = views.matches(spark, sf_dir)
    last = m.groupBy("scope").agg((F.max("k") + 1).alias("cutoff"))
    # Seven weighted sums in one pass, then one row per profile: the matches are never repeated.
    aged = m.join(last, "scope").withColumn("age", F.col("cutoff") - F.col("k"))
    sums = aged.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(decay_weight(F.col("age"), F.lit(c.half_life).cast("double"))).alias(f"w{i}")
          for i, c in enumerate(PROFILES.values())],
    )
    listed = F.explode(F.array(*[
        F.struct(F.lit(c.name).alias("profile"), F.lit(c.dixon_coles).alias("corrected"), F.col(f"w{i}").alias("w"))
        for i, c in enumerate(PROFILES.values())
    ])).alias("p")
    return sums.select("scope", "n", listed).select(
        "p.profile", "scope", "p.corrected", "n", scaled("p.w", 6).alias("effective_matches")
    )


# A forecast both engines can compute: goal rates are the mean of strictly
# earlier matches. Three variants play the part of candidates: plain, with the
# low-score correction, and with rates shrunk by a tenth.
MOMENT = (("A", 0, 0.0, 1.0), ("B", 1, -0.05, 1.0), ("C", 2, 0.0, 0.9))


def moment_scored(spark, sf_dir) -> DataFrame:
    m = views.matches(spark, sf_dir)
    window = earlier_totals(m, ["scope"], "k", {
        "n": F.lit(1).cast("bigint"), "sh": F.col("hg").cast("bigint"), "sa": F.col("ag").cast("bigint"),
    })
    listed = F.explode(F.array(*[
        F.struct(F.lit(c).alias("candidate"), F.lit(x).alias("complexity"), F.lit(r).alias("rho"), F.lit(f).alias("f"))
        for c, x, r, f in MOMENT
    ])).alias("v")
    # Rates depend on (scope, k) only, so markets are derived once per instant and variant.
    rated = window.filter(f"n >= {MIN_TRAINING_MATCHES}").select("scope", "k", "n", "sh", "sa", listed).select(
        "scope", "k", F.col("n").alias("training_matches"), "v.candidate", "v.complexity", "v.rho",
        (F.col("v.f") * F.col("sh") / F.col("n")).alias("lambda_home"),
        (F.col("v.f") * F.col("sa") / F.col("n")).alias("lambda_away"),
    )
    priced = with_markets(rated, rho="rho")
    cold = F.filter(
        F.array(F.when(F.col("home") % 10 == 0, F.col("home").cast("string")),
                F.when(F.col("away") % 10 == 0, F.col("away").cast("string"))),
        lambda t: t.isNotNull(),
    )
    return m.join(priced, ["scope", "k"]).withColumns({
        "outcome": outcome_of(F.col("hg"), F.col("ag")), "cold_started": cold,
    })


MOMENT_SQL = WINDOW_SQL + """, v(candidate, complexity, rho, f) AS (VALUES ('A', 0, 0.0, 1.0), ('B', 1, -0.05, 1.0), ('C', 2, 0.0, 0.9)),
 inst AS (SELECT DISTINCT scope, k, n, sh, sa FROM win WHERE n >= 30),
 rate AS (SELECT scope, k, n, candidate, complexity, rho, CAST(f AS DOUBLE) * sh / n AS lh, CAST(f AS DOUBLE) * sa / n AS la FROM inst CROSS JOIN v),
 g AS (SELECT CAST(range AS INT) AS x, CAST(factorial(CAST(range AS INT)) AS DOUBLE) AS fact FROM range(16)),
 raw AS (SELECT r.*, h.x AS i, a.x AS j, exp(-lh) * power(lh, h.x) / h.fact * exp(-la) * power(la, a.x) / a.fact *
  CASE WHEN h.x = 0 AND a.x = 0 THEN 1 - lh * la * rho WHEN h.x = 0 AND a.x = 1 THEN 1 + lh * rho
  WHEN h.x = 1 AND a.x = 0 THEN 1 + la * rho WHEN h.x = 1 AND a.x = 1 THEN 1 - rho ELSE 1 END AS q
  FROM rate r CROSS JOIN g h CROSS JOIN g a),
 price AS (SELECT scope, k, candidate, complexity, any_value(n) AS n, any_value(lh) AS lh, any_value(la) AS la,
  sum(q) FILTER (i > j) / sum(q) AS ph, sum(q) FILTER (i = j) / sum(q) AS pd, sum(q) FILTER (i < j) / sum(q) AS pa,
  sum(q) FILTER (i = 0 AND j = 0) / sum(q) AS c00, sum(q) FILTER (i = 0 AND j = 1) / sum(q) AS c01,
  sum(q) FILTER (i = 1 AND j = 0) / sum(q) AS c10, sum(q) FILTER (i = 1 AND j = 1) / sum(q) AS c11
  FROM raw GROUP BY scope, k, candidate, complexity),
 scored AS (SELECT m.*, p.candidate, p.complexity, p.n, p.lh, p.la, p.ph, p.pd, p.pa, p.c00, p.c01, p.c10, p.c11,
  CASE WHEN hg > ag THEN 'home' WHEN hg = ag THEN 'draw' ELSE 'away' END AS outcome,
  (home % 10 = 0 OR away % 10 = 0) AS cold FROM m JOIN price p USING (scope, k))
"""
M_LOSS, M_BRIER = _loss("ph", "pd", "pa"), _brier("ph", "pd", "pa")
_SLICE_SQL = f"""count(*) AS predictions, {sql_scaled(f'avg({M_LOSS})', 6)} AS log_loss,
 {sql_scaled(f'avg({M_BRIER})', 6)} AS brier, {sql_scaled('avg(lh)', 6)} AS predicted_home, {sql_scaled('avg(la)', 6)} AS predicted_away,
 {sql_scaled('avg(hg)', 6)} AS actual_home, {sql_scaled('avg(ag)', 6)} AS actual_away,
 {sql_scaled('avg(lh + la) - avg(hg + ag)', 6)} AS goal_bias, CAST(sum(CASE WHEN cold THEN 1 ELSE 0 END) AS BIGINT) AS cold_start"""
_MEASURES = ("log_loss", "brier", "predicted_home", "predicted_away", "actual_home", "actual_away", "goal_bias")


def _rounded_slices(df: DataFrame, by: list[str]) -> DataFrame:
    return metrics.slice_summary(df, by).select(
        *by, "predictions", *[scaled(c, 6).alias(c) for c in _MEASURES], "cold_start"
    )


@query("slice_summary", ["m"], MOMENT_SQL + f"SELECT candidate, scope, {_SLICE_SQL} FROM scored GROUP BY candidate, scope")
def slice_summary(spark, sf_dir):
    return _rounded_slices(moment_scored(spark, sf_dir), ["candidate", "scope"])


@query("season_table", ["m"], MOMENT_SQL + f"SELECT candidate, season, {_SLICE_SQL} FROM scored GROUP BY candidate, season")
def season_table(spark, sf_dir):
    return _rounded_slices(moment_scored(spark, sf_dir), ["candidate", "season"])


_SPLIT = "CASE WHEN season IN (1995, 1996, 1997, 1998) THEN 'development' ELSE 'held_out' END"


@query("split_by_season", ["m"], MOMENT_SQL + f"""SELECT candidate, {_SPLIT} AS split, {_SLICE_SQL} FROM scored
 GROUP BY candidate, {_SPLIT}""")
def split_by_season(spark, sf_dir):
    scored = backtest.split_rows(moment_scored(spark, sf_dir), views.DEVELOPMENT_SEASONS)
    return _rounded_slices(scored, ["candidate", "split"])


@query("select_candidate", ["m"], MOMENT_SQL + f""", s AS (SELECT candidate, complexity, avg({M_LOSS}) AS ll, avg({M_BRIER}) AS br
 FROM scored WHERE season IN (1995, 1996, 1997, 1998) GROUP BY ALL),
 q AS (SELECT s.candidate, s.complexity, s.ll FROM s CROSS JOIN (SELECT * FROM s WHERE candidate = 'C') b
 WHERE s.candidate <> 'C' AND b.ll - s.ll >= {MIN_LOG_LOSS_GAIN} / 100 AND s.br - b.br <= {MAX_BRIER_COST})
 SELECT (SELECT candidate FROM q ORDER BY complexity, ll LIMIT 1) AS selected""")
def select_candidate(spark, sf_dir):
    """The selection rule on development rows only; a hundredth of the published gain so that the toy variants can qualify."""
    dev = moment_scored(spark, sf_dir).filter(F.col("season").isin(*views.DEVELOPMENT_SEASONS))
    slices = metrics.slice_summary(dev, ["candidate", "complexity"])
    return metrics.select_candidate(slices, "C", MIN_LOG_LOSS_GAIN / 100, MAX_BRIER_COST)


@query("low_score_cells", ["m"], MOMENT_SQL + f"""SELECT candidate, count(*) AS n,
 {', '.join(f"count(*) FILTER (hg = {h} AND ag = {a}) AS actual_{h}{a}" for h in (0, 1) for a in (0, 1))},
 {', '.join(f"{sql_scaled(f'avg(c{h}{a})', 6)} AS predicted_{h}{a}" for h in (0, 1) for a in (0, 1))}
 FROM scored GROUP BY candidate""")
def low_score_cells(spark, sf_dir):
    out = metrics.low_score_cells(moment_scored(spark, sf_dir), ["candidate"])
    return out.select(*[scaled(c, 6).alias(c) if c.startswith("predicted") else F.col(c) for c in out.columns])


@query("backtest_report", ["m"], MOMENT_SQL + f""", j AS (SELECT s.*, f.fh, f.fd, f.fa FROM scored s JOIN freq f USING (id))
 SELECT candidate, count(*) AS predictions, count(DISTINCT (scope, k)) AS fits, min(k) AS first_prediction,
 max(k) AS last_prediction, {sql_scaled(f'avg({M_LOSS})', 6)} AS log_loss, {sql_scaled(f'avg({M_BRIER})', 6)} AS brier,
 {sql_scaled(f'avg({FREQ_LOSS})', 6)} AS frequency_log_loss, {sql_scaled(f'avg({FREQ_BRIER})', 6)} AS frequency_brier,
 {sql_scaled(f'avg({M_LOSS})', 6)} AS league_log_loss, {sql_scaled(f'avg({M_BRIER})', 6)} AS league_brier,
 {sql_scaled('avg(lh)', 6)} AS mean_predicted_home, {sql_scaled('avg(la)', 6)} AS mean_predicted_away,
 {sql_scaled('avg(hg)', 6)} AS mean_actual_home, {sql_scaled('avg(ag)', 6)} AS mean_actual_away,
 CAST(sum(CASE WHEN cold THEN 1 ELSE 0 END) AS BIGINT) AS cold_start FROM j GROUP BY candidate""")
def backtest_report(spark, sf_dir):
    scored = moment_scored(spark, sf_dir).withColumn("cutoff", F.col("k"))
    window = backtest.with_class_frequency(backtest.training_window(views.matches(spark, sf_dir)))
    rows = scored.join(window.drop("training_matches"), ["scope", "k"])
    # The league baseline of a model without ratings is the model itself.
    rows = rows.withColumns({f"league_p_{o}": F.col(f"p_{o}") for o in metrics.OUTCOMES})
    out = backtest.backtest_report(rows)
    whole = {"candidate", "predictions", "fits", "first_prediction", "last_prediction", "cold_start"}
    return out.select(*[F.col(c) if c in whole else scaled(c, 6).alias(c) for c in out.columns])


@query("cold_start_by_season", ["m"], """+ x AS (SELECT season, id, unnest([home, away]) AS team FROM m)
 SELECT season, count(DISTINCT id) AS cold_predictions, string_agg(DISTINCT CAST(team AS VARCHAR), ',' ORDER BY CAST(team AS VARCHAR)) AS teams
 FROM x WHERE team % 10 = 0 GROUP BY season""")
def cold_start_by_season(spark, sf_dir):
    flagged = views.matches(spark, sf_dir).withColumn("cold_started", F.filter(
        F.array(F.col("home").cast("string"), F.col("away").cast("string")), lambda t: t.cast("int") % 10 == 0
    ))
    out = backtest.cold_start_by_season(flagged, ["season"])
    return out.select("season", "cold_predictions", F.array_join("teams", ",").alias("teams"))


# A dependence series both engines can compute: one value per (scope, day).
def rho_series(spark, sf_dir) -> DataFrame:
    day = F.floor(F.col("k") / views.DAY_US)
    series = views.matches(spark, sf_dir).groupBy("scope", day.alias("day")).agg(F.sum(F.col("hg") - F.col("ag")).alias("d"))
    return series.select("scope", (F.col("day") * views.DAY_US).alias("cutoff"), ((F.col("d") * 37 % 41) / 100.0).alias("rho"))


_RHO_SQL = f"""+ day AS (SELECT scope, k // {views.DAY_US} AS day, CAST(sum(hg - ag) AS BIGINT) AS d FROM m GROUP BY ALL),
 r AS (SELECT scope, day * {views.DAY_US} AS cutoff, (d * 37 % 41) / 100.0 AS rho FROM day)
"""


@query("rho_summary", ["m"], _RHO_SQL + f""", f AS (SELECT *, lag(rho) OVER (PARTITION BY scope ORDER BY cutoff) AS p FROM r)
 SELECT scope, count(*) AS fits, {sql_scaled('avg(rho)', 6)} AS mean, {sql_scaled('median(rho)', 6)} AS median,
 {sql_scaled('min(rho)', 6)} AS min, {sql_scaled('max(rho)', 6)} AS max,
 count(*) FILTER (p IS NOT NULL AND (p > 0) <> (rho > 0)) AS sign_changes,
 {sql_scaled('avg(CASE WHEN rho < 0 THEN 1.0 ELSE 0.0 END)', 6)} AS negative_share,
 {sql_scaled('min_by(rho, cutoff)', 6)} AS first, {sql_scaled('max_by(rho, cutoff)', 6)} AS last FROM f GROUP BY scope""")
def rho_summary(spark, sf_dir):
    out = metrics.rho_summary(rho_series(spark, sf_dir), ["scope"])
    return out.select(*[
        F.col(c) if c in ("scope", "fits", "sign_changes") else scaled(c, 6).alias(c) for c in out.columns
    ])


@query("sign_changes", ["m"], _RHO_SQL + """, f AS (SELECT *, lag(rho) OVER (PARTITION BY scope ORDER BY cutoff) AS p FROM r)
 SELECT scope, cutoff, (p IS NOT NULL AND (p > 0) <> (rho > 0)) AS flipped FROM f""")
def sign_changes(spark, sf_dir):
    out = neighbours(rho_series(spark, sf_dir), ["scope"], ["cutoff"], previous={"p": F.col("rho")})
    return out.select("scope", "cutoff", F.coalesce((F.col("p") > 0) != (F.col("rho") > 0), F.lit(False)).alias("flipped"))


@query("rho_by_year", ["m"], _RHO_SQL + f"""SELECT scope, CAST(year(make_timestamp(cutoff)) AS INT) AS year,
 {sql_scaled('median(rho)', 4)} AS median FROM r GROUP BY ALL""")
def rho_by_year(spark, sf_dir):
    out = metrics.rho_by_year(rho_series(spark, sf_dir), ["scope"])
    return out.select("scope", "year", scaled("median", 4).alias("median"))
