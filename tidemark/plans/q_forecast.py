"""Registered queries: probability functions, fits, predictions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import probability as P
from tidemark.model import backtest, metrics
from tidemark.model.fit import fit_many, pair_cells, ratings_of
from tidemark.model.predict import expected_goals, league_baseline, predict
from tidemark.model.profiles import CANDIDATES, MIN_TRAINING_MATCHES, PROFILES, Config
from tidemark.model.rho_large import estimate_rho_distributed
from tidemark.operators.shape import spread
from tidemark.plans import views
from tidemark.plans.registry import query, scaled, sql_scaled
from tidemark.session import ensure_checkpoint_dir

# Rates derived from each match id: 0.2 .. 3.19 and 0.2 .. 2.69.
RATES_SQL = """+ r AS (SELECT id, home, away, hg, ag, 0.2 + (id % 300) / CAST(100 AS DOUBLE) AS lh,
 0.2 + (id * 7 % 250) / CAST(100 AS DOUBLE) AS la, (id % 21 - 10) / CAST(100 AS DOUBLE) AS rho FROM m),
 g AS (SELECT CAST(range AS INT) AS x, CAST(factorial(CAST(range AS INT)) AS DOUBLE) AS fact FROM range(16)),
 p AS (SELECT r.*, h.x AS i, a.x AS j, exp(-lh) * power(lh, h.x) / h.fact * exp(-la) * power(la, a.x) / a.fact AS q
  FROM r CROSS JOIN g h CROSS JOIN g a)
"""


def rates(spark, sf_dir) -> DataFrame:
    return views.matches(spark, sf_dir).selectExpr(
        "*", "0.2D + (id % 300) / 100D AS lambda_home", "0.2D + (id * 7 % 250) / 100D AS lambda_away",
        "(id % 21 - 10) / 100D AS rho",
    )


@query("clamp_lambda", ["m"], f"""SELECT id, {sql_scaled('least(greatest(CASE WHEN id % 9 = 0 THEN 0.0 ELSE (id % 2000) / 100.0 END, 1e-6), 15)')} AS rate
 FROM m""")
def clamp_lambda(spark, sf_dir):
    raw = F.when(F.col("id") % 9 == 0, F.lit(0.0)).otherwise((F.col("id") % 2000) / F.lit(100.0))
    return views.matches(spark, sf_dir).select("id", scaled(P.clamp_lambda(raw)).alias("rate"))


@query("poisson_pmf", ["m"], """+ r AS (SELECT id, 0.2 + (id % 300) / CAST(100 AS DOUBLE) AS lh FROM m),
 g AS (SELECT CAST(range AS INT) AS x FROM range(16))
 SELECT id, x AS goals, CAST(floor(exp(-lh) * power(lh, x) / factorial(x) * 1e9 + 0.5) AS BIGINT) AS p FROM r CROSS JOIN g""")
def poisson_pmf(spark, sf_dir):
    return rates(spark, sf_dir).select("id", F.posexplode(P.poisson_pmf(F.col("lambda_home"))).alias("goals", "p")).select(
        "id", "goals", scaled("p").alias("p")
    )


@query("tau", ["m"], RATES_SQL + f"""SELECT id, {sql_scaled('''CASE WHEN hg = 0 AND ag = 0 THEN 1 - lh * la * rho
 WHEN hg = 0 AND ag = 1 THEN 1 + lh * rho WHEN hg = 1 AND ag = 0 THEN 1 + la * rho WHEN hg = 1 AND ag = 1 THEN 1 - rho ELSE 1.0 END''')} AS tau FROM r""")
def tau(spark, sf_dir):
    c = F.col
    return rates(spark, sf_dir).select(
        "id", scaled(P.tau(c("hg"), c("ag"), c("lambda_home"), c("lambda_away"), c("rho"))).alias("tau")
    )


@query("feasible_rho", ["m"], RATES_SQL + f"""SELECT id, {sql_scaled('greatest(-1 / lh, -1 / la)')} AS low,
 {sql_scaled('least(1 / (lh * la), 1.0)')} AS high,
 {sql_scaled('least(greatest(rho * 10, greatest(-1 / lh, -1 / la) + 1e-6), least(1 / (lh * la), 1.0) - 1e-6)')} AS clamped,
 (rho * 10 > greatest(-1 / lh, -1 / la) AND rho * 10 < least(1 / (lh * la), 1.0)) AS valid FROM r""")
def feasible_rho(spark, sf_dir):
    lam1, lam2, wide = F.col("lambda_home"), F.col("lambda_away"), F.col("rho") * 10
    low, high = P.feasible_rho(lam1, lam2)
    return rates(spark, sf_dir).select(
        "id", scaled(low).alias("low"), scaled(high).alias("high"),
        scaled(P.clamp_rho(wide, lam1, lam2)).alias("clamped"), P.rho_is_valid(wide, lam1, lam2).alias("valid"),
    )


@query("outcome_of", ["m"], "SELECT id, CASE WHEN hg > ag THEN 'home' WHEN hg = ag THEN 'draw' ELSE 'away' END AS outcome FROM m")
def outcome_of(spark, sf_dir):
    return views.matches(spark, sf_dir).select("id", P.outcome_of(F.col("hg"), F.col("ag")).alias("outcome"))


@query("scoreline_matrix", ["m"], RATES_SQL + f""", n AS (SELECT *, q / sum(q) OVER (PARTITION BY id) AS z FROM p)
 SELECT id, count(*) AS cells, {sql_scaled('sum(z)')} AS mass, {sql_scaled('sum(z * (i * 16 + j)) / 255', 7)} AS weighted,
 {sql_scaled('max(z)')} AS top FROM n GROUP BY id""")
def scoreline_matrix(spark, sf_dir):
    grid = P.with_markets(rates(spark, sf_dir), scoreline=True).select("id", F.col("scoreline").alias("cells"))
    total = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(F.transform("cells", lambda p, i: p * i), F.lit(0.0), lambda s, x: s + x) / 255
    return grid.select(
        "id", F.size("cells").cast("bigint").alias("cells"), scaled(total).alias("mass"),
        scaled(weighted, 7).alias("weighted"), scaled(F.array_max("cells")).alias("top"),
    )


@query("scoreline_cell", ["m"], RATES_SQL + f"""SELECT r.id, {sql_scaled('coalesce(max(q) FILTER (i = hg AND j = ag), 0) / sum(q)')} AS actual_cell,
 0 AS off_grid, {sql_scaled('sum(q) FILTER (i = 2) / sum(q)')} AS row_two FROM p JOIN r USING (id, hg, ag) GROUP BY r.id""".replace(
    "p JOIN r USING (id, hg, ag) GROUP BY r.id", "p r GROUP BY r.id"))
def scoreline_cell(spark, sf_dir):
    """Lookup in the flattened array, off-grid lookup, and one row of the unflattened matrix."""
    grid = P.with_markets(rates(spark, sf_dir), scoreline=True)
    row_two = F.aggregate(F.get(P.unflatten(F.col("scoreline")), F.lit(2)), F.lit(0.0), lambda s, x: s + x)
    return grid.select(
        "id", scaled(P.cell(F.col("scoreline"), F.col("hg"), F.col("ag"))).alias("actual_cell"),
        P.cell(F.col("scoreline"), F.col("hg") + 16, F.col("ag")).cast("int").alias("off_grid"),
        scaled(row_two).alias("row_two"),
    )


_MARKETS_SQL = f"""{sql_scaled('sum(q) FILTER (i > j) / sum(q)')} AS p_home, {sql_scaled('sum(q) FILTER (i = j) / sum(q)')} AS p_draw,
 {sql_scaled('sum(q) FILTER (i < j) / sum(q)')} AS p_away,
 {', '.join(f"{sql_scaled(f'1 - sum(q) FILTER (i + j < {line}) / sum(q)')} AS p_over_{P.line_name(line)}" for line in P.OVER_UNDER_LINES)},
 {sql_scaled('sum(q) FILTER (i > 0 AND j > 0) / sum(q)')} AS p_btts_yes,
 {sql_scaled('sum(q * i) / sum(q)', 8)} AS expected_home, {sql_scaled('sum(q * j) / sum(q)', 8)} AS expected_away"""
MARKETS = ("p_home", "p_draw", "p_away", *[f"p_over_{P.line_name(line)}" for line in P.OVER_UNDER_LINES], "p_btts_yes")


def _markets(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, *[scaled(c).alias(c) for c in MARKETS],
        *[scaled(c, 8).alias(c) for c in ("expected_home", "expected_away")],
    )


@query("derive_markets", ["m"], RATES_SQL + f"SELECT id, {_MARKETS_SQL}, {sql_scaled('greatest(0, 1 - sum(q))', 8)} AS truncated_mass FROM p GROUP BY id")
def derive_markets(spark, sf_dir):
    out = P.with_markets(rates(spark, sf_dir))
    return _markets(out.withColumn("tm", scaled("truncated_mass", 8)), "id", "tm").withColumnRenamed("tm", "truncated_mass")


_TAU_SQL = """CASE WHEN i = 0 AND j = 0 THEN 1 - lh * la * rho WHEN i = 0 AND j = 1 THEN 1 + lh * rho
 WHEN i = 1 AND j = 0 THEN 1 + la * rho WHEN i = 1 AND j = 1 THEN 1 - rho ELSE 1 END"""


@query("apply_low_score_correction", ["m"], RATES_SQL + f""", c AS (SELECT id, i, j, q * {_TAU_SQL} AS q FROM p)
 SELECT id, {_MARKETS_SQL} FROM c GROUP BY id""")
def apply_low_score_correction(spark, sf_dir):
    return _markets(P.with_markets(rates(spark, sf_dir), rho="rho"), "id")


@query("markets_match", ["m"], "SELECT id, true AS matches FROM m")
def markets_match(spark, sf_dir):
    """Stored markets equal those re-derived from the stored scoreline, corrected cells included."""
    stored = P.with_markets(spread(rates(spark, sf_dir), "id"), rho="rho", scoreline=True)
    return stored.select("id", P.markets_match().alias("matches"))


# Closed-form ratings both engines can compute: a team's attack is the log of
# its smoothed goals per match, its defence the negated log of goals conceded.
def moment_fits(spark, sf_dir) -> DataFrame:
    m = views.matches(spark, sf_dir)
    scope = m.groupBy("scope").agg(
        (F.sum("hg") / F.count(F.lit(1))).alias("gh"), (F.sum("ag") / F.count(F.lit(1))).alias("ga")
    )
    side = m.select("scope", F.explode(F.array(
        F.struct(F.col("home").alias("team"), F.col("hg").alias("f"), F.col("ag").alias("a")),
        F.struct(F.col("away").alias("team"), F.col("ag").alias("f"), F.col("hg").alias("a")),
    )).alias("s")).select("scope", "s.*")
    team = side.groupBy("scope", "team").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.sum("f").alias("f"), F.sum("a").alias("a")
    ).select(
        "scope", F.struct(
            "team", F.ln((F.col("f") + 1) / (F.col("n") + 1)).alias("att"),
            (-F.ln((F.col("a") + 1) / (F.col("n") + 1))).alias("def"), "n",
        ).alias("t")
    )
    # One entry per team of a scope.
    arrays = team.groupBy("scope").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return scope.join(arrays, "scope").select(
        "scope", F.ln("ga").alias("mu"), F.ln(F.col("gh") / F.col("ga")).alias("home_advantage"),
        F.col("t.team").alias("teams"), F.col("t.att").alias("attack"), F.col("t.def").alias("defence"),
        F.col("t.n").alias("matches"), F.lit(-0.04).alias("rho"),
    )


def with_unseen(matches: DataFrame) -> DataFrame:
    """All matches, and every fiftieth once more with a home side that no match knows."""
    again = matches.filter("id % 50 = 0").withColumns({"id": -F.col("id"), "home": F.lit(99)})
    return matches.unionByName(again)


MOMENT_FIT_SQL = """+ mm AS (SELECT * FROM m UNION ALL SELECT * REPLACE (-id AS id, 99 AS home) FROM m WHERE id % 50 = 0),
 sc AS (SELECT scope, sum(hg) / CAST(count(*) AS DOUBLE) AS gh, sum(ag) / CAST(count(*) AS DOUBLE) AS ga FROM m GROUP BY scope),
 sd AS (SELECT scope, home AS team, hg AS f, ag AS a FROM m UNION ALL SELECT scope, away, ag, hg FROM m),
 tm AS (SELECT scope, team, count(*) AS n, ln((sum(f) + 1) / CAST(count(*) + 1 AS DOUBLE)) AS att,
  -ln((sum(a) + 1) / CAST(count(*) + 1 AS DOUBLE)) AS def FROM sd GROUP BY ALL),
 e AS (SELECT m.id, m.scope, m.home, m.away, least(greatest(exp(ln(ga) + ln(gh / ga) + coalesce(h.att, 0) - coalesce(a.def, 0)), 1e-6), 15) AS lh,
  least(greatest(exp(ln(ga) + coalesce(a.att, 0) - coalesce(h.def, 0)), 1e-6), 15) AS la, -0.04 AS rho,
  concat_ws(',', CASE WHEN coalesce(h.n, 0) < 4 THEN CAST(m.home AS VARCHAR) END, CASE WHEN coalesce(a.n, 0) < 4 THEN CAST(m.away AS VARCHAR) END) AS cold
  FROM mm m JOIN sc USING (scope) LEFT JOIN tm h ON h.scope = m.scope AND h.team = m.home LEFT JOIN tm a ON a.scope = m.scope AND a.team = m.away),
 pr AS (SELECT DISTINCT scope, home, away, lh, la, rho FROM e),
 g AS (SELECT CAST(range AS INT) AS x, CAST(factorial(CAST(range AS INT)) AS DOUBLE) AS fact FROM range(16)),
 raw AS (SELECT pr.*, h.x AS i, a.x AS j, exp(-lh) * power(lh, h.x) / h.fact * exp(-la) * power(la, a.x) / a.fact AS q
  FROM pr CROSS JOIN g h CROSS JOIN g a)
"""


@query("expected_goals", ["m"], MOMENT_FIT_SQL + f"SELECT id, {sql_scaled('lh')} AS lambda_home, {sql_scaled('la')} AS lambda_away, cold FROM e")
def expected_goals_query(spark, sf_dir):
    rated = expected_goals(with_unseen(views.matches(spark, sf_dir)).join(moment_fits(spark, sf_dir), "scope"))
    return rated.select(
        "id", scaled(P.clamp_lambda(F.col("lambda_home"))).alias("lambda_home"),
        scaled(P.clamp_lambda(F.col("lambda_away"))).alias("lambda_away"), F.array_join("cold_started", ",").alias("cold"),
    )


@query("predict_fixture", ["m"], MOMENT_FIT_SQL + f""", c AS (SELECT scope, home, away, i, j, q * {_TAU_SQL} AS q FROM raw),
 k AS (SELECT scope, home, away, {_MARKETS_SQL} FROM c GROUP BY ALL)
 SELECT e.id, k.* EXCLUDE (scope, home, away), e.cold FROM e JOIN k USING (scope, home, away)""")
def predict_fixture(spark, sf_dir):
    out = predict(with_unseen(views.matches(spark, sf_dir)), moment_fits(spark, sf_dir), ["scope"])
    return _markets(out.withColumn("cold", F.array_join("cold_started", ",")), "id", "cold")


@query("league_baseline", ["m"], MOMENT_FIT_SQL + f""", b AS (SELECT scope, ga * (gh / ga) AS lh, ga AS la FROM sc),
 x AS (SELECT b.*, h.x AS i, a.x AS j, exp(-lh) * power(lh, h.x) / h.fact * exp(-la) * power(la, a.x) / a.fact AS q FROM b CROSS JOIN g h CROSS JOIN g a)
 SELECT scope, {sql_scaled('sum(q) FILTER (i > j) / sum(q)')} AS p_home, {sql_scaled('sum(q) FILTER (i = j) / sum(q)')} AS p_draw,
 {sql_scaled('sum(q) FILTER (i < j) / sum(q)')} AS p_away FROM x GROUP BY scope""")
def league_baseline_query(spark, sf_dir):
    out = league_baseline(moment_fits(spark, sf_dir))
    return out.select("scope", *[scaled(f"league_{c}").alias(c) for c in ("p_home", "p_draw", "p_away")])


# The iterative estimator. SQL cannot run it, but SQL can state what its
# optimum must satisfy, so the fits are checked through those equations.
ALL_RATED = tuple(Config(c.name, c.half_life, c.dixon_coles, min_matches=1) for c in CANDIDATES)


def season_cutoffs(m: DataFrame) -> DataFrame:
    """One cutoff per (scope, season): the first instant of the next year."""
    end = F.unix_micros(F.make_timestamp(F.col("season") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return m.select("scope", end.alias("cutoff")).distinct()


def season_fits(spark, sf_dir) -> DataFrame:
    m = views.matches(spark, sf_dir)
    return fit_many(m, ALL_RATED, season_cutoffs(m))


def _expected_by_pair(spark, sf_dir) -> DataFrame:
    """The fits at every season's end: `_expected` of them."""
    m = views.matches(spark, sf_dir)
    return _expected(m, season_cutoffs(m), season_fits(spark, sf_dir))


def _expected(m: DataFrame, cutoffs: DataFrame, fits: DataFrame) -> DataFrame:
    """Per (half, scope, cutoff, home, away): weighted matches and the fit's two rates."""
    halves = list(dict.fromkeys(c.half_life for c in ALL_RATED))
    cut = cutoffs.groupBy("scope").agg(F.collect_set("cutoff").alias("cutoffs"))
    seen = F.explode(F.filter("cutoffs", lambda c: c > F.col("k"))).alias("cutoff")
    pairs = pair_cells(m).join(cut, "scope").select("scope", "k", "home", "away", "n", seen)
    half = F.explode(F.array(*[
        F.struct(F.lit(i).alias("half"), F.lit(h).cast("double").alias("hl")) for i, h in enumerate(halves)
    ])).alias("x")
    mass = pairs.select("*", half).groupBy("x.half", "scope", "cutoff", "home", "away").agg(
        F.sum(F.col("n") * P.decay_weight(F.col("cutoff") - F.col("k"), F.col("x.hl"))).alias("w")
    )
    return expected_goals(mass.join(fits, ["half", "scope", "cutoff"]), min_matches=1)


_WEIGHTED_SQL = f"""+ ends AS (SELECT DISTINCT scope, epoch_us(make_timestamp(season + 1, 1, 1, 0, 0, 0)) AS cutoff FROM m),
 h(half, hl) AS (VALUES (0, NULL), (1, 30.0), (2, 90.0), (3, 180.0), (4, 365.0)),
 w AS (SELECT half, m.scope, cutoff, home, away, hg, ag,
  CASE WHEN hl IS NULL THEN 1.0 ELSE power(0.5, (cutoff - k) / 86400000000.0 / hl) END AS w FROM m JOIN ends USING (scope) CROSS JOIN h WHERE k < cutoff)
"""


@query("fit_ratings", ["m"], _WEIGHTED_SQL + f""", s AS (SELECT half, scope, cutoff, home AS team, w * hg AS f, w * ag AS a FROM w
  UNION ALL SELECT half, scope, cutoff, away, w * ag, w * hg FROM w)
 SELECT half, scope, cutoff, team, count(*) AS matches, {sql_scaled('sum(f)', 5)} AS scored, {sql_scaled('sum(a)', 5)} AS conceded
 FROM s GROUP BY ALL""")
def fit_ratings(spark, sf_dir):
    """First-order conditions per team: weighted goals = fitted goals + ridge * rating, for every season-end fit."""
    return _conditions(_expected_by_pair(spark, sf_dir), 5)


def _conditions(rated: DataFrame, digits: int) -> DataFrame:
    ridge = ALL_RATED[0].ridge

    def rating(team: str, values: str):
        return F.get(F.col(values), F.array_position("teams", F.col(team)).cast("int") - 1)

    def own(team: str, scored: str, conceded: str):
        return F.struct(
            F.col(team).alias("team"), (F.col("w") * F.col(scored)).alias("f"), (F.col("w") * F.col(conceded)).alias("a"),
            rating(team, "attack").alias("attack"), rating(team, "defence").alias("defence"), rating(team, "matches").alias("n"),
        )

    sides = F.explode(F.array(own("home", "lambda_home", "lambda_away"), own("away", "lambda_away", "lambda_home"))).alias("s")
    return rated.select("half", "scope", "cutoff", sides).groupBy("half", "scope", "cutoff", "s.team").agg(
        F.max("s.n").cast("bigint").alias("matches"),
        scaled(F.sum("s.f") + ridge * F.max("s.attack"), digits).alias("scored"),
        scaled(F.sum("s.a") - ridge * F.max("s.defence"), digits).alias("conceded"),
    )


MONTHLY = tuple(replace(c, max_sweeps=5000) for c in ALL_RATED)


@query("fit_many_months", ["m"], f"""+ mo AS (SELECT DISTINCT scope, epoch_us(date_trunc('month', make_timestamp(k))) AS cutoff FROM m),
 ends AS (SELECT mo.scope, cutoff FROM mo JOIN m ON m.scope = mo.scope AND k < cutoff GROUP BY ALL HAVING count(*) >= {MIN_TRAINING_MATCHES}),
 h(half, hl) AS (VALUES (0, NULL), (1, 30.0), (2, 90.0), (3, 180.0), (4, 365.0)),
 w AS (SELECT half, m.scope, cutoff, home, away, hg, ag,
  CASE WHEN hl IS NULL THEN 1.0 ELSE power(0.5, (cutoff - k) / 86400000000.0 / hl) END AS w FROM m JOIN ends USING (scope) CROSS JOIN h WHERE k < cutoff),
 s AS (SELECT half, scope, cutoff, home AS team, w * hg AS f, w * ag AS a FROM w UNION ALL SELECT half, scope, cutoff, away, w * ag, w * hg FROM w)
 SELECT half, scope, cutoff, team, count(*) AS matches, {sql_scaled('sum(f)', 3)} AS scored, {sql_scaled('sum(a)', 3)} AS conceded
 FROM s GROUP BY ALL""")
def fit_many_months(spark, sf_dir):
    """First-order conditions per team of the fits at the start of every month, all five half-lives."""
    m = views.matches(spark, sf_dir)
    cutoffs = backtest.month_cutoffs(m)
    return _conditions(_expected(m, cutoffs, fit_many(m, MONTHLY, cutoffs, MIN_TRAINING_MATCHES)), 3)


WIDE = (Config("wide", min_matches=1, max_sweeps=3000), Config("wide_year", 365.0, min_matches=1, max_sweeps=3000))


@query("fit_ratings_wide", None, f"""WITH w AS (SELECT o_orderkey AS id, o_custkey AS home, (o_custkey * 31 + o_orderkey * 17) % 1499 + 1 AS away,
  epoch_us(CAST(o_orderdate AS TIMESTAMP)) + (o_orderkey % 4) * {views.HOUR_US} AS k,
  (o_orderkey * 31 + o_custkey * 17) % (2 + o_custkey % 4) AS hg, (o_orderkey * 13 + o_custkey * 7) % (2 + o_custkey % 3) AS ag FROM orders WHERE o_custkey <> (o_custkey * 31 + o_orderkey * 17) % 1499 + 1),
 c AS (SELECT max(k) + 1 AS cutoff FROM w), h(half, hl) AS (VALUES (0, NULL), (1, 365.0)),
 x AS (SELECT half, home, away, hg, ag, CASE WHEN hl IS NULL THEN 1.0 ELSE power(0.5, (cutoff - k) / 86400000000.0 / hl) END AS w FROM w CROSS JOIN c CROSS JOIN h),
 s AS (SELECT half, home AS team, w * hg AS f, w * ag AS a FROM x UNION ALL SELECT half, away, w * ag, w * hg FROM x)
 SELECT half, team, count(*) AS matches, {sql_scaled('sum(f)', 3)} AS scored, {sql_scaled('sum(a)', 3)} AS conceded, true AS converged FROM s GROUP BY ALL""")
def fit_ratings_wide(spark, sf_dir):
    """First-order conditions of one scope in which every customer is a team: few pairings, thousands of teams."""
    ensure_checkpoint_dir(spark)
    m = views.table(spark, sf_dir, "orders").selectExpr(
        "'wide' AS scope", "o_custkey AS home", "(o_custkey * 31 + o_orderkey * 17) % 1499 + 1 AS away",
        f"{views.micros('o_orderdate')} + (o_orderkey % 4) * {views.HOUR_US} AS k",
        "CAST((o_orderkey * 31 + o_custkey * 17) % (2 + o_custkey % 4) AS INT) AS hg",
        "CAST((o_orderkey * 13 + o_custkey * 7) % (2 + o_custkey % 3) AS INT) AS ag",
    ).filter("home <> away")
    cutoffs = m.groupBy("scope").agg((F.max("k") + 1).alias("cutoff"))
    fits = fit_many(m, WIDE, cutoffs, spread=True).checkpoint()
    half = F.explode(F.array(*[F.struct(F.lit(i).alias("half"), F.lit(c.half_life).cast("double").alias("hl")) for i, c in enumerate(WIDE)])).alias("x")
    # One row a scope, and a row a fit below.
    mass = pair_cells(m).join(F.broadcast(cutoffs), "scope").select("*", half).groupBy("x.half", "scope", "cutoff", "home", "away").agg(
        F.sum(F.col("n") * P.decay_weight(F.col("cutoff") - F.col("k"), F.col("x.hl"))).alias("w")
    )
    keys = ["half", "scope", "cutoff"]
    levels = F.broadcast(fits.select(*keys, "mu", "home_advantage", "converged").distinct())
    rated = ratings_of(fits, 1).drop("cold_start")
    of = lambda side: rated.withColumnsRenamed({"team": side, "attack": f"{side}_attack", "defence": f"{side}_defence", "matches": f"{side}_matches"})
    met = mass.join(levels, keys).join(of("home"), [*keys, "home"]).join(of("away"), [*keys, "away"])
    goals_home = F.col("w") * F.exp(F.col("mu") + F.col("home_advantage") + F.col("home_attack") - F.col("away_defence"))
    goals_away = F.col("w") * F.exp(F.col("mu") + F.col("away_attack") - F.col("home_defence"))

    def own(side: str, scored: Column, conceded: Column):
        return F.struct(
            F.col(side).alias("team"), scored.alias("f"), conceded.alias("a"), F.col(f"{side}_attack").alias("attack"),
            F.col(f"{side}_defence").alias("defence"), F.col(f"{side}_matches").alias("n"), F.col("converged"),
        )

    sides = F.explode(F.array(own("home", goals_home, goals_away), own("away", goals_away, goals_home))).alias("s")
    ridge = WIDE[0].ridge
    return met.select("half", sides).groupBy("half", "s.team").agg(
        F.max("s.n").cast("bigint").alias("matches"), scaled(F.sum("s.f") + ridge * F.max("s.attack"), 3).alias("scored"),
        scaled(F.sum("s.a") - ridge * F.max("s.defence"), 3).alias("conceded"), F.min("s.converged").alias("converged"),
    )


@query("fit_summary", ["m"], _WEIGHTED_SQL + f"""SELECT half, scope, cutoff, count(*) AS training_matches, true AS converged,
 {sql_scaled('sum(w * hg)', 3)} AS home_goals, {sql_scaled('sum(w * ag)', 3)} AS away_goals FROM w GROUP BY ALL""")
def fit_summary(spark, sf_dir):
    """Fitted home and away totals equal the weighted actual totals; mu and home advantage are optimal."""
    return _expected_by_pair(spark, sf_dir).groupBy("half", "scope", "cutoff").agg(
        F.first("training_matches").alias("training_matches"), F.first("converged").alias("converged"),
        scaled(F.sum(F.col("w") * F.col("lambda_home")), 3).alias("home_goals"),
        scaled(F.sum(F.col("w") * F.col("lambda_away")), 3).alias("away_goals"),
    )


@query("estimate_rho", ["m"], """SELECT DISTINCT half, scope, epoch_us(make_timestamp(season + 1, 1, 1, 0, 0, 0)) AS cutoff,
 CAST(0 AS BIGINT) AS slope, true AS feasible FROM m CROSS JOIN (VALUES (0), (4)) h(half)""")
def estimate_rho(spark, sf_dir):
    """The weighted low-score log likelihood has slope zero at every fitted rho, and rho is feasible for every training match."""
    lam1, lam2, rho = F.col("lambda_home"), F.col("lambda_away"), F.col("rho")
    return _low_scores(spark, sf_dir).groupBy("half", "scope", "cutoff").agg(
        scaled(F.sum(_rho_slope(lam1, lam2, rho)), 5).alias("slope"), F.min(P.rho_is_valid(rho, lam1, lam2)).alias("feasible")
    )


def _low_scores(spark, sf_dir) -> DataFrame:
    """Per pairing of every season-end fit with a dependence parameter: both rates and the weighted counts of low scores."""
    m = views.matches(spark, sf_dir)
    fits = season_fits(spark, sf_dir).filter("rho IS NOT NULL")
    halves = list(dict.fromkeys(c.half_life for c in ALL_RATED))
    corrected = [(i, h) for i, h in enumerate(halves) if any(c.dixon_coles and c.half_life == h for c in ALL_RATED)]
    half = F.explode(F.array(*[F.struct(F.lit(i).alias("half"), F.lit(h).cast("double").alias("hl")) for i, h in corrected])).alias("x")
    cut = season_cutoffs(m).groupBy("scope").agg(F.collect_set("cutoff").alias("cutoffs"))
    seen = F.explode(F.filter("cutoffs", lambda c: c > F.col("k"))).alias("cutoff")
    weight = P.decay_weight(F.col("cutoff") - F.col("k"), F.col("x.hl"))
    counts = pair_cells(m).join(cut, "scope").select("*", seen).select("*", half).groupBy("x.half", "scope", "cutoff", "home", "away").agg(
        *[F.sum(F.col(c) * weight).alias(c) for c in ("w00", "w01", "w10", "w11")]
    )
    return expected_goals(counts.join(fits, ["half", "scope", "cutoff"]), min_matches=1)


def _rho_slope(lam1: Column, lam2: Column, rho: Column) -> Column:
    return (
        F.col("w00") * -lam1 * lam2 / (1 - lam1 * lam2 * rho) + F.col("w01") * lam1 / (1 + lam1 * rho)
        + F.col("w10") * lam2 / (1 + lam2 * rho) - F.col("w11") / (1 - rho)
    )


@query("estimate_rho_distributed", ["m"], """SELECT DISTINCT half, scope, epoch_us(make_timestamp(season + 1, 1, 1, 0, 0, 0)) AS cutoff,
 CAST(0 AS BIGINT) AS slope, true AS feasible, true AS agrees FROM m CROSS JOIN (VALUES (0), (4)) h(half)""")
def estimate_rho_query(spark, sf_dir):
    """The same by grouped sums: slope zero and feasible at every scope, and within 1e-8 of the fit solved in a task."""
    ensure_checkpoint_dir(spark)
    rated = _low_scores(spark, sf_dir).withColumnRenamed("rho", "batched").checkpoint()
    keys = ["half", "scope", "cutoff"]
    found = estimate_rho_distributed(rated, keys)
    l1, l2, rho = F.col("lambda_home"), F.col("lambda_away"), F.col("rho")
    return rated.join(found, keys).groupBy(*keys).agg(
        scaled(F.sum(_rho_slope(l1, l2, rho)), 5).alias("slope"), F.min(P.rho_is_valid(rho, l1, l2)).alias("feasible"),
        F.max(F.abs(rho - F.col("batched")) < 1e-8).alias("agrees"),
    )


@query("fit_many")
def fit_many_query(spark, sf_dir):
    """Every fit of the walk-forward: five half-lives at every distinct kickoff."""
    fits = fit_many(views.matches(spark, sf_dir), CANDIDATES, min_training=MIN_TRAINING_MATCHES)
    return fits.select(
        "half", "scope", "cutoff", "training_matches", "converged", "sweeps",
        scaled("mu", 6).alias("mu"), scaled("home_advantage", 6).alias("home_advantage"), scaled("rho", 5).alias("rho"),
    )


@query("rating_history")
def rating_history(spark, sf_dir):
    """Attack and defence of every team at the start of every month, production profile."""
    m = views.matches(spark, sf_dir)
    production = PROFILES["production"]
    fits = fit_many(m, [production], backtest.month_cutoffs(m), MIN_TRAINING_MATCHES).filter("usable")
    return ratings_of(fits, production.min_matches).select(
        "scope", "cutoff", "team", scaled("attack", 6).alias("attack"), scaled("defence", 6).alias("defence"),
        "matches", "cold_start",
    )


@query("walk_forward", ["m"], """+ s AS (SELECT *, count(*) OVER (PARTITION BY scope ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM m),
 sd AS (SELECT scope, home AS team, k FROM m UNION ALL SELECT scope, away, k FROM m),
 ap AS (SELECT scope, team, k, count(*) OVER (PARTITION BY scope, team ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM sd),
 u AS (SELECT scope, team, k, min(c) AS c FROM ap GROUP BY ALL)
 SELECT s.id, n AS training_matches, true AS proper, concat_ws(',', CASE WHEN h.c < 4 THEN CAST(s.home AS VARCHAR) END,
 CASE WHEN a.c < 4 THEN CAST(s.away AS VARCHAR) END) AS cold FROM s JOIN u h ON h.scope = s.scope AND h.team = s.home AND h.k = s.k
 JOIN u a ON a.scope = s.scope AND a.team = s.away AND a.k = s.k WHERE n >= 30""")
def walk_forward(spark, sf_dir):
    """Each match predicted by the control fit at its own kickoff; window size, cold teams and proper triples are checkable."""
    scored = backtest.walk_forward(views.matches(spark, sf_dir), [PROFILES["control"]])
    total = F.col("p_home") + F.col("p_draw") + F.col("p_away")
    proper = (F.abs(total - 1) < 1e-9) & (F.least("p_home", "p_draw", "p_away") > 0)
    return scored.select("id", "training_matches", proper.alias("proper"), F.array_join("cold_started", ",").alias("cold"))


@query("candidate_grid")
def candidate_grid(spark, sf_dir):
    """All seven candidates walked forward on identical matches, with both baselines."""
    report = backtest.backtest_report(backtest.walk_forward(views.matches(spark, sf_dir), CANDIDATES))
    whole = {"candidate", "predictions", "fits", "first_prediction", "last_prediction", "cold_start"}
    return report.select(*[F.col(c) if c in whole else scaled(c, 6).alias(c) for c in report.columns])


@query("frozen_benchmark", ["m"], """+ s AS (SELECT scope, k, count(*) OVER (PARTITION BY scope ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM m)
 SELECT count(*) AS predictions, count(DISTINCT (scope, k)) AS fits, (SELECT count(*) FROM s WHERE n < 30) AS skipped,
 min(k) AS first_prediction, max(k) AS last_prediction FROM s WHERE n >= 30""")
def frozen_benchmark(spark, sf_dir):
    """The control's counts on this corpus; they must reproduce exactly."""
    m = views.matches(spark, sf_dir)
    report = backtest.backtest_report(backtest.walk_forward(m, [PROFILES["control"]]))
    counts = ["predictions", "fits", "first_prediction", "last_prediction"]
    total = m.agg(F.count(F.lit(1)).alias("total")).select("total", *[F.lit(None).cast("bigint").alias(c) for c in counts])
    merged = report.select(F.lit(None).cast("bigint").alias("total"), *counts).unionByName(total)
    return merged.agg(
        *[F.max(c).alias(c) for c in counts], (F.max("total") - F.max("predictions")).alias("skipped")
    )


@query("leakage_check", ["m"], "SELECT CAST(0 AS BIGINT) AS differing, (SELECT count(*) FROM m WHERE k < 915148800000000) > 0 AS compared")
def leakage_check(spark, sf_dir):
    """Predictions before 1999 do not move when everything from 1999 on is removed."""
    m = views.matches(spark, sf_dir)
    cut = 915148800000000

    def forecasts(rows: DataFrame) -> DataFrame:
        scored = backtest.walk_forward(rows, [PROFILES["production"]])
        return scored.filter(F.col("k") < cut).select("id", *[scaled(c, 12).alias(c) for c in ("p_home", "p_draw", "p_away")])

    whole, early = forecasts(m), forecasts(m.filter(F.col("k") < cut))
    both = whole.withColumnsRenamed({c: f"w_{c}" for c in whole.columns if c != "id"}).join(early, "id", "full_outer")
    differs = ~(
        F.col("p_home").eqNullSafe(F.col("w_p_home")) & F.col("p_draw").eqNullSafe(F.col("w_p_draw"))
        & F.col("p_away").eqNullSafe(F.col("w_p_away"))
    )
    return both.agg(F.coalesce(F.sum(differs.cast("bigint")), F.lit(0)).alias("differing"), (F.count(F.lit(1)) > 0).alias("compared"))
