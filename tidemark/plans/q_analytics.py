"""Registered queries: tables, form, settlement, provider comparison, post-ingest rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.probability import OVER_UNDER_LINES, line_name, with_markets
from tidemark.model import metrics
from tidemark.model.calibrate import apply_isotonic, isotonic_blocks, platt, probability_steps
from tidemark.operators import analytics as A
from tidemark.operators import odds as O
from tidemark.operators import quality, quarantine
from tidemark.operators.ordered import neighbours
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans import views
from tidemark.plans.jobs import staged
from tidemark.plans.q_evaluation import MOMENT_SQL, moment_scored
from tidemark.plans.q_forecast import RATES_SQL, rates
from tidemark.plans.q_temporal import CANONICAL_SQL, PREDICTIONS_SQL, canonical, stored_predictions
from tidemark.plans.registry import query, scaled, sql_scaled
from tidemark.plans.views import DAY_US, HOUR_US
from tidemark.session import shared_dir

_SIDE_SQL = """+ sd AS (SELECT id, scope, season, k, home AS team, 1 AS at_home, hg AS gf, ag AS ga FROM m UNION ALL SELECT id, scope, season, k, away, 0, ag, hg FROM m),
 sp AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS points FROM sd)
"""


@query("standings", ["m"], _SIDE_SQL + """, t AS (SELECT scope, season, team, count(*) AS played, count(*) FILTER (gf > ga) AS won, count(*) FILTER (gf = ga) AS drawn,
 count(*) FILTER (gf < ga) AS lost, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, CAST(sum(points) AS BIGINT) AS points FROM sp GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY scope, season ORDER BY points DESC, gf - ga DESC, gf DESC, team) AS position FROM t""")
def standings(spark, sf_dir):
    return A.standings(views.matches(spark, sf_dir))


_W5 = "OVER (PARTITION BY scope, team ORDER BY k ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_W10 = "OVER (PARTITION BY scope, team ORDER BY k ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
_WS = "OVER (PARTITION BY scope, team, season ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("form_snapshot", ["m"], _SIDE_SQL + f""", i AS (SELECT scope, team, season, k, count(*) AS games, sum(points) AS points, sum(gf) AS gf, sum(ga) AS ga,
  count(*) FILTER (ga = 0) AS cs, sum(at_home) AS hgames, sum(points * at_home) AS hpoints FROM sp GROUP BY ALL)
 SELECT scope, team, k, season, CAST(coalesce(sum(games) {_W5}, 0) AS BIGINT) AS last5_games, CAST(coalesce(sum(points) {_W5}, 0) AS BIGINT) AS last5_points,
 CAST(coalesce(sum(gf) {_W10}, 0) AS BIGINT) AS last10_gf, CAST(coalesce(sum(ga) {_W10}, 0) AS BIGINT) AS last10_ga, CAST(coalesce(sum(cs) {_W10}, 0) AS BIGINT) AS last10_clean_sheets,
 CAST(coalesce(sum(points) {_WS}, 0) AS BIGINT) AS season_points, CAST(coalesce(sum(hgames) {_WS}, 0) AS BIGINT) AS season_home_games,
 CAST(coalesce(sum(hpoints) {_WS}, 0) AS BIGINT) AS season_home_points FROM i""")
def form_snapshot(spark, sf_dir):
    return A.form_snapshot(views.matches(spark, sf_dir)).select(
        "scope", "team", "k", "season", "last5_games", "last5_points", "last10_gf", "last10_ga", "last10_clean_sheets",
        "season_points", "season_home_games", "season_home_points",
    )


@query("settle", ["m"], CANONICAL_SQL + f""", s(market_type, line, selection) AS (VALUES ('1x2', NULL, 'home'), ('1x2', NULL, 'draw'), ('1x2', NULL, 'away'),
  ('over_under', 2.5, 'over'), ('over_under', 2.0, 'under'), ('btts', NULL, 'yes'), ('asian_handicap', -0.75, 'home'), ('asian_handicap', 1.0, 'away')),
 o AS (SELECT fixture_id || '/' || market_type || '/' || selection AS series_id, known_at, ft_home AS h, ft_away AS a, line, selection, market_type, CASE market_type
  WHEN '1x2' THEN CASE WHEN selection = CASE WHEN ft_home > ft_away THEN 'home' WHEN ft_home = ft_away THEN 'draw' ELSE 'away' END THEN 'won' ELSE 'lost' END
  WHEN 'over_under' THEN CASE WHEN ft_home + ft_away = line THEN 'void' WHEN (ft_home + ft_away > line) = (selection = 'over') THEN 'won' ELSE 'lost' END
  WHEN 'btts' THEN CASE WHEN (ft_home > 0 AND ft_away > 0) = (selection = 'yes') THEN 'won' ELSE 'lost' END
  ELSE CASE (CASE WHEN selection = 'home' THEN ft_home - ft_away + line ELSE -(ft_home - ft_away + line) END) WHEN 0 THEN 'void' WHEN 0.25 THEN 'half_won' WHEN -0.25 THEN 'half_lost'
   ELSE CASE WHEN (CASE WHEN selection = 'home' THEN ft_home - ft_away + line ELSE -(ft_home - ft_away + line) END) > 0 THEN 'won' ELSE 'lost' END END END AS outcome
  FROM res CROSS JOIN s),
 l AS (SELECT *, lag(outcome) OVER (PARTITION BY series_id ORDER BY known_at) AS p FROM o)
 SELECT series_id, outcome, known_at, lead(known_at) OVER (PARTITION BY series_id ORDER BY known_at) AS superseded_at FROM l WHERE p IS NULL OR p <> outcome""")
def settle(spark, sf_dir):
    """Eight selections per fixture settled on the result as known, and again when a correction changes the outcome."""
    listed = (("1x2", None, "home"), ("1x2", None, "draw"), ("1x2", None, "away"), ("over_under", 2.5, "over"), ("over_under", 2.0, "under"),
              ("btts", None, "yes"), ("asian_handicap", -0.75, "home"), ("asian_handicap", 1.0, "away"))
    tables = canonical(spark, sf_dir)
    series = tables["fixtures"].select("fixture_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("market_type"), F.lit(x).cast("double").alias("line"), F.lit(s).alias("selection")) for m, x, s in listed
    ])).alias("s")).select("fixture_id", "s.*").withColumn("series_id", F.concat_ws("/", "fixture_id", "market_type", "selection"))
    return A.settlements(series, tables["results"]).select("series_id", "outcome", "known_at", "superseded_at")


def _market_sql() -> str:
    parts = ["SELECT id, '1x2' AS market_type, NULL AS line, 'home' AS selection, sum(q) FILTER (i > j) / sum(q) AS p FROM p GROUP BY id",
             "SELECT id, '1x2', NULL, 'draw', sum(q) FILTER (i = j) / sum(q) FROM p GROUP BY id", "SELECT id, '1x2', NULL, 'away', sum(q) FILTER (i < j) / sum(q) FROM p GROUP BY id",
             "SELECT id, 'btts', NULL, 'yes', sum(q) FILTER (i > 0 AND j > 0) / sum(q) FROM p GROUP BY id",
             "SELECT id, 'btts', NULL, 'no', 1 - sum(q) FILTER (i > 0 AND j > 0) / sum(q) FROM p GROUP BY id"]
    for line in OVER_UNDER_LINES:
        under = f"sum(q) FILTER (i + j < {line}) / sum(q)"
        parts += [f"SELECT id, 'over_under', {line}, 'over', 1 - {under} FROM p GROUP BY id", f"SELECT id, 'over_under', {line}, 'under', {under} FROM p GROUP BY id"]
    return " UNION ALL ".join(parts)


@query("markets_long", ["m"], RATES_SQL + f", k AS ({_market_sql()}) SELECT id, market_type, CAST(line * 10 AS INT) AS line10, selection, {sql_scaled('p', 8)} AS probability, {sql_scaled('1 / p', 5)} AS fair_odds FROM k")
def markets_long(spark, sf_dir):
    out = A.markets_long(with_markets(rates(spark, sf_dir)), "id")
    return out.select(
        "id", "market_type", (F.col("line") * 10).cast("int").alias("line10"), "selection", scaled("probability", 8).alias("probability"), scaled("fair_odds", 5).alias("fair_odds")
    )


@query("invalidate_on_reschedule", ["m"], PREDICTIONS_SQL.rstrip() + f""", mv AS (SELECT id AS fixture_id, k - {int(2.5 * DAY_US)} AS at FROM m WHERE id % 6 = 0)
 SELECT p.fixture_id, p.known_at, least(superseded_at, CASE WHEN mv.at > p.known_at THEN mv.at END) AS superseded_at FROM pred p LEFT JOIN mv USING (fixture_id)""")
def invalidate_on_reschedule(spark, sf_dir):
    """Every sixth fixture is moved by two days, every fifth by an hour, two and a half days before kickoff."""
    moves = views.matches(spark, sf_dir).selectExpr("id AS fixture_id", f"""explode(array(
        struct(k - {30 * DAY_US} AS known_at, k - CASE WHEN id % 6 = 0 THEN {2 * DAY_US} WHEN id % 5 = 0 THEN {HOUR_US} ELSE 0 END AS kickoff),
        struct(k - {int(2.5 * DAY_US)} AS known_at, k AS kickoff))) AS r""").select("fixture_id", "r.*")
    out = A.invalidated_by_reschedule(stored_predictions(spark, sf_dir), moves, DAY_US)
    return out.select("fixture_id", "known_at", "superseded_at")


@query("majority_vote", ["m"], """+ v AS (SELECT id, 'hg' AS field, s, CASE WHEN (id + s) % 5 = 0 THEN hg + 1 WHEN (id + s) % 7 = 0 THEN NULL ELSE hg END AS value FROM m CROSS JOIN (VALUES (0), (1), (2)) t(s)
  UNION ALL SELECT id, 'ag', s, CASE WHEN (id * 3 + s) % 4 = 0 THEN ag + s + 1 ELSE ag END FROM m CROSS JOIN (VALUES (0), (1), (2)) t(s)),
 c AS (SELECT id, field, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL),
 r AS (SELECT *, max(n) OVER (PARTITION BY id, field) AS top, sum(n) OVER (PARTITION BY id, field) AS sources, count(*) OVER (PARTITION BY id, field) AS vals FROM c)
 SELECT id, field, CASE WHEN count(*) FILTER (n = top) = 1 THEN min(value) FILTER (n = top) END AS value, CAST(any_value(sources) AS BIGINT) AS sources,
 any_value(vals) > 1 AS disputed, count(*) FILTER (n = top) > 1 AS review FROM r GROUP BY id, field""")
def majority_vote(spark, sf_dir):
    """Three providers report each score; some are wrong, some are silent."""
    m = views.matches(spark, sf_dir).select("id", "hg", "ag", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("source"))
    home = F.when((F.col("id") + F.col("source")) % 5 == 0, F.col("hg") + 1).when((F.col("id") + F.col("source")) % 7 != 0, F.col("hg"))
    away = F.when((F.col("id") * 3 + F.col("source")) % 4 == 0, F.col("ag") + F.col("source") + 1).otherwise(F.col("ag"))
    cells = m.select("id", "source", F.explode(F.array(
        F.struct(F.lit("hg").alias("field"), home.alias("value")), F.struct(F.lit("ag").alias("field"), away.alias("value"))
    )).alias("c")).select("id", "source", "c.*")
    return A.majority_vote(cells, ["id", "field"])


@query("bakeoff_metrics", ["m"], f"""+ f AS (SELECT scope, CASE WHEN id % 97 <> 0 THEN id END AS id, CASE WHEN id % 10 = 0 THEN hg + 1 ELSE hg END AS hg, ag,
  k + CASE id % 8 WHEN 0 THEN 600000000 WHEN 1 THEN 3600000000 ELSE 0 END AS k, CASE WHEN id % 4 <> 0 THEN hg * 3 + 2 END AS shots, hg + CASE WHEN id % 9 = 0 THEN 9 ELSE 0 END AS sot,
  CASE WHEN id % 3 = 0 THEN (hg + ag) * 1.1::DOUBLE + (id % 5) / 10.0::DOUBLE END AS xg, k + (110 + id % 60) * 60000000 AS arrived FROM m WHERE id % 13 <> 0),
 j AS (SELECT f.*, m.hg AS th, m.ag AS ta, m.k AS tk FROM f LEFT JOIN m ON m.id = f.id),
 e AS (SELECT scope, count(*) AS expected FROM m GROUP BY scope)
 SELECT scope, count(*) AS rows, any_value(expected) AS expected, count(DISTINCT id) AS found, {sql_scaled('count(tk) / count(*)', 6)} AS "precision",
 {sql_scaled('count(*) FILTER (hg = th AND ag = ta) / count(tk)', 6)} AS full_time_accuracy, {sql_scaled('count(*) FILTER (k = tk) / count(tk)', 6)} AS kickoff_exact,
 {sql_scaled('count(*) FILTER (abs(k - tk) <= 900000000) / count(tk)', 6)} AS kickoff_within_15, {sql_scaled('count(shots) / count(*)', 6)} AS shots_fill,
 {sql_scaled('count(*) FILTER (sot <= shots) / count(shots)', 6)} AS plausible, {sql_scaled('sum(xg) FILTER (tk IS NOT NULL) / sum(th + ta) FILTER (xg IS NOT NULL)', 6)} AS xg_ratio,
 {sql_scaled('corr(xg, CAST(th + ta AS DOUBLE))', 6)} AS xg_correlation, {sql_scaled('quantile_cont((arrived - tk) / 6e7, 0.5)', 4)} AS latency_median,
 {sql_scaled('quantile_cont((arrived - tk) / 6e7, 0.95)', 4)} AS latency_p95, {sql_scaled('count(DISTINCT id) / any_value(expected)', 6)} AS recall FROM j JOIN e USING (scope) GROUP BY scope""")
def bakeoff_metrics(spark, sf_dir):
    """A provider feed with gaps, phantoms, wrong scores and moved kickoffs against the truth."""
    m = views.matches(spark, sf_dir)
    feed = m.filter("id % 13 <> 0").selectExpr(
        "scope", "CASE WHEN id % 97 <> 0 THEN id END AS id", "CASE WHEN id % 10 = 0 THEN hg + 1 ELSE hg END AS hg", "ag",
        "k + CASE id % 8 WHEN 0 THEN 600000000 WHEN 1 THEN 3600000000 ELSE 0 END AS k", "CASE WHEN id % 4 <> 0 THEN hg * 3 + 2 END AS shots",
        "hg + CASE WHEN id % 9 = 0 THEN 9 ELSE 0 END AS shots_on_target", "CASE WHEN id % 3 = 0 THEN (hg + ag) * 1.1D + (id % 5) / 10D END AS xg",
        "k + (110 + id % 60) * 60000000 AS arrived_at",
    )
    out = A.feed_metrics(m.select("id", "scope", "hg", "ag", "k"), feed, "id", ["scope"])
    whole = {"scope", "rows", "expected", "found"}
    return out.select(*[F.col(c) if c in whole else scaled(c, 4 if c.startswith("latency") else 6).alias(c) for c in out.columns])


@query("post_ingest_rules", ["m", "books", "aliases"], """SELECT 'alias names several teams' AS rule, count(*) AS n FROM (SELECT alias_norm FROM aliases GROUP BY alias_norm HAVING count(DISTINCT team_id) > 1)
 UNION ALL SELECT 'duplicate fixture', count(*) FROM (SELECT season, home, away, k // 86400000000 FROM m GROUP BY ALL HAVING count(*) > 1)
 UNION ALL SELECT 'odds out of range', count(*) FROM books WHERE least(home_c, draw_c, away_c) <= 101 OR greatest(home_c, draw_c, away_c) > 100000 OR id % 500 = 0
 UNION ALL SELECT 'overround out of range', count(*) FROM books WHERE NOT (100.0::DOUBLE / home_c + 100.0::DOUBLE / draw_c + 100.0::DOUBLE / away_c BETWEEN 1.0 AND 1.3)
 UNION ALL SELECT 'result without fixture', count(*) FROM m WHERE id % 1000 = 7
 UNION ALL SELECT 'scheduled but long past', count(*) FROM m WHERE id % 40 = 0 AND k < 996700000000000 - 86400000000""")
def post_ingest_rules(spark, sf_dir):
    """Violations per rule after an ingest; the union itself is what the quarantine table holds."""
    m, books = views.matches(spark, sf_dir), views.books(spark, sf_dir)
    prices = books.withColumns({f"{s}_c": F.when(F.col("id") % 500 == 0, F.lit(100)).otherwise(F.col(f"{s}_c")) for s in ("home",)})
    low, high = F.least("home_c", "draw_c", "away_c"), F.greatest("home_c", "draw_c", "away_c")
    over = O.total(O.raw_probabilities(F.array(*[F.col(f"{s}_c") / F.lit(100.0) for s in ("home", "draw", "away")])))
    aliases = views.aliases(spark, sf_dir)
    fixtures = m.filter("id % 1000 <> 7").select("id")
    parts = {
        "alias names several teams": aliases.groupBy("alias_norm").agg(F.count_distinct("team_id").alias("n")).filter("n > 1").select("alias_norm"),
        "duplicate fixture": m.groupBy("season", "home", "away", F.floor(F.col("k") / DAY_US).alias("day")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"),
        "odds out of range": prices.filter((low <= 101) | (high > 100000)).select("id", "book"),
        "overround out of range": books.filter(~over.between(1.0, 1.3)).select("id", "book"),
        "result without fixture": quality.orphans(m.select("id"), "id", fixtures, "id"),
        "scheduled but long past": m.filter((F.col("id") % 40 == 0) & (F.col("k") < 996700000000000 - DAY_US)).select("id"),
    }
    return A.union_violations(parts).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("exact_quantiles", ["ticks"], "+ r AS (SELECT price_kind, source, known_at, row_number() OVER (PARTITION BY price_kind, source ORDER BY known_at) - 1 AS i, count(*) OVER (PARTITION BY price_kind, source) - 1 AS n FROM ticks) SELECT price_kind, source, "
       + ", ".join(f"max(known_at) FILTER (i = floor({q}::DOUBLE * n)) AS p{int(q * 100):02d}" for q in (0.05, 0.5, 0.95)) + " FROM r GROUP BY price_kind, source")
def exact_quantiles_query(spark, sf_dir):
    """When ticks of each kind and source became known, to the microsecond."""
    return exact_quantiles(views.ticks(spark, sf_dir), ["price_kind", "source"], "known_at", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, lower=True)


@query("quarantine_closure", ["m", "books"], """+ f AS (SELECT id, CASE WHEN id % 4 <> 0 THEN id - id % 4 WHEN id % 32 <> 0 THEN id - 4 END AS replay_of, hg + ag AS goals FROM m),
 it AS (SELECT id AS hit_id, 0 AS hops FROM f WHERE goals >= 6 UNION SELECT f.id, hops + 1 FROM it, f WHERE replay_of = hit_id),
 gone AS (SELECT hit_id AS id, min(hops) AS hops FROM it GROUP BY 1),
 rows AS (SELECT 'fixtures' AS part, id, hops FROM f LEFT JOIN gone USING (id)
  UNION ALL SELECT 'results', id, hops + 1 FROM m LEFT JOIN gone USING (id)
  UNION ALL SELECT 'prices', id, CASE WHEN home_c <= 125 THEN 0 ELSE hops + 1 END FROM books LEFT JOIN gone USING (id))
 SELECT part, hops IS NOT NULL AS quarantined, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, CAST(sum(hops) AS BIGINT) AS hops FROM rows GROUP BY ALL""")
def quarantine_closure(spark, sf_dir):
    """Fixtures with unlikely scores go, and with them their replays, and the results and prices of all of these."""
    m, books = views.matches(spark, sf_dir), views.books(spark, sf_dir)
    i = F.col("id")
    replay_of = F.when(i % 4 != 0, i - i % 4).when(i % 32 != 0, i - 4)
    tables = {"fixtures": m.select("id", replay_of.alias("replay_of"), (F.col("hg") + F.col("ag")).alias("goals")), "results": m.select("id", "hg", "ag"), "prices": books.select("id", "book", "home_c")}
    keys = {"fixtures": ["id"], "results": ["id"], "prices": ["id", "book"]}
    refused = {"fixtures": tables["fixtures"].filter("goals >= 6").select("id", F.lit("unlikely score").alias("rule")), "prices": books.filter("home_c <= 125").select("id", "book", F.lit("price out of range").alias("rule"))}
    references = [quarantine.Reference("fixtures", "replay_of", "fixtures"), quarantine.Reference("results", "id", "fixtures"), quarantine.Reference("prices", "id", "fixtures")]
    accepted, kept_back = quarantine.split(tables, keys, quarantine.closure(tables, keys, refused, references))
    root = f"{shared_dir(spark)}/quarantine-{uuid.uuid4().hex}"
    quarantine.write(accepted, kept_back, root)
    out = None
    for half in ("accepted", "quarantine"):
        for name in tables:
            df = spark.read.parquet(f"{root}/{half}/{name}")
            hops = F.col("hops") if half == "quarantine" else F.lit(None).cast("int")
            part = df.select(F.lit(name).alias("part"), F.lit(half == "quarantine").alias("quarantined"), "id", hops.alias("hops"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("part", "quarantined").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.sum("hops").alias("hops"))


@query("calibrate")
def calibrate(spark, sf_dir):
    """Home-win probability recalibrated on development seasons, scored on the held-out ones."""
    scored = moment_scored(spark, sf_dir).filter("candidate = 'A'").select(
        "id", "season", "p_home", (F.col("outcome") == "home").cast("double").alias("label")
    )
    dev = F.col("season").isin(*views.DEVELOPMENT_SEASONS)
    scored = staged(scored.withColumn("at", probability_steps(F.col("p_home"))), "forecasts")  # read four times
    out = platt(scored.filter(dev), scored.filter(~dev), "p_home", "label", "p_platt")
    out = apply_isotonic(out, isotonic_blocks(scored.filter(dev), [], "at", "label"), [], "at", "p_isotonic")

    def loss(p: str):
        kept = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.avg(-F.when(F.col("label") == 1, F.ln(kept)).otherwise(F.ln(1 - kept)))

    return out.groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), *[scaled(loss(p), 5).alias(f"loss_{p}") for p in ("p_home", "p_platt", "p_isotonic")]
    )


_CALIBRATED_MARKETS = {
    "home": ("p_home", "ph", "hg > ag"), "draw": ("p_draw", "pd", "hg = ag"), "away": ("p_away", "pa", "hg < ag"),
    "over_2_5": ("p_over_2_5", "po", "hg + ag > 2"), "under_2_5": ("1 - p_over_2_5", "1 - po", "hg + ag <= 2"), "both_score": ("p_btts_yes", "pb", "hg > 0 AND ag > 0"),
}


def market_forecasts(spark, sf_dir, digits: int) -> DataFrame:
    """Each match's six forecast probabilities, one row a market: id, season, market, at (10^-digits), label."""
    listed = ", ".join(f"struct('{name}' AS market, {p} AS p, CAST({won} AS BIGINT) AS label)" for name, (p, _, won) in _CALIBRATED_MARKETS.items())
    rows = moment_scored(spark, sf_dir).filter("candidate = 'A'").select("id", "season", F.expr(f"explode(array({listed}))").alias("v"))
    return staged(rows.select("id", "season", "v.market", probability_steps(F.col("v.p"), digits).alias("at"), "v.label"), "forecasts")


# The fitted mean at a value is the largest, over runs that begin at or before it, of the smallest mean of such a run that ends at or after it.
_ISOTONIC_SQL = MOMENT_SQL.replace(" scored AS (", """ pm AS (SELECT scope, k, 1 - sum(q) FILTER (i + j < 2.5) / sum(q) AS po, sum(q) FILTER (i > 0 AND j > 0) / sum(q) AS pb FROM raw WHERE candidate = 'A' GROUP BY scope, k),
 scored AS (""") + ", lg AS (" + " UNION ALL ".join(
    f"SELECT id, season, '{name}' AS market, {sql_scaled(p, 3)} AS x, CAST({won} AS BIGINT) AS y FROM scored JOIN pm USING (scope, k) WHERE candidate = 'A'" for name, (_, p, won) in _CALIBRATED_MARKETS.items()
) + """), pt AS (SELECT market, x, count(*) AS n, CAST(sum(y) AS BIGINT) AS s FROM lg WHERE season IN (1995, 1996, 1997, 1998) GROUP BY market, x),
 cu AS (SELECT *, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM pt WINDOW w AS (PARTITION BY market ORDER BY x)),
 lo AS (SELECT a.market, a.x AS a, b.x AS x, min((b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE) OVER (PARTITION BY a.market, a.x ORDER BY b.x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v
  FROM cu a JOIN cu b ON a.market = b.market AND a.x <= b.x),
 fitted AS (SELECT market, x, max(v) AS v FROM lo GROUP BY market, x),
 bl AS (SELECT market, min(x) AS low, max(x) AS high, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(s) AS BIGINT) AS hits FROM fitted JOIN pt USING (market, x) GROUP BY market, v)
"""


@query("isotonic_markets", ["m"], _ISOTONIC_SQL + "SELECT * FROM bl")
def isotonic_markets(spark, sf_dir):
    """Monotone fits of all six markets at once on the development seasons; forecasts are published to three digits."""
    rows = market_forecasts(spark, sf_dir, 3).filter(F.col("season").isin(*views.DEVELOPMENT_SEASONS))
    return isotonic_blocks(rows, ["market"], "at", "label")


@query("calibrate_markets", ["m"], _ISOTONIC_SQL + f""", sg AS (SELECT *, hits::DOUBLE / rows AS m, lead(low) OVER w AS nl, lead(hits::DOUBLE / rows) OVER w AS nm, lag(low) OVER w IS NULL AS is_first FROM bl WINDOW w AS (PARTITION BY market ORDER BY low)),
 c AS (SELECT lg.*, CASE WHEN nl IS NULL OR x <= high THEN m ELSE m + (nm - m) * ((x - high)::DOUBLE / (nl - high)) END AS p
  FROM lg JOIN sg ON lg.market = sg.market AND (is_first OR x >= low) AND (nl IS NULL OR x < nl) WHERE season NOT IN (1995, 1996, 1997, 1998))
 SELECT market, season, count(*) AS n, {sql_scaled('avg((x / 1000.0::DOUBLE - y) * (x / 1000.0::DOUBLE - y))', 6)} AS brier_raw, {sql_scaled('avg((p - y) * (p - y))', 6)} AS brier_isotonic FROM c GROUP BY ALL""")
def calibrate_markets(spark, sf_dir):
    """All six markets recalibrated on the development seasons and scored on the others, before and after."""
    rows = market_forecasts(spark, sf_dir, 3)
    dev = F.col("season").isin(*views.DEVELOPMENT_SEASONS)
    out = apply_isotonic(rows.filter(~dev), isotonic_blocks(rows.filter(dev), ["market"], "at", "label"), ["market"], "at", "p", 3)
    square = lambda p: scaled(F.avg((p - F.col("label")) * (p - F.col("label"))), 6)
    return out.groupBy("market", "season").agg(
        F.count(F.lit(1)).alias("n"), square(F.col("at") / 1000).alias("brier_raw"), square(F.col("p")).alias("brier_isotonic")
    )
