"""The estimator against an independent scalar version, and the probability columns against closed forms."""

import ast
import math
import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import probability as P
from tidemark.model.calibrate import apply_isotonic, isotonic_blocks
from tidemark.model import backtest
from tidemark.model.fit import _Grid, _solve, fit_many, pair_cells, ratings_of
from tidemark.model.fit_large import fit_distributed
from tidemark.model.profiles import CANDIDATES, PROFILES, Config, profile

DAY = 86_400_000_000
MATCH = "id bigint, scope string, season int, home string, away string, hg int, ag int, k bigint"


def corpus(teams=6, rounds=3, seed=1, scope="x"):
    rng = random.Random(seed)
    out, day = [], 0
    for _ in range(rounds):
        for h in range(teams):
            for a in range(teams):
                if h != a:
                    out.append((len(out), scope, 2000 + day // 30, f"t{h}", f"t{a}", rng.randrange(0, 3 + h % 3), rng.randrange(0, 3), day * DAY))
                    day += 1
    return out


def scalar_fit(matches, cutoff, config):
    """Team-by-team coordinate ascent written for the test, one match at a time."""
    used = [m for m in matches if m[7] < cutoff]
    names = sorted({m[3] for m in used} | {m[4] for m in used})
    w = [1.0 if config.half_life is None else 0.5 ** ((cutoff - m[7]) / DAY / config.half_life) for m in used]
    goals = sum(x * (m[5] + m[6]) for x, m in zip(w, used))
    mu, ha = math.log(goals / (2 * sum(w))), 0.0
    att, dfn = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)

    def rate(attacker, defender, home):
        return math.exp(mu + (ha if home else 0.0) + att[attacker] - dfn[defender])

    for _ in range(config.max_sweeps):
        before = [mu, ha, *att.values(), *dfn.values()]
        mu += math.log(goals / sum(x * (rate(m[3], m[4], True) + rate(m[4], m[3], False)) for x, m in zip(w, used)))
        ha += math.log(sum(x * m[5] for x, m in zip(w, used)) / sum(x * rate(m[3], m[4], True) for x, m in zip(w, used)))
        for side, sign in ((att, 1), (dfn, -1)):
            for t in names:
                real = fitted = 0.0
                for x, m in zip(w, used):
                    for attacker, defender, scored, home in ((m[3], m[4], m[5], True), (m[4], m[3], m[6], False)):
                        if (attacker if sign == 1 else defender) == t:
                            real += x * scored
                            fitted += x * rate(attacker, defender, home)
                step = (sign * (real - fitted) - config.ridge * side[t]) / (fitted + config.ridge)
                side[t] += max(-2.0, min(2.0, step))
        shift_a, shift_d = sum(att.values()) / len(names), sum(dfn.values()) / len(names)
        for t in names:
            att[t] -= shift_a
            dfn[t] -= shift_d
        mu += shift_a - shift_d
        if max(abs(p - q) for p, q in zip(before, [mu, ha, *att.values(), *dfn.values()])) < config.tolerance:
            break
    return mu, ha, att, dfn


@pytest.mark.parametrize("half_life", [None, 20.0])
def test_batched_fit_equals_scalar_fit(spark, half_life):
    data = corpus()
    config = Config("t", half_life, min_matches=1)
    m = spark.createDataFrame(data, MATCH)
    asked = [40 * DAY, 61 * DAY, 90 * DAY]
    cutoffs = spark.createDataFrame([("x", c) for c in asked], "scope string, cutoff bigint")
    # Blocks of a week: the state crosses many block borders.
    fits = {r.cutoff: r for r in fit_many(m, [config], cutoffs, block_us=7 * DAY).collect()}
    for cutoff in asked:
        mu, ha, att, dfn = scalar_fit(data, cutoff, config)
        got = fits[cutoff]
        assert got.converged and got.training_matches == cutoff // DAY
        assert got.mu == pytest.approx(mu, abs=1e-9) and got.home_advantage == pytest.approx(ha, abs=1e-9)
        for t, a, d in zip(got.teams, got.attack, got.defence):
            assert a == pytest.approx(att[t], abs=1e-8) and d == pytest.approx(dfn[t], abs=1e-8)
        assert abs(sum(got.attack)) < 1e-9 and abs(sum(got.defence)) < 1e-9
        likelihood = 0.0
        for r in data:
            if r[7] < cutoff:
                lh, la = math.exp(mu + ha + att[r[3]] - dfn[r[4]]), math.exp(mu + att[r[4]] - dfn[r[3]])
                likelihood += r[5] * math.log(lh) - lh - math.lgamma(r[5] + 1) + r[6] * math.log(la) - la - math.lgamma(r[6] + 1)
        assert got.log_likelihood == pytest.approx(likelihood, abs=1e-6)


def test_places_of_pairings_do_not_change_a_fit():
    rng = np.random.default_rng(2)
    size, fits = 9, 4
    pairs = np.array([h * size + a for h in range(size) for a in range(size) if h != a and (h + 2 * a) % 5])
    flat, weighted = rng.integers(0, 4, (fits, len(pairs), 4)).astype(float), rng.uniform(0.1, 3.0, (fits, len(pairs), 7))
    flat[0, 20:] = weighted[0, 20:] = 0.0  # pairings that the first cutoff has not seen
    every, met = _Grid(size, pairs), _Grid(size, pairs)
    met.dense = False
    met.home, met.away = pairs // size, pairs % size
    met.turned = np.argsort(met.away, kind="stable")
    met.home_teams, met.home_starts = np.unique(met.home, return_index=True)
    met.away_teams, met.away_starts = np.unique(met.away[met.turned], return_index=True)
    assert every.dense and len(every.home) == size * size
    one, two = [_solve(g, g.placed(flat), g.placed(weighted), 0.1, 1e-10, 5000) for g in (every, met)]
    for name in ("mu", "ha", "attack", "defence", "log_likelihood", "appearances", "training"):
        assert one[name] == pytest.approx(two[name], abs=1e-9), name
    assert one["converged"].all() and two["converged"].all()


def test_thousands_of_teams_fit_in_one_task(spark):
    """5,000 teams, each against four others: 25 million cells, 20,000 pairings."""
    n, rng = 5000, random.Random(4)
    rows = [(h * 4 + i, "x", 2000, f"t{h}", f"t{(h + 1 + rng.randrange(n - 1)) % n}", (h * 7 + i) % 4, (h + i * i) % 3, (h % 50) * DAY) for h in range(n) for i in range(4)]
    config = Config("t", min_matches=1, max_sweeps=3000)
    cutoffs = spark.createDataFrame([("x", 1000 * DAY)], "scope string, cutoff bigint")
    fit = fit_many(spark.createDataFrame(rows, MATCH), [config], cutoffs).collect()[0]
    at = {t: i for i, t in enumerate(fit.teams)}
    home, away = np.array([at[r[3]] for r in rows]), np.array([at[r[4]] for r in rows])
    att, dfn = np.array(fit.attack), np.array(fit.defence)
    lam_h, lam_a = np.exp(fit.mu + fit.home_advantage + att[home] - dfn[away]), np.exp(fit.mu + att[away] - dfn[home])
    goals_h, goals_a = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    over = lambda x, y: np.bincount(home, x, n) + np.bincount(away, y, n)
    assert len(at) == n and fit.converged
    assert over(goals_h - lam_h, goals_a - lam_a) - config.ridge * att == pytest.approx(np.zeros(n), abs=1e-4)
    assert over(lam_a - goals_a, lam_h - goals_h) - config.ridge * dfn == pytest.approx(np.zeros(n), abs=1e-4)


def test_distributed_fit_equals_batched_fit(spark):
    config = Config("t", min_matches=1, tolerance=1e-6)
    m = spark.createDataFrame(corpus(4, 2) + corpus(4, 1, 9, "y"), MATCH)
    cutoffs = spark.createDataFrame([("x", 10_000 * DAY), ("y", 10_000 * DAY)], "scope string, cutoff bigint")
    small = {(r.scope, r.team): r for r in ratings_of(fit_many(m, [config], cutoffs), 1).collect()}
    pairs = pair_cells(m).groupBy("scope", "home", "away").agg(F.sum("wn").alias("w"), F.sum("wh").alias("wh"), F.sum("wa").alias("wa"))
    large = fit_distributed(pairs, config).collect()
    assert len(large) == len(small) and all(r.converged for r in large)
    for r in large:
        assert r.attack == pytest.approx(small[r.scope, r.team].attack, abs=1e-9)
        assert r.defence == pytest.approx(small[r.scope, r.team].defence, abs=1e-9)


def test_thin_teams_are_league_average_and_goalless_windows_unusable(spark):
    data = [(i, "x", 2000, "a", "b", 1, 0, i * DAY) for i in range(6)] + [(7, "x", 2000, "c", "a", 0, 2, 6 * DAY)]
    data += [(i, "dry", 2000, "a", "b", 0, 0, i * DAY) for i in range(5)]
    m = spark.createDataFrame(data, MATCH)
    cutoffs = spark.createDataFrame([("x", 100 * DAY), ("dry", 100 * DAY)], "scope string, cutoff bigint")
    fits = {r.scope: r for r in fit_many(m, [PROFILES["control"]], cutoffs).collect()}
    assert not fits["dry"].usable
    c = fits["x"].teams.index("c")
    assert fits["x"].attack[c] == 0.0 and fits["x"].matches[c] == 1


def test_walk_forward_never_sees_the_future(spark):
    data = corpus(6, 3)
    shocked = data + [(900 + i, "x", 2009, "t0", "t1", 15, 0, (95 + i) * DAY) for i in range(5)]

    def run(rows):
        out = backtest.walk_forward(spark.createDataFrame(rows, MATCH), CANDIDATES[:2] + CANDIDATES[5:6], block_us=11 * DAY)
        return {(r.candidate, r.id): (r.p_home, r.p_draw, r.lambda_home) for r in out.filter(F.col("k") < 90 * DAY).collect()}

    one, two = run(data), run(shocked)
    assert one.keys() == two.keys() and len(one) == 3 * 60
    for key in one:
        assert one[key] == pytest.approx(two[key], abs=1e-12)


def test_markets_against_brute_force(spark):
    cases = [(1.5, 1.2, 0.0), (0.3, 2.7, -0.1), (14.9, 14.0, 0.02), (1e-9, 1.0, 0.0), (2.0, 2.0, 0.9)]
    df = spark.createDataFrame(cases, "lambda_home double, lambda_away double, rho double")
    rows = P.with_markets(df.withColumn("i", F.monotonically_increasing_id()), rho="rho", scoreline=True).collect()
    for r in rows:
        lh, la = r.lambda_home, r.lambda_away
        grid = {(i, j): math.exp(-lh) * lh**i / math.factorial(i) * math.exp(-la) * la**j / math.factorial(j) for i in range(16) for j in range(16)}
        mass = sum(grid.values())
        low, high = max(-1 / lh, -1 / la) + 1e-6, min(1 / (lh * la), 1.0) - 1e-6
        rho = 0.0 if r.rho == 0 else min(max(r.rho, low), high)
        for cell, factor in (((0, 0), 1 - lh * la * rho), ((0, 1), 1 + lh * rho), ((1, 0), 1 + la * rho), ((1, 1), 1 - rho)):
            grid[cell] *= factor
        total = sum(grid.values())
        grid = {c: p / total for c, p in grid.items()}
        want = {
            "p_home": sum(p for (i, j), p in grid.items() if i > j), "p_draw": sum(p for (i, j), p in grid.items() if i == j),
            "p_away": sum(p for (i, j), p in grid.items() if i < j), "p_over_2_5": 1 - sum(p for (i, j), p in grid.items() if i + j < 2.5),
            "p_over_0_5": 1 - grid[0, 0], "p_btts_yes": sum(p for (i, j), p in grid.items() if i and j),
            "expected_home": sum(i * p for (i, j), p in grid.items()), "expected_away": sum(j * p for (i, j), p in grid.items()),
            "truncated_mass": max(0.0, 1 - mass),
        }
        for name, value in want.items():
            assert r[name] == pytest.approx(value, abs=1e-10), name
        assert r.scoreline == pytest.approx([grid[i, j] for i in range(16) for j in range(16)], abs=1e-12)
        assert r.low_score == pytest.approx([grid[c] for c in ((0, 0), (0, 1), (1, 0), (1, 1))], abs=1e-12)


def test_bad_rates_are_refused_and_missing_ones_stay_missing(spark):
    bad = spark.createDataFrame([(-1.0, 1.0)], "lambda_home double, lambda_away double")
    with pytest.raises(Exception, match="not a goal rate"):
        P.with_markets(bad).collect()
    none = spark.createDataFrame([(None, 1.0)], "lambda_home double, lambda_away double")
    assert P.with_markets(none).first().p_home is None


def test_uniform_forecast_scores(spark):
    from tidemark.model import metrics

    df = spark.createDataFrame([("home",), ("draw",), ("away",)], "outcome string").selectExpr("*", "1/3D AS p_home", "1/3D AS p_draw", "1/3D AS p_away")
    r = df.agg(F.avg(metrics.log_score(metrics.triple(), F.col("outcome"))).alias("l"), F.avg(metrics.brier_score(metrics.triple(), F.col("outcome"))).alias("b")).first()
    assert r.l == pytest.approx(math.log(3)) and r.b == pytest.approx(2 / 3)


def test_combined_candidate_takes_the_best_decay(spark):
    report = spark.createDataFrame([(c.name, loss) for c, loss in zip(CANDIDATES, (0.9, 1.1, 1.0, 0.98, 0.99, 0.5, 0.4))], "candidate string, log_loss double")
    chosen = backtest.combined_candidate(report, CANDIDATES)
    assert (chosen.half_life, chosen.dixon_coles, chosen.complexity) == (180.0, True, 2)


def test_unknown_profile_is_refused():
    with pytest.raises(ValueError):
        profile("best")


def test_model_never_imports_prices():
    root = pathlib.Path(__file__).parent.parent / "tidemark" / "model"
    for path in root.glob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("odds" in n for n in names), path


def test_isotonic_blocks_equal_the_min_max_formula(spark):
    rng = np.random.default_rng(5)
    rows = [(m, int(at), int(rng.random() < at / 60)) for m in ("a", "b", None) for at in rng.integers(0, 50, 300)]
    past = spark.createDataFrame([*rows, ("a", None, 1), ("b", 3, None), ("one", 7, 1)], "market string, at long, label long")
    blocks = isotonic_blocks(past, ["market"], "at", "label").collect()
    for market in ("a", "b", None):
        x = np.array([[at, y] for m, at, y in rows if m == market])
        values = np.unique(x[:, 0])
        mean = {(a, b): x[(x[:, 0] >= a) & (x[:, 0] <= b), 1].mean() for a in values for b in values if a <= b}
        want = [max(min(mean[a, b] for b in values if b >= v) for a in values if a <= v) for v in values]
        own = [r for r in blocks if r["market"] == market]
        assert np.allclose([next(r["hits"] / r["rows"] for r in own if r["low"] <= v <= r["high"]) for v in values], want)
        assert len(own) == len(set(np.round(want, 12))) and sum(r["rows"] for r in own) == len(x)
    table = spark.createDataFrame([tuple(r) for r in blocks], "market string, low long, high long, rows long, hits long")
    future = spark.createDataFrame([("one", 0), ("one", 90), ("one", None), ("new", 5), (None, 0), (None, 0)], "market string, at long")
    out = [(r["market"], r["p"]) for r in apply_isotonic(future, table, ["market"], "at", "p", 2).collect()]
    low = min((r for r in blocks if r["market"] is None), key=lambda r: r["low"])
    assert sorted(out, key=repr) == sorted([("one", 1.0), ("one", 1.0), ("one", None), ("new", None)] + [(None, low["hits"] / low["rows"])] * 2, key=repr)
    assert isotonic_blocks(past.limit(0), ["market"], "at", "label").count() == 0


def test_scorelines_are_checked_by_array_and_fixtures_not_dealt_by_scope(spark, sf):
    """Markets of stored scorelines come from one product per batch; forecasts join their few fits without a shuffle by scope."""
    from tidemark.functions.rules import prediction_rules
    from tidemark.plans import catalog

    plan = lambda name: catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan("markets_match") and "hashpartitioning(scope" not in plan("prediction_artifact")
    df = spark.createDataFrame([(1, 1.3, 0.9, -0.1), (2, 2.0, 1.1, 0.0), (3, None, 1.0, 0.0)], "id int, lambda_home double, lambda_away double, rho double")
    cells = P.with_markets(df, rho="rho", scoreline=True).withColumn(
        "scoreline", F.expr("CASE id WHEN 2 THEN transform(scoreline, (p, i) -> IF(i = 40, p + 0.5D, p)) ELSE scoreline END")
    )
    assert {r.id: r.ok for r in cells.select("id", P.markets_match().alias("ok")).collect()} == {1: True, 2: False, 3: None}
    short = cells.withColumn("scoreline", F.expr("slice(scoreline, 1, 200)"))
    assert {r.ok for r in short.select(P.markets_match().alias("ok")).collect()} == {None}
    odd = spark.createDataFrame([([0.5, 0.5],), ([1.5, None],), ([0.5, None],), ([],), (None,), ([-0.1, 1.1],), ([float("nan")],)], "scoreline array<double>")
    names = [c for c in cells.columns if c.startswith("p_")]
    odd = odd.withColumns({c: F.lit(0.5) for c in names} | {"lambda_home": F.lit(1.0), "lambda_away": F.lit(1.0), "truncated_mass": F.lit(0.0)})
    assert [r[0] for r in odd.select(prediction_rules()["cell_out_of_range"]).collect()] == [False, True, None, False, None, True, True]


def test_markets_fold_four_goal_counts_at_a_time(spark):
    df = spark.createDataFrame([(0.3, 2.5), (1.7, 1.1), (6.0, 4.0)], "lambda_home double, lambda_away double")
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    text = P.with_markets(df)._jdf.queryExecution().analyzed().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    folded = text[text.index("aggregate(array("):text.index("lambdafunction", text.index("aggregate(array("))]
    assert folded.count("struct(h, ") == 4 + 1  # four blocks of sixteen counts, and the start
    for top in (4, 6, 15):
        for r in P.with_markets(df, max_goals=top).collect():
            mass = [[math.exp(-lam) * lam**k / math.factorial(k) for k in range(top + 1)] for lam in (r.lambda_home, r.lambda_away)]
            cells = np.outer(*mass) / np.outer(*mass).sum()
            assert r.p_home == pytest.approx(np.tril(cells, -1).sum(), rel=1e-12) and r.p_draw == pytest.approx(np.trace(cells), rel=1e-12)


def test_spread_fit_equals_the_fit_in_a_task(spark):
    """A scope with goals and one without; no row holds a scope's teams."""
    rows = [(s, f"t{i}", f"t{(i * 7 + j * 11 + 1) % 40}", (i * 3 + j * 5 + len(s)) % 4, (i + j * j) % 3, (j * 40 + i) * DAY // 8)
            for s in ("a",) for i in range(40) for j in range(6) if (i * 7 + j * 11 + 1) % 40 != i]
    rows += [("none", "x", "y", 0, 0, 0), ("none", "y", "x", 0, 0, DAY)]
    m = spark.createDataFrame(rows, "scope string, home string, away string, hg int, ag int, k bigint")
    cutoffs = spark.createDataFrame([("a", 25 * DAY), ("none", 40 * DAY)], "scope string, cutoff bigint")
    configs = [Config(str(h), h, min_matches=6, ridge=0.5, tolerance=1e-6, max_sweeps=3000) for h in (None, 20.0)]
    key = lambda r: (r.half, r.scope, r.cutoff)
    whole = fit_many(m, configs, cutoffs)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spread = fit_many(m, configs, cutoffs, spread=True)
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive and whole.schema.names == spread.schema.names
    want, got = {key(r): r for r in whole.collect()}, {}
    for r in spread.collect():
        got.setdefault(key(r), []).append(r)
    assert set(want) == set(got) and len(want) == 4
    for k, parts in got.items():
        w = want[k]
        assert all(len(p.teams) < len(w.teams) for p in parts) or len(w.teams) <= 2
        rated = {t: v for p in parts for t, *v in zip(p.teams, p.attack, p.defence, p.matches)}
        assert sorted(rated) == sorted(w.teams) and sum(len(p.teams) for p in parts) == len(w.teams)
        for t, *v in zip(w.teams, w.attack, w.defence, w.matches):
            assert rated[t] == pytest.approx(v, abs=1e-4)
        for p in parts:
            assert (p.usable, p.converged, p.training_matches, p.rho) == (w.usable, w.converged, w.training_matches, w.rho)
            assert (p.mu, p.home_advantage, p.log_likelihood) == pytest.approx((w.mu, w.home_advantage, w.log_likelihood), abs=1e-3)
