"""Interval joins, ranks, quarantine, ordered reads with NULL keys and ties, and the distributed dependence parameter."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.model.fit import _estimate_rho
from tidemark.model.rho_large import estimate_rho_distributed
from tidemark.operators import odds, quarantine
from tidemark.operators.intervals import HOUR_US, as_of_cutoffs
from tidemark.operators.ordered import carry_forward, earlier_totals, with_earlier_totals
from tidemark.operators.quantiles import at_ranks, exact_quantiles
from tidemark.operators.temporal import history_from_log
from tidemark.plans import catalog


def test_cutoff_table_equals_the_range_join(spark):
    rng = random.Random(3)
    edge = [0, HOUR_US, HOUR_US - 1, -1, -HOUR_US, 1 << 62, -(1 << 62)]
    rows = [(i, rng.choice(edge) if i % 9 == 0 else rng.randrange(-50 * HOUR_US, 50 * HOUR_US)) for i in range(200)]
    rows = [(i, a, None if i % 5 == 0 else a + rng.choice([0, 1, -3, HOUR_US, 7 * HOUR_US, rng.randrange(90 * HOUR_US)])) for i, a in rows]
    cuts = [(j, rng.choice(edge) if j % 7 == 0 else rng.randrange(-60 * HOUR_US, 90 * HOUR_US)) for j in range(150)] + [(999, None), (150, cutoff := 5 * HOUR_US), (151, cutoff)]
    df, at = spark.createDataFrame(rows, "id int, known_at bigint, superseded_at bigint"), spark.createDataFrame(cuts, "j int, cutoff bigint")
    joined = as_of_cutoffs(df, at, columns=["id"])
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in joined._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, j) for i, a, b in rows for j, c in cuts if c is not None and a <= c and (b is None or b > c))
    assert sorted((r.id, r.j) for r in joined.collect()) == want and len(want) > 3000


def test_ranks_and_quantiles(spark):
    rng = random.Random(4)
    groups = {"a": [rng.randrange(10**12) for _ in range(301)], "b": [5] * 50 + [7], None: [-3, -(1 << 40), 1 << 40], "c": [], "d": [9]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "top": 1.0}).collect()}
    low = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"p50": 0.5}, lower=True).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for g in got:
        assert [got[g].p50, got[g].p95, got[g].top] == pytest.approx(np.quantile(groups[g], [0.5, 0.95, 1.0]).tolist(), rel=1e-12)
        assert low[g].p50 == sorted(groups[g])[(len(groups[g]) - 1) // 2]
    wide = spark.createDataFrame([("x", v) for v in (-(1 << 63), -1, 0, (1 << 63) - 1)], "g string, v bigint")
    ranks = spark.createDataFrame([("x", i) for i in range(6)] + [("y", 0)], "g string, rank bigint")
    assert sorted((r.rank, r.v) for r in at_ranks(wide, ["g"], "v", ranks).collect()) == [(0, -(1 << 63)), (1, -1), (2, 0), (3, (1 << 63) - 1)]
    assert at_ranks(wide.limit(0), ["g"], "v", ranks).collect() == []


def test_quarantine_takes_along_what_refers_to_it(spark):
    fixtures = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 7), (7, 6), (None, 1)], "id int, replay_of int")
    results = spark.createDataFrame([(1, 9), (4, 8), (5, 7), (7, 6)], "id int, goals int")
    prices = spark.createDataFrame([(10, 4, 1), (11, 5, 1), (12, 5, 2), (13, None, 3)], "price int, id int, book int")
    tables, keys = {"fixtures": fixtures, "results": results, "prices": prices}, {"fixtures": ["id"], "results": ["id"], "prices": ["price"]}
    refused = {
        "fixtures": spark.createDataFrame([(2, "b rule"), (2, "a rule"), (6, "circle"), (99, "not in the batch")], "id int, rule string"),
        "prices": spark.createDataFrame([(12, "too low")], "price int, rule string"),
    }
    references = [quarantine.Reference("fixtures", "replay_of", "fixtures"), quarantine.Reference("results", "id", "fixtures"), quarantine.Reference("prices", "id", "fixtures")]
    held = quarantine.closure(tables, keys, refused, references)
    accepted, back = quarantine.split(tables, keys, held)
    assert sorted((r.id, r.hops, r.reason) for r in back["fixtures"].collect()) == [(2, 0, "a rule"), (3, 1, "fixtures refused"), (4, 2, "fixtures refused"), (6, 0, "circle"), (7, 1, "fixtures refused")]
    assert sorted((r.id, r.hops) for r in back["results"].collect()) == [(4, 3), (7, 2)]
    assert sorted((r.price, r.hops) for r in back["prices"].collect()) == [(10, 3), (12, 0)]
    for name, df in tables.items():
        whole = accepted[name].unionByName(back[name].select(*df.columns))
        assert sorted(map(repr, whole.collect())) == sorted(map(repr, df.collect()))
    assert quarantine.closure(tables, keys, {}, references) == {}


def test_ordered_reads_keep_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 10, 1), ("a", None, 10, 2), ("a", None, 20, 3), (None, None, 20, 4), (None, None, 30, 5)], "k string, l int, at bigint, v bigint")
    totals = earlier_totals(df, ["k", "l"], "at", {"s": F.col("v")})
    assert sorted(map(repr, [(r.k, r.l, r.at, r.s) for r in totals.collect()])) == sorted(map(repr, [("a", 1, 10, 0), ("a", None, 10, 0), ("a", None, 20, 2), (None, None, 20, 0), (None, None, 30, 4)]))
    assert with_earlier_totals(df, ["k", "l"], "at", {"s": F.col("v")}).count() == 5
    carried = carry_forward(df.withColumn("w", F.when(F.col("v") % 2 == 0, F.col("v"))), ["k", "l"], ["at"], "w", "held")
    assert sorted((r.v, r.held) for r in carried.collect() if r.held) == [(2, 2), (3, 2), (4, 4), (5, 4)]


def test_ticks_of_one_instant_are_in_order(spark):
    rows = [("s", 5, "b", "observed", 1, 100, True), ("s", 5, "a", "observed", 2, 200, True), ("s", 5, "b", "observed", 0, 300, True), ("s", 1, "z", "observed", 9, 50, True), (None, 5, "a", "observed", 7, 70, True)]
    ticks = spark.createDataFrame(rows, "series_id string, observed_at bigint, source string, price_kind string, event_id int, price_c int, is_available boolean").repartition(3)
    path = {r.event_id: (r.series_id, r.position) for r in odds.price_path(ticks).collect()}
    assert path == {9: ("s", 1), 2: ("s", 2), 0: ("s", 3), 1: ("s", 4), 7: (None, 1)}
    asked = spark.createDataFrame([("s", 5), ("s", 4), (None, 6)], "series_id string, at bigint")
    assert sorted((r.at, r.price_c) for r in odds.step_price(ticks, asked).collect()) == [(4, 50), (5, 100), (6, 70)]


def test_rho_by_grouped_sums(spark):
    """Equal to the solver of a task on ordinary scopes; 0 without low scores; at the edge where all pull one way."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for scope in (*"abcd", None):
        lam = rng.uniform(0.4, 2.6, (8, 2))
        counts = rng.uniform(0, 9, (8, 4)) * (scope != "b")
        if scope == "c":
            counts[:, [1, 2]] = 0
        rows += [(scope, *map(float, x), *map(float, y)) for x, y in zip(lam, counts)]
        weighted = np.concatenate([np.zeros((1, 8, 3)), counts.reshape(1, 8, 4)], axis=-1)
        want[scope] = float(_estimate_rho(np.ones((1, 8, 7)), weighted, lam[None, :, 0], lam[None, :, 1])[0])
    df = spark.createDataFrame(rows, "scope string, lambda_home double, lambda_away double, w00 double, w01 double, w10 double, w11 double")
    got = {r.scope: r.rho for r in estimate_rho_distributed(df, ["scope"]).collect()}
    assert set(got) == set(want) and got["b"] == 0.0
    assert all(math.isclose(got[s], want[s], abs_tol=1e-8) for s in want), (got, want)


def test_settled_series_never_pass_through_the_driver(spark, sf):
    plan = catalog.QUERIES["settle"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [fixture_id" in plan and "BroadcastHashJoin [fixture_id" not in plan


def test_settled_series_are_shuffled_once(spark, sf):
    plan = catalog.QUERIES["settle"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Exchange hashpartitioning(fixture_id") == 2


def test_history_by_one_sort_equals_history_by_time_buckets(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (1, 9, "b"), (1, 10**15, "a"), (1, None, "b"), (1, 12, None), (1, 13, None), (2, 3, None), (2, 4, "x"), (None, 1, "x"), (None, 2, "x"), (None, 2, "y")]
    log = spark.createDataFrame([(k, 7, t, x) for k, t, x in rows], "k long, s long, known_at long, outcome string")
    want, got = (sorted(map(tuple, history_from_log(log, ["k", "s"], ["outcome"], grain_us=g).collect()), key=repr) for g in (10, None))
    assert got == want and len(got) == 7
