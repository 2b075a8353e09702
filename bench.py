"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.model import backtest
from tidemark.model.fit import fit_many
from tidemark.model.profiles import CANDIDATES, MIN_TRAINING_MATCHES, PROFILES
from tidemark.plans import catalog, views
from tidemark.session import local_session

HEADLINES = (
    "class_frequency", "history_from_log", "latest_tick_as_of", "last_observed_pre_kickoff", "revise", "derive_markets",
    "predict_fixture", "consensus", "resolve", "unpivot_closing_odds", "standings", "form_snapshot", "generate_predictions",
)


def timed(df) -> float:
    started = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus=cpus, memory=os.environ.get("BENCH_MEMORY", "12g"))
    m = views.matches(spark, sf_dir)
    # One pass over the headline tables so that no query pays for start-up.
    timed(fit_many(views.matches(spark, sf_dir).filter("season = 1995"), [PROFILES["control"]], backtest.month_cutoffs(m)))
    timed(views.ticks(spark, sf_dir))
    queries: dict[str, float] = {}
    for name in HEADLINES:
        started = time.perf_counter()
        df = catalog.QUERIES[name](spark, sf_dir)
        timed(df)
        queries[name] = round(time.perf_counter() - started, 3)
    # Every distinct kickoff of the corpus is a cutoff: one control fit each.
    fits = backtest.distinct_cutoffs(m).count()
    queries["fit_many_control"] = round(timed(fit_many(m, [PROFILES["control"]], min_training=MIN_TRAINING_MATCHES)), 3)
    queries["walk_forward_control"] = round(timed(backtest.walk_forward(m, [PROFILES["control"]])), 3)
    # Seven candidates, monthly cutoffs: the grid a selection run evaluates.
    queries["candidate_grid_month"] = round(timed(backtest.backtest_report(backtest.walk_forward(m, CANDIDATES, grain="month"))), 3)
    print(json.dumps({
        "metric": "headline_seconds", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries,
        "fits": fits, "fits_per_second": round(fits / queries["fit_many_control"], 1), "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
