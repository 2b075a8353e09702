"""Imports every module that registers queries."""

from tidemark.plans import (  # noqa: F401
    q_evaluation,
    q_forecast,
    q_analytics,
    q_identity,
    q_jobs,
    q_ingest,
    q_odds,
    q_streaming,
    q_temporal,
)
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
