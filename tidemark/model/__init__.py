"""Rating model: fit, predict, walk-forward, metrics. Never imports anything about prices."""
