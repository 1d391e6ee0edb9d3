"""Payment-risk analytics on Spark: point-in-time features, scoring, cost
policy, decision tables, backtests, drift, monitoring and stream scoring."""

__version__ = "0.1.0"
