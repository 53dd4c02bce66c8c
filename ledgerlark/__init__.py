"""Transaction-risk analytics on Spark: history features, splits, scoring, ranking metrics, audits."""

__version__ = "0.1.0"
