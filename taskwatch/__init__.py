"""taskwatch: maintenance-task anomaly analytics as Spark DataFrame jobs.

Layout:
    sources/    schemas, readers, writers, saved model state
    functions/  column expressions (time, encodings, context features)
    operators/  rolling windows, group means, scaling, split, prefix sums,
                metrics, ensemble, isolation forest, reconstruction, cooldown
    plans/      fit/transform pipelines and the train / evaluate / score jobs
    streaming/  Structured Streaming scoring and alerting
"""

from taskwatch.config import Params

__all__ = ["Params"]
