"""Hand readings that arrive as a stream (an extra: the batch queries do not need it).

With a fixed bet and the null mean 1/2 (sampling with replacement) the martingale is a product that does not
depend on the order of arrival, so a streaming aggregate keeps it exactly; late readings are never lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_risk(values: DataFrame, keys: list[str], value: str, bet: float) -> DataFrame:
    """Per key: readings, log_t and p_value so far. values may be a stream (output mode complete or update) or a batch.

    A factor of 0 or less (a bet that lost everything) makes p_value 1 for good. Null values count as nothing.
    """
    factor = 1 + F.lit(bet) * (F.col(value) - 0.5)
    out = values.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("readings"), F.sum(F.when(factor > 0, F.log(factor)).otherwise(0.0)).alias("log_t"), F.max((factor <= 0).cast("int")).alias("ruined"))
    return out.select(*keys, "readings", "log_t", F.when(F.col("ruined") == 1, 1.0).otherwise(F.least(F.lit(1.0), F.exp(-F.col("log_t")))).alias("p_value"))


def arrivals_per_hour(readings: DataFrame, at: str = "read_at", late: str = "2 hours") -> DataFrame:
    """Readings per hour of event time; those later than the watermark no longer count."""
    return readings.withWatermark(at, late).groupBy(F.window(at, "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "n")
