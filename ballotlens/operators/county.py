"""Proportional allocation with exact totals, and county pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distribute(weights: DataFrame, need: DataFrame, keys: list[str], part: str) -> DataFrame:
    """keys, part and share: ``need`` whole cards of each key split over its parts by weight, exactly.

    weights: keys, part and weight. need: keys and need. Shares are rounded down and the rest goes to the largest
    remainders (ties: the smaller part). Keys without any weight get nothing.
    """
    w = Window.partitionBy(*keys)
    out = weights.where("weight > 0").join(need, keys).withColumn("all", F.sum("weight").over(w))
    out = out.withColumn("low", F.expr("(need * weight) div all")).withColumn("rest", F.expr("(need * weight) % all"))
    left = F.col("need") - F.sum("low").over(w)
    place = F.row_number().over(w.orderBy(F.desc("rest"), part))
    return out.withColumn("left", left).withColumn("place", place).select(*keys, part, (F.col("low") + (F.col("place") <= F.col("left")).cast("int")).cast("bigint").alias("share"))


def county_pools(votes: DataFrame, contests: DataFrame) -> DataFrame:
    """Per county and style: ncards, the largest number of cards that any of its contests needs (votes / vote_for, rounded up, or its cards)."""
    per = votes.join(contests.select("contest_id", "vote_for"), "contest_id").groupBy("county_id", "style_id", "contest_id").agg(F.count("*").alias("n"), F.sum(F.size("cands")).alias("v"), F.max("vote_for").alias("f"))
    return per.groupBy("county_id", "style_id").agg(F.max(F.greatest(F.col("n"), F.ceil(F.col("v") / F.col("f")))).cast("bigint").alias("ncards"))
