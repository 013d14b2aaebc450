"""Pooled comparison audits: cards of which only the pool's subtotal is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POOL = ["pool_id", "contest_id", "winner", "loser"]


def pool_averages(pool_votes: DataFrame, assertions: DataFrame) -> DataFrame:
    """Per pool and assertion: ncards, w and l (votes of winner and loser), and pool_avg, the mean of the assorter.

    pool_votes: pool_id, contest_id and cands of the pooled cards. Cards are counted per pool, contest and
    candidate before they meet the assertions.
    """
    cards = pool_votes.groupBy("pool_id", "contest_id").agg(F.count("*").alias("ncards"))
    tab = pool_votes.select("pool_id", "contest_id", F.explode("cands").alias("cand")).groupBy("pool_id", "contest_id", "cand").agg(F.count("*").alias("v"))
    grid = cards.join(assertions.select("contest_id", "winner", "loser"), "contest_id")
    side = lambda name, short: tab.select("pool_id", "contest_id", F.col("cand").alias(name), F.col("v").alias(short))
    out = grid.join(side("winner", "w"), ["pool_id", "contest_id", "winner"], "left").join(side("loser", "l"), ["pool_id", "contest_id", "loser"], "left")
    out = out.select(*POOL, "ncards", F.coalesce("w", F.lit(0)).alias("w"), F.coalesce("l", F.lit(0)).alias("l"))
    return out.withColumn("pool_avg", ((F.col("w") - F.col("l")) / F.col("ncards") + 1) / 2)


def pool_values(averages: DataFrame, assertions: DataFrame) -> DataFrame:
    """Comparison values of pooled cards and their rates over npop: kind (loser, other, winner), value, rate.

    With the pool's average p: loser 1 - p, other 3/2 - p, winner 2 - p, times noerror; the rates are the
    pool's votes for winner and loser and the rest of its cards.
    """
    a = averages.join(assertions.select("contest_id", "winner", "loser", "noerror", "npop"), ["contest_id", "winner", "loser"])
    part = lambda name, shift, n: F.struct(F.lit(name).alias("kind"), ((shift - F.col("pool_avg")) * F.col("noerror")).alias("value"), (n / F.col("npop")).alias("rate"))
    rows = F.array(part("loser", 1.0, F.col("l")), part("other", 1.5, F.col("ncards") - F.col("w") - F.col("l")), part("winner", 2.0, F.col("w")))
    return a.select(*POOL, F.inline(rows))


def pooled_comparison(compared: DataFrame, averages: DataFrame, mvr_value) -> DataFrame:
    """compared with value replaced for pooled cards: (1 - (pool_avg - mvr)) * noerror; 0 where the pool has no average."""
    avg = averages.select(*POOL, "pool_avg")
    out = compared.join(avg, POOL, "left")
    pooled = F.when(F.col("pool_avg").isNull(), 0.0).otherwise((1 - (F.col("pool_avg") - mvr_value)) * F.col("noerror"))
    return out.withColumn("value", F.when(F.col("pool_id").isNull(), F.col("value")).otherwise(pooled))
