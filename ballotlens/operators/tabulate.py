"""Tabulation: votes, undervotes and populations per contest.

Ballots are exploded to (ballot, contest) rows and aggregated by partial and final hash aggregates; a
contest with any share of the ballots is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contest_totals(votes: DataFrame, contests: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per contest (and by): ncards, novote, undervotes, overvotes and nphantoms.

    votes: contest_id, cands, phantom. contests: contest_id, vote_for. Contests that are not listed are
    ignored. A phantom counts as a card only. undervotes sums vote_for - marks and may be negative.
    """
    joined = votes.join(contests.select("contest_id", "vote_for"), "contest_id")
    real = ~F.coalesce("phantom", F.lit(False))
    size = F.size("cands")
    return joined.groupBy(*by, "contest_id").agg(
        F.count("*").alias("ncards"), F.count_if(real & (size == 0)).alias("novote"),
        F.sum(F.when(real, F.col("vote_for") - size).otherwise(0)).cast("bigint").alias("undervotes"),
        F.count_if(real & (size > F.col("vote_for"))).alias("overvotes"), F.count_if(~real).alias("nphantoms"),
    )


def candidate_votes(votes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per contest and candidate (and by): nvotes. Phantoms must have been left out."""
    return votes.select(*by, "contest_id", F.explode("cands").alias("cand")).groupBy(*by, "contest_id", "cand").agg(F.count("*").alias("nvotes"))


def ranked_ballots(votes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The multiset of ranked ballots: contest_id, prefs and how many ballots hold them."""
    return votes.groupBy(*by, "contest_id", F.col("cands").alias("prefs")).agg(F.count("*").alias("nballots"))


def split_totals(votes: DataFrame) -> DataFrame:
    """Cards of each contest: all, pooled and not pooled, in one pass."""
    return votes.groupBy("contest_id").agg(F.count("*").alias("all_cards"), F.count("pool_id").alias("pooled"), F.count_if(F.col("pool_id").isNull()).alias("unpooled"))


def population(cards: DataFrame, style_contests: DataFrame) -> DataFrame:
    """Npop of each contest: the cards whose style may hold it. Cards are counted per style before they meet the styles."""
    per_style = cards.groupBy("style_id").agg(F.count("*").alias("n"))
    return style_contests.join(per_style, "style_id").groupBy("contest_id").agg(F.sum("n").alias("npop"))


def derive_styles(ballots: DataFrame, *by: str) -> DataFrame:
    """The distinct sets of contests on ballots, and how many ballots have each."""
    return ballots.groupBy(*by, F.sort_array(F.map_keys("votes")).alias("contests")).agg(F.count("*").alias("ncards"))


def merge_totals(parts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Partial totals of any kind summed, phantoms included."""
    return parts.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in columns])


def pool_min_cards(tabs: DataFrame, contests: DataFrame) -> DataFrame:
    """The least number of cards of each pool: the largest over contests of votes / vote_for, rounded up."""
    per = tabs.join(contests.select("contest_id", "vote_for"), "contest_id").groupBy("pool_id", "contest_id").agg(F.sum("nvotes").alias("v"), F.max("vote_for").alias("f"))
    return per.groupBy("pool_id").agg(F.max(F.ceil(F.col("v") / F.col("f"))).cast("bigint").alias("min_cards"))


def running_moments(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """count, mean, population variance and standard deviation."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("sd"))


def quantile_integer(values: Column, percent: int) -> Column:
    """The type-7 percentile of an array of whole numbers, rounded up, in whole-number arithmetic only."""
    s = F.sort_array(values)
    at = (F.size(s) - 1) * percent
    low, rest = F.floor(at / F.lit(100)), F.pmod(at, F.lit(100))
    a, b = F.try_element_at(s, (low + 1).cast("int")), F.coalesce(F.try_element_at(s, (low + 2).cast("int")), F.try_element_at(s, (low + 1).cast("int")))
    return a + F.ceil((b - a) * rest / F.lit(100))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, low and n for bins of equal whole width ceil((max - min) / bins)."""
    range_ = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / bins), F.lit(1))
    binned = df.join(F.broadcast(range_)).select(F.floor((F.col(value) - F.col("lo")) / width).cast("bigint").alias("bin"), "lo", width.alias("w"))  # one row is broadcast
    return binned.groupBy("bin").agg(F.count("*").alias("n"), (F.first("lo") + F.col("bin") * F.first("w")).cast("bigint").alias("low"))
