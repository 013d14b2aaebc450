"""Votes of a ballot: a map from contest to the marked candidates, in rank order.

An empty array is an undervote (the contest is on the ballot); a missing key means that it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_CANDIDATES = "array<int>"
#: Style ids of cards that are described by their own votes. Fixed values.
OWN_STYLES = (-1, -2)


def candidates_of(votes: Column, contest: Column | int) -> Column:
    """The marked candidates, or null if the contest is not on the ballot."""
    return F.try_element_at(votes, F.lit(contest) if isinstance(contest, int) else contest)


def has_contest(votes: Column, contest: Column | int) -> Column:
    return F.coalesce(F.map_contains_key(votes, contest), F.lit(False))


def may_have_contest(votes: Column, style_id: Column, possible: Column, contest: Column | int) -> Column:
    """Whether a card may hold the contest: its own votes tell for built-in styles, else the style's list does."""
    return F.when(style_id.isin(*OWN_STYLES), has_contest(votes, contest)).otherwise(F.coalesce(F.array_contains(possible, contest), F.lit(False)))


def marks(cands: Column, cand: Column | int) -> Column:
    """1 if the candidate is marked, else 0 (also where the contest is missing)."""
    return F.coalesce(F.array_contains(cands, cand).cast("int"), F.lit(0))


def possible_contests(votes: Column) -> Column:
    return F.sort_array(F.map_keys(votes))


def explode_votes(ballots: DataFrame, *keep: str) -> DataFrame:
    """One row for each contest on each ballot: the kept columns, contest_id and cands (never null)."""
    return ballots.select(*keep, F.explode("votes").alias("contest_id", "cands")).withColumn("cands", F.coalesce("cands", F.array().cast(NO_CANDIDATES)))


def add_contests(votes: Column, wanted: Column) -> Column:
    """The votes with an undervote for each wanted contest that is not on the ballot."""
    missing = F.array_except(wanted, F.map_keys(votes))
    return F.map_concat(F.map_from_arrays(missing, F.transform(missing, lambda _: F.array().cast(NO_CANDIDATES))), votes)
