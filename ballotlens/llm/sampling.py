"""Samples that are the same on every run and keep what they have when records are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlens.operators.draws import first_of_each
from ballotlens.scratch import written

#: 2^31 / golden ratio, rounded to an odd number: multiples of it spread evenly modulo 2^31.
GOLDEN, MODULUS = 1327217885, 2**31


def golden_point(sequence: Column, shift: int) -> Column:
    """The fractional part of sequence / golden ratio + shift, times 2^31, in whole numbers."""
    return F.pmod(F.pmod(sequence.cast("bigint"), F.lit(MODULUS)) * F.lit(GOLDEN) + F.lit(shift % MODULUS), F.lit(MODULUS))


def golden_sample(records: DataFrame, sequence: str, rate: float, shift: int) -> DataFrame:
    """Records whose golden-ratio point lies in the fixed interval [0, rate).

    A record's point depends on its own persistent sequence number only, so the sample is the same in
    every run and partitioning and only grows; any run of n consecutive sequence numbers has rate * n records of it,
    give or take about log n. Where numbers have gaps, that holds for the numbers, not for the records: with gaps at random
    the records' share is still near the rate, but gaps of a fixed stride may make it coarser. Null numbers are never selected; equal numbers are selected together.
    """
    return records.where(golden_point(F.col(sequence), shift) < F.lit(int(rate * MODULUS)))


def prn_number(prn: Column) -> Column:
    """A hexadecimal number below 2^63 as bigint, however spelled (case, leading zeros, 0x, outer blanks); else null."""
    text = F.regexp_replace(F.lower(F.btrim(prn, F.lit(" \t"))), "^0x", "")
    digits = F.regexp_replace(text, "^0+(?=.)", "")
    fits = digits.rlike("^[0-9a-f]{1,16}$") & ((F.length(digits) < 16) | (F.substring(digits, 1, 1) < "8"))
    return F.when(fits, F.conv(digits, 16, 10).cast("bigint"))


def audit_samples(cards: DataFrame, rounds: DataFrame, group: str = "county_id") -> DataFrame:
    """county_id, round_idx and card_key of each round's sample.

    A round with stored sample_prns takes the county's cards with those numbers. Every other round takes
    all of the round before, then cards with a number and with added_at not after drawn_at, by smallest
    number (ties: card_key) until it has ``wanted`` or none is left. Copies of a card count once, with its
    smallest number and earliest added_at; cards without a number are never drawn; of a round that is sent
    twice one whole copy counts (one with a stored sample, then the last drawn_at, then the larger wanted). A null added_at is never in time; a null wanted draws nothing new.

    Each round ranks in each task at most as many cards of a county as it or one of its class may want before they meet (see
    ``draws.first_of_each``), so that a county with a third of all cards is no bottleneck.
    """
    number = prn_number(F.col("prn"))
    cards = cards.select(group, "card_key", number.alias("number"), "added_at").where("number is not null").groupBy(group, "card_key").agg(F.min("number").alias("number"), F.min("added_at").alias("added_at"))
    cards = written(cards, "cards")
    copy = F.struct(F.col("sample_prns").isNotNull().alias("stored"), "drawn_at", "wanted", "sample_prns")
    plan = written(rounds.groupBy(group, "round_idx").agg(F.max(copy).alias("r")).select(group, "round_idx", "r.drawn_at", "r.wanted", "r.sample_prns"), "rounds")
    levels = [r.round_idx for r in plan.select("round_idx").distinct().orderBy("round_idx").collect()]  # a handful of rounds
    out = held = None
    for level in levels:
        now = plan.where(F.col("round_idx") == level)
        stored = now.where("sample_prns is not null").select(group, F.explode("sample_prns").alias("p")).select(group, prn_number(F.col("p")).alias("number")).where("number is not null").distinct()
        taken = cards.join(stored, [group, "number"], "left_semi").select(group, "card_key")
        if held is not None:
            open_round = now.where("sample_prns is null").select(group, "drawn_at", "wanted")
            before = held.join(open_round.select(group), group, "left_semi")
            have = before.groupBy(group).agg(F.count("*").alias("have"))
            need = open_round.join(have, group, "left").select(group, "drawn_at", (F.coalesce("wanted", F.lit(0)) - F.coalesce("have", F.lit(0))).alias("need")).where("need > 0")
            need = written(need, "need")
            free = cards.join(before, [group, "card_key"], "left_anti").join(need, group).where("added_at <= drawn_at").select(group, "card_key", "number")
            # literal bounds let each task drop all but its own smallest cards before the shuffle
            new = first_of_each(free, need.select(group, F.col("need").cast("bigint").alias("n")), group, ["number", "card_key"]).select(group, "card_key")
            taken = taken.unionAll(before).unionAll(new)
        else:
            open_round = now.where("sample_prns is null").select(group, "drawn_at", F.coalesce("wanted", F.lit(0)).alias("need"))
            free = cards.join(open_round, group).where("added_at <= drawn_at").select(group, "card_key", "number")
            taken = taken.unionAll(first_of_each(free, open_round.select(group, F.col("need").cast("bigint").alias("n")), group, ["number", "card_key"]).select(group, "card_key"))
        taken = written(taken.distinct(), "sample")
        part = taken.select(group, F.lit(level).alias("round_idx"), "card_key")
        # a county that skips a round keeps its last sample for the next
        held = taken if held is None else taken.unionAll(held.join(now.select(group), group, "left_anti"))
        out = part if out is None else out.unionAll(part)
    if out is None:
        return cards.limit(0).select(group, F.lit(0).alias("round_idx"), "card_key")
    return out
