"""Simulated ballots with exact totals, and fuzzed ones; the same on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballotlens.operators import prefix


def simulate_pool(places: DataFrame, counts: DataFrame, seed: int, keys: tuple[str, ...] = ("pool_id", "contest_id"), rows: int = 0) -> DataFrame:
    """Votes for the cards of each pool and contest such that the totals are exact: places with cand (null: no vote).

    places: keys and card_key. counts: keys, cand and nvotes, at most one vote a card. Votes are laid out as ranges,
    cards are shuffled by a hash of card and seed and numbered; a card takes the vote whose range holds its number, then,
    if there are more votes than cards, the one a round of all cards further on, and so on: a row for each vote, no
    candidate twice on a card. Cards beyond the last vote have none. rows: about how many places there are, so that a pool with a
    large share of them is numbered in ranges of the hash, not in one task.
    """
    w = Window.partitionBy(*keys)
    upto = F.sum("nvotes").over(w.orderBy("cand"))
    ranges = counts.withColumn("upto", upto).withColumn("above", F.col("upto") - F.col("nvotes"))
    votes = counts.groupBy(*keys).agg(F.sum("nvotes").alias("votes"))
    placed = places.withColumn("luck", F.shiftrightunsigned(F.xxhash64("card_key", F.lit(seed)), 1))
    placed = prefix.place(placed, list(keys), ["luck", "card_key"], prefix.number_bucket("luck", rows), "no").join(places.groupBy(*keys).agg(F.count("*").alias("ncards")), list(keys))
    rounds = F.greatest(F.lit(1), F.ceil(F.coalesce("votes", F.lit(0)) / F.col("ncards"))).cast("int")
    placed = placed.join(votes, list(keys), "left").withColumn("round", F.explode(F.sequence(F.lit(0), rounds - 1))).withColumn("no", F.col("no") + F.col("round") * F.col("ncards"))
    on = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("p.no") > F.col("r.above"), F.col("p.no") <= F.col("r.upto")]
    made = placed.alias("p").join(ranges.alias("r"), on, "left").where("p.round = 0 or r.cand is not null")
    return made.select(*[f"p.{k}" for k in keys], "p.card_key", "r.cand")


def fuzz(votes: DataFrame, candidates: DataFrame, percent: float, seed: int) -> DataFrame:
    """votes (card_key, contest_id, cands and ranked) of which the given share of cards is changed: fuzzed (array) beside cands.

    A chosen ballot of a contest gets one candidate of the contest other than its first mark, or none. A ranked one has two
    neighbours swapped, or all ranks cleared, or a candidate added at the end; where there is nothing to swap, one is added.
    """
    lists = candidates.groupBy("contest_id").agg(F.sort_array(F.collect_set("cand")).alias("known"))  # a contest has few candidates
    luck = lambda salt: F.pmod(F.xxhash64("card_key", "contest_id", F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1_000_000
    none = F.array().cast("array<int>")
    others = F.filter("known", lambda c: ~F.coalesce(c == F.get("cands", F.lit(0)), F.lit(False)))
    out = votes.join(lists, "contest_id").withColumn("others", others).withColumn("free", F.array_except("known", "cands"))
    pick = F.floor(luck(2) * (F.size("others") + 1)).cast("int")
    other = F.when(pick >= F.size("others"), none).otherwise(F.array(F.get("others", pick)))
    at = F.floor(luck(4) * (F.size("cands") - 1)).cast("int")
    swapped = F.transform("cands", lambda c, i: F.when(i == at, F.get("cands", i + 1)).when(i == at + 1, F.get("cands", i - 1)).otherwise(c))
    longer = F.when(F.size("free") > 0, F.concat("cands", F.array(F.get("free", F.floor(luck(5) * F.size("free")).cast("int"))))).otherwise(F.col("cands"))
    ranked = F.when(luck(3) < 1 / 3, none).when((luck(3) < 2 / 3) & (F.size("cands") > 1), swapped).otherwise(longer)
    changed = F.when(F.coalesce("ranked", F.lit(False)) if "ranked" in votes.columns else F.lit(False), ranked).otherwise(other)
    return out.withColumn("fuzzed", F.when(luck(1) < percent, changed).otherwise(F.col("cands"))).drop("others", "free", "known")


def make_election(spec: DataFrame, seed: int) -> DataFrame:
    """contest_id, card_no, phantom and cands of made-up contests with exact totals.

    spec: contest_id, ncards, nphantoms, nundervotes and candidates (an array of cand and nvotes). Of a contest's cards, in
    an order shuffled by hash, the first hold the first candidate's votes and so on, then come undervotes, then phantoms; whatever
    is left over of ncards is undervotes. Totals beyond ncards are cut.
    """
    cards = spec.select("*", F.explode(F.sequence(F.lit(1), F.col("ncards").cast("int"))).alias("card_no")).where("ncards > 0")
    at = F.aggregate("candidates", F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("int").alias("cand")), lambda s, c: F.struct((s["upto"] + c["nvotes"]).alias("upto"), F.when(s["cand"].isNull() & (F.col("card_no") <= s["upto"] + c["nvotes"]), c["cand"]).otherwise(s["cand"]).alias("cand")))
    phantom = F.col("card_no") > F.col("ncards") - F.col("nphantoms")
    shuffled = F.xxhash64("contest_id", "card_no", F.lit(seed))
    out = cards.select("contest_id", phantom.alias("phantom"), F.when(~phantom & at["cand"].isNotNull(), F.array(at["cand"])).otherwise(F.array().cast("array<int>")).alias("cands"), shuffled.alias("card_no"))
    return out.select("contest_id", "card_no", "phantom", "cands")
