"""Drawing cards: sorted manifests, phantoms, consistent and uniform samples, strata."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballotlens.scratch import written


#: Groups of a class are broadcast only if they are no more.
BROADCAST_ROWS = 200_000


def first_of_each(rows: DataFrame, wanted: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with rank and n, of each group those that come first in order, as many as wanted: group and n.

    A literal bound on the rank lets each task drop all but its own first rows before the shuffle. Groups that want very
    different numbers are taken in classes (each up to sixteen times its least), so that one that wants a great many does not
    make every task keep as many of all others.
    """
    size = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / math.log(16))
    wanted = wanted.select(group, "n").where("n > 0").withColumn("__class", size)
    classes = wanted.groupBy("__class").agg(F.max("n").alias("most"), F.count("*").alias("groups")).orderBy("__class").collect()  # at most sixteen
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    out = None
    for c in classes:
        mine = wanted.where(F.col("__class") == c["__class"]).select(group, "n")
        known = F.broadcast(mine.select(group)) if c["groups"] <= BROADCAST_ROWS else mine.select(group)
        part = rows if len(classes) == 1 else rows.join(known, group, "left_semi")
        part = part.withColumn("rank", rank).where(F.col("rank") <= F.lit(c["most"])).join(mine, group).where("rank <= n")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.limit(0).withColumn("rank", F.lit(0)).withColumn("n", F.lit(0).cast("bigint"))


def make_phantoms(need: DataFrame, shared: bool = True) -> DataFrame:
    """Phantom cards for contests that lack cards: phantom_no and contests (sorted).

    need: contest_id and n. Shared: phantom k carries every contest that needs more than k; else each carries one.
    """
    rows = need.where("n > 0").select("contest_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    if shared:
        return rows.groupBy(F.col("k").alias("phantom_no")).agg(F.sort_array(F.collect_set("contest_id")).alias("contests"))
    no = F.row_number().over(Window.orderBy("contest_id", "k"))  # as many rows as phantoms, which are few
    return rows.select(no.alias("phantom_no"), F.array("contest_id").alias("contests"))


def consistent_sample(card_contests: DataFrame, wanted: DataFrame, cap: int | None = None) -> DataFrame:
    """The prns drawn when cards are taken by prn until every contest has its wanted number.

    card_contests: prn and contest_id, one row for each contest a card may hold. wanted: contest_id and n. An
    included contest never skips a card before it is satisfied, so a card is drawn if it is among the first n of
    some contest. cap: at most so many cards, by prn.
    """
    drawn = first_of_each(card_contests.select("prn", "contest_id"), wanted, "contest_id", ["prn"]).select("prn").distinct()
    return drawn.orderBy("prn").limit(cap) if cap is not None else drawn


def card_classes(cards: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """prn and class, each prn once; and class and contest_id, the contests that cards of a class may hold.

    cards: prn and style_id. held: style_id and contest_id. Cards are of one class if their styles are the same; a prn of several
    cards has the contests of all their styles. Both sides together stand for each prn beside each of its contests, which
    is the product of cards and contests where styles hold many.
    """
    classes = cards.groupBy("prn").agg(F.sort_array(F.collect_set("style_id")).alias("class"))
    contests = classes.select("class").distinct().select("class", F.explode("class").alias("style_id")).join(held, "style_id")
    return classes, contests.select("class", "contest_id").distinct()


def first_in_classes(classes: DataFrame, class_contests: DataFrame, wanted: DataFrame) -> DataFrame:
    """prn, contest_id, rank and n of each contest's first n prns, as ``first_of_each`` gives them over all prns and contests.

    They are among the first of each class that has the contest, as many as any contest of the class wants; only
    these meet the contests. See ``card_classes``.
    """
    bound = class_contests.join(wanted, "contest_id").groupBy("class").agg(F.max("n").alias("n"))
    near = first_of_each(classes, bound, "class", ["prn"]).select("prn", "class", F.col("rank").alias("place"))
    rows = near.join(class_contests.join(wanted, "contest_id"), "class").where("place <= n").select("prn", "contest_id")
    return first_of_each(rows, wanted, "contest_id", ["prn"])


#: Cards of a class in a range of numbers, on average, among which the last that a contest wants is looked for.
PER_RANGE = 128


def consistent_sample_in_classes(classes: DataFrame, class_contests: DataFrame, wanted: DataFrame, sizes: DataFrame, bits: int = 63) -> DataFrame:
    """The prns of ``consistent_sample``, however many are wanted, without a row for each prn and contest.

    A card is drawn if its prn is at most the last that some contest of its class wants. Counts of classes in ranges of the number
    tell in which range that one is; only that range's cards meet the contest. sizes: contest_id and cards (how many prns
    it has). Numbers are spread below 2^bits; if they are not, ranges are uneven, but the sample is the same. See ``card_classes``.
    """
    most = classes.groupBy("class").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
    need = max(0, (max(1, -(-most // PER_RANGE)) - 1).bit_length())
    ranged = classes.withColumn("range", F.shiftright("prn", min(bits, 63) - need) if need else F.lit(0))
    per = class_contests.join(wanted.where("n > 0").join(sizes, "contest_id"), "contest_id")  # a row for each contest of a class
    some = per.where("n < cards")
    counts = some.join(ranged.groupBy("class", "range").agg(F.count("*").alias("k")), "class").groupBy("contest_id", "n", "range").agg(F.sum("k").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("contest_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = counts.withColumn("before", before).where("before < n and n <= before + k").select("contest_id", "range", (F.col("n") - F.col("before")).alias("rest"))
    near = some.select("class", "contest_id").join(at, "contest_id").join(ranged, ["class", "range"])
    last = near.withColumn("place", F.row_number().over(Window.partitionBy("contest_id").orderBy("prn"))).where("place = rest").select("contest_id", F.col("prn").alias("last"))
    upto = per.join(last, "contest_id", "left").groupBy("class").agg(F.bool_or(F.col("n") >= F.col("cards")).alias("whole"), F.max("last").alias("last"))
    return classes.join(upto, "class").where("whole or prn <= last").select("prn")


def consistent_sample_prefix(card_contests: DataFrame, wanted: DataFrame, sizes: DataFrame, bits: int = 63, slack: float = 1.5) -> DataFrame:
    """The same sample, from a prefix of a manifest that is stored in the order of its numbers.

    sizes: contest_id and cards (how many rows of card_contests each has). Numbers are spread evenly below 2^bits, so the share of
    a contest's cards that is wanted tells how far to read; the bound on prn reaches the scan, which skips all files and row
    groups beyond it. Whether every contest has what it wants there is checked, and the prefix doubled if one has not.
    """
    plan = wanted.join(sizes, "contest_id").select("contest_id", F.least("n", "cards").alias("n"), "cards")
    share = slack * (plan.agg(F.max(F.col("n") / F.col("cards"))).first()[0] or 0.0)
    while True:
        prefix = card_contests if share >= 1 else card_contests.where(F.col("prn") <= F.lit(int(share * 2**bits)))
        if share >= 1:
            break
        have = prefix.groupBy("contest_id").agg(F.count("*").alias("have"))
        if not plan.join(have, "contest_id", "left").where("n > coalesce(have, 0)").limit(1).count():
            break
        share *= 2
    return consistent_sample(prefix, plan.select("contest_id", "n"))


def sample_reach(card_contests: DataFrame, sample: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per contest: have (its cards before the first that was not drawn) and upto (their last place in the sample).

    Only cards up to the last drawn prn matter, so the windows see a prefix of the manifest.
    """
    place = written(sample.select("prn", F.row_number().over(Window.orderBy("prn")).alias("place")), "sample")  # a sample is small
    last = place.agg(F.max("prn")).first()[0]
    seen = card_contests.join(wanted.select("contest_id"), "contest_id", "left_semi").where(F.col("prn") <= F.lit(last)).join(place, "prn", "left")
    skips = F.sum(F.col("place").isNull().cast("int")).over(Window.partitionBy("contest_id").orderBy("prn"))
    return seen.withColumn("skips", skips).where("skips = 0").groupBy("contest_id").agg(F.count("*").alias("have"), F.max("place").alias("upto"))


def uniform_sample(cards: DataFrame, wanted: DataFrame, group: str = "county_id") -> DataFrame:
    """The first n cards of each group by prn. wanted: the group and n."""
    return first_of_each(cards, wanted, group, ["prn"]).drop("n")


def drop_largest(wanted: DataFrame, n: int) -> DataFrame:
    """The wanted sizes without the n largest (ties: the smaller contest id goes first)."""
    return wanted.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "contest_id"))).where(F.col("r") > n).drop("r")  # one row a contest


def limited_sizes(wanted: DataFrame, totals: DataFrame, max_pct: float, contest_cutoff: int) -> DataFrame:
    """Contests still included: at most max_pct of their cards and at most contest_cutoff samples."""
    out = wanted.join(totals.select("contest_id", "nc"), "contest_id")
    return out.where((F.col("n") <= max_pct * F.col("nc")) & (F.col("n") <= contest_cutoff)).select("contest_id", "n")


def sample_with_limits(card_contests: DataFrame, wanted: DataFrame, totals: DataFrame, max_pct: float, contest_cutoff: int, audit_cutoff: int) -> DataFrame:
    """The contests and sizes that remain when contests are dropped until the sample is within all limits.

    Contests over their own limits go first; then, while the sample has more than audit_cutoff cards, the largest.
    """
    sizes = limited_sizes(wanted, totals, max_pct, contest_cutoff).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "contest_id")))  # one row a contest
    sizes = written(sizes, "sizes")
    drawn = first_of_each(card_contests.select("prn", "contest_id"), sizes, "contest_id", ["prn"]).join(sizes.select("contest_id", "r"), "contest_id")
    # a card stays in the sample until the last contest that wants it has been dropped, so one pass gives the
    # sample's size after each drop: the cards whose last contest comes later
    last = drawn.groupBy("prn").agg(F.max("r").alias("r")).groupBy("r").agg(F.count("*").alias("cards"))
    later = F.sum("cards").over(Window.orderBy(F.desc("r")))
    steps = last.withColumn("upto", later)
    first_kept = steps.where(F.col("upto") <= audit_cutoff).agg(F.min("r").alias("keep")).first()["keep"]
    if first_kept is None:
        return sizes.limit(0).select("contest_id", "n")
    # contests between the last too large step and the first kept one add no card of their own
    over = steps.where(F.col("upto") > audit_cutoff).agg(F.max("r").alias("r")).first()["r"] or 0
    return sizes.where(F.col("r") > over).select("contest_id", "n")


def strata_rates(strata: DataFrame, contest_strata: DataFrame) -> DataFrame:
    """Per contest: the least sampling rate of its strata and the sample it gives, sum(round half even(rate * population)).

    strata: county_id, nmvrs, population. contest_strata: contest_id, county_id. A county without a stratum has rate 1.
    """
    per = contest_strata.join(strata, "county_id", "left").withColumn("rate", F.coalesce(F.col("nmvrs") / F.col("population"), F.lit(1.0)))
    least = per.groupBy("contest_id").agg(F.min("rate").alias("min_rate"))
    return per.join(least, "contest_id").groupBy("contest_id").agg(F.first("min_rate").alias("min_rate"), F.sum(F.coalesce(F.bround(F.col("min_rate") * F.col("population"), 0), F.lit(0.0))).cast("bigint").alias("n"))
