"""Outcomes of contests: winners, seats, elimination rounds, and the assertions that confirm them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def winners(tab: DataFrame, nwinners: DataFrame, min_fraction: float = 0.0) -> DataFrame:
    """contest_id, cand, nvotes, share, place and is_winner.

    A winner has at least min_fraction of all votes and is among the first nwinners by votes. Among equal
    votes the larger candidate id comes first (the later in insertion order). nwinners: contest_id, nwinners.
    """
    w = Window.partitionBy("contest_id")
    place = F.row_number().over(w.orderBy(F.desc("nvotes"), F.desc("cand")))
    out = tab.join(nwinners, "contest_id").withColumn("share", F.col("nvotes") / F.sum("nvotes").over(w)).withColumn("place", place)
    return out.withColumn("is_winner", (F.col("place") <= F.col("nwinners")) & (F.col("share") >= min_fraction)).drop("nwinners")


def runoff(tab: DataFrame, min_fraction: float = 0.5) -> DataFrame:
    """contest_id, cand, nvotes, share and status: winner if the first has min_fraction, else the first two advance."""
    w = Window.partitionBy("contest_id")
    out = tab.withColumn("share", F.col("nvotes") / F.sum("nvotes").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("nvotes"), F.desc("cand"))))
    top = F.max("share").over(w)
    return out.withColumn("status", F.when((top >= min_fraction) & (F.col("place") == 1), "winner").when((top < min_fraction) & (F.col("place") <= 2), "advances").otherwise("loses")).drop("place")


def dhondt_scores(tab: DataFrame, seats: int, min_fraction: float = 0.0) -> DataFrame:
    """contest_id, cand, divisor, score and has_seat, of every party with min_fraction of the valid votes.

    Seats go to the largest scores votes / divisor; equal scores to the party with the smaller divisor, then the smaller id.
    """
    share = F.col("nvotes") / F.sum("nvotes").over(Window.partitionBy("contest_id"))
    scores = tab.withColumn("share", share).where(F.col("share") >= min_fraction).select("contest_id", "cand", "nvotes", F.explode(F.sequence(F.lit(1), F.lit(seats))).alias("divisor"))
    scores = scores.withColumn("score", F.col("nvotes") / F.col("divisor"))
    rank = F.row_number().over(Window.partitionBy("contest_id").orderBy(F.desc("score"), "divisor", "cand"))
    return scores.withColumn("has_seat", rank <= seats).drop("nvotes")


def dhondt_seats(scores: DataFrame) -> DataFrame:
    """Per party: seats, last_won (the largest divisor with a seat) and first_lost (the smallest without)."""
    return scores.groupBy("contest_id", "cand").agg(F.count_if("has_seat").alias("seats"), F.max(F.when(F.col("has_seat"), F.col("divisor"))).alias("last_won"), F.min(F.when(~F.col("has_seat"), F.col("divisor"))).alias("first_lost"))


def dhondt_assertions(seats: DataFrame) -> DataFrame:
    """One row for each party with a seat and each other party that lost one: winner, loser, last and first."""
    a = seats.where("last_won is not null").select("contest_id", F.col("cand").alias("winner"), F.col("last_won").alias("last"))
    b = seats.where("first_lost is not null").select("contest_id", F.col("cand").alias("loser"), F.col("first_lost").alias("first"))
    return a.join(b, "contest_id").where("winner <> loser")


def plurality_assertions(ranked: DataFrame) -> DataFrame:
    """Winners x losers of each contest, with their votes: a contest's candidates are few, whatever its ballots."""
    w = ranked.where("is_winner").select("contest_id", F.col("cand").alias("winner"), F.col("nvotes").alias("winner_votes"))
    x = ranked.where("not is_winner").select("contest_id", F.col("cand").alias("loser"), F.col("nvotes").alias("loser_votes"))
    return w.join(x, "contest_id")


def runoff_assertions(placed: DataFrame) -> DataFrame:
    """contest_id, kind, cand and loser: the winner is above the fraction, or each who advances below it (loser null);
    and, of kind plurality, each of these beats each who loses. placed: see ``runoff``."""
    on = placed.where("status <> 'loses'")
    none = F.lit(None).cast(placed.schema["cand"].dataType).alias("loser")
    shares = on.select("contest_id", F.when(F.col("status") == "winner", "above").otherwise("below").alias("kind"), "cand", none)
    losers = placed.where("status = 'loses'").select("contest_id", F.col("cand").alias("loser"))
    return shares.unionByName(on.join(losers, "contest_id").select("contest_id", F.lit("plurality").alias("kind"), "cand", "loser"))


def dhondt_thresholds(tab: DataFrame, scores: DataFrame, min_fraction: float) -> DataFrame:
    """contest_id, kind, winner, loser, last and first: a party with min_fraction of the votes is above it; another is
    below it, or, where that is no dearer and its votes are at most the last seat's score, the party with the last seat
    keeps it from a first one (kind dhondt). scores: see ``dhondt_scores``.

    What is dearer has the smaller margin over its upper bound: t valid - v against (f - v) / (1 / last + 1), times 2 / nc.
    """
    parties = tab.withColumn("valid", F.sum("nvotes").over(Window.partitionBy("contest_id")))
    seat = F.struct((-F.col("score")).alias("s"), "divisor", "cand")
    last = scores.where("has_seat").groupBy("contest_id").agg(F.max(seat).alias("m")).select("contest_id", F.col("m.cand").alias("w"), F.col("m.divisor").alias("d"), (-F.col("m.s")).alias("f"))
    v = F.col("nvotes")
    rival = (v <= F.col("f")) & (min_fraction * F.col("valid") - v <= (F.col("f") - v) / (1 / F.col("d") + 1))
    out = parties.join(last, "contest_id", "left").withColumn("kind", F.when(v / F.col("valid") >= min_fraction, "above").when(rival, "dhondt").otherwise("below"))
    only = lambda c, a: F.when(F.col("kind") == "dhondt", c).alias(a)
    return out.select("contest_id", "kind", F.when(F.col("kind") == "dhondt", F.col("w")).otherwise(F.col("cand")).alias("winner"), only(F.col("cand"), "loser"), only(F.col("d"), "last"), only(F.lit(1), "first"))


def with_margins(assertions: DataFrame, totals: DataFrame) -> DataFrame:
    """Reported (over Nc), diluted (over Npop) and recount margins, and the comparison value without errors.

    totals: contest_id, nc, npop. A margin over no cards is 0.
    """
    gap = F.col("winner_votes") - F.col("loser_votes")
    over = lambda n: F.when(F.col(n) > 0, gap / F.col(n)).otherwise(0.0)
    out = assertions.join(totals.select("contest_id", "nc", "npop"), "contest_id")
    out = out.withColumn("reported_margin", over("nc")).withColumn("diluted_margin", over("npop")).withColumn("recount_margin", F.when(F.col("winner_votes") > 0, gap / F.col("winner_votes")).otherwise(0.0))
    return out.withColumn("noerror", 1 / (2 - F.col("diluted_margin")))


def hardest(assertions: DataFrame, measure: str = "noerror") -> DataFrame:
    """The assertion with the least measure of each contest; ties by winner, loser."""
    return assertions.withColumn("r", F.row_number().over(Window.partitionBy("contest_id").orderBy(measure, "winner", "loser"))).where("r = 1").drop("r")


# --- ranked contests -------------------------------------------------------------------------------


def irv_rounds(prefs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int]]:
    """(round, candidate, votes) of an instant-runoff count; the last round has at most two candidates.

    Candidates without any first preference are dropped at once; of equal last ones the largest id goes (one path of a tie).
    """
    viable = {c for p, _ in prefs for c in p}
    out, r = [], 0
    while viable:
        tally = dict.fromkeys(viable, 0)
        for p, n in prefs:
            top = next((c for c in p if c in viable), None)
            if top is not None:
                tally[top] += n
        if r == 0 and any(v == 0 for v in tally.values()) and any(tally.values()):
            viable = {c for c in viable if tally[c]}
            tally = {c: tally[c] for c in viable}
        out += [(r + 1, c, tally[c]) for c in sorted(viable)]
        if len(viable) <= 2:
            return out
        viable.remove(min(viable, key=lambda c: (tally[c], -c)))
        r += 1
    return out


def irv_paths(prefs: list[tuple[tuple[int, ...], int]]) -> list[tuple[str, int, int, int, bool, bool]]:
    """(path, round, candidate, votes, goes, wins) of every path of an instant-runoff count.

    A tie of last candidates forks: any of them goes. path: who has gone since round 1, in order of id; paths that
    have lost the same candidates count alike and are one. From a path each candidate that goes leads to the path with it.
    The last round of a path has at most two candidates, of whom those with most votes win.
    """
    first = irv_rounds(prefs)
    start = frozenset(c for r, c, _ in first if r == 1)
    out, layer, r = [], {start} if start else set(), 1
    while layer:
        after = set()
        for viable in sorted(layer, key=lambda v: sorted(start - v)):
            tally = dict.fromkeys(viable, 0)
            for p, n in prefs:
                top = next((c for c in p if c in viable), None)
                if top is not None:
                    tally[top] += n
            low, high = min(tally.values()), max(tally.values())
            ends = len(viable) <= 2
            goes = set() if ends else {c for c in viable if tally[c] == low}
            after |= {viable - {c} for c in goes}
            path = " ".join(map(str, sorted(start - viable)))
            out += [(path, r, c, tally[c], c in goes, ends and tally[c] == high) for c in sorted(viable)]
        layer, r = after, r + 1
    return out


def irv_count(ballots: DataFrame) -> DataFrame:
    """contest_id, path, round, cand, nvotes, goes and wins (see ``irv_paths``). ballots: contest_id, prefs, nballots, already
    consolidated, so that a contest's group has as many rows as it has different rankings, not ballots."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = irv_paths([(tuple(dict.fromkeys(int(c) for c in p)), int(n)) for p, n in zip(pdf["prefs"], pdf["nballots"])])
        out = pd.DataFrame(rows, columns=["path", "round", "cand", "nvotes", "goes", "wins"])
        out.insert(0, "contest_id", pdf["contest_id"].iloc[0])
        return out

    return ballots.groupBy("contest_id").applyInPandas(run, "contest_id int, path string, round int, cand int, nvotes bigint, goes boolean, wins boolean")


def raire(prefs: list[tuple[tuple[int, ...], int]], winner: int, n: int) -> list[tuple[str, int, int, tuple[int, ...], float]]:
    """A set of assertions that rules out every other winner, by the published branch-and-bound method:
    (kind "NEB" or "NEN", winner, loser, candidates still standing for NEN, margin), at the least difficulty of the hardest.

    Of the assertions found, as few are kept as a greedy choice needs to rule out every suffix (see ``few_assertions``). Elimination orders are grown from their end; each suffix is ruled out by its cheapest assertion, and
    the most expensive suffix is expanded while that can lower the largest difficulty. An outcome that no assertion
    can rule out (a tie) gives an empty list.
    """
    cands = sorted({c for p, _ in prefs for c in p})
    top: dict[frozenset, dict[int, int]] = {}

    def first(standing: frozenset) -> dict[int, int]:
        if standing not in top:
            tally = dict.fromkeys(standing, 0)
            for p, k in prefs:
                c = next((c for c in p if c in standing), None)
                if c is not None:
                    tally[c] += k
            top[standing] = tally
        return top[standing]

    whole = first(frozenset(cands))

    @lru_cache(maxsize=None)
    def neb(w: int, x: int) -> float:
        mentions = sum(k for p, k in prefs if x in p and (w not in p or p.index(x) < p.index(w)))
        return (whole[w] - mentions) / n

    def best(suffix: tuple[int, ...]) -> tuple[float, tuple]:
        """The cheapest assertion that contradicts an order that ends in this suffix (first of it goes out first)."""
        head, rest = suffix[0], suffix[1:]
        options = []
        for c in rest:
            if (m := neb(head, c)) > 0:
                options.append((1 / m, ("NEB", head, c, (), m)))
        for c in cands:
            if c not in suffix and (m := neb(c, head)) > 0:
                options.append((1 / m, ("NEB", c, head, (), m)))
        if rest:
            tally = first(frozenset(suffix))
            for c in rest:
                if (m := (tally[head] - tally[c]) / n) > 0:
                    options.append((1 / m, ("NEN", head, c, tuple(sorted(suffix)), m)))
        return min(options, default=(np.inf, ()), key=lambda o: o[0])

    order = count()
    front: list[tuple[float, int, tuple[int, ...], tuple]] = []

    def grow(suffix: tuple[int, ...], cost: float, assertion: tuple) -> None:
        heappush(front, (-cost, next(order), suffix, assertion))

    for c in cands:
        if c != winner:
            grow((c,), *best((c,)))
    bound = 0.0
    done: dict[tuple[int, ...], tuple[float, tuple]] = {}
    while front:
        cost, _, suffix, assertion = heappop(front)
        cost = -cost
        if cost <= bound:
            done[suffix] = (cost, assertion)
            continue
        if len(suffix) == len(cands):
            if cost == np.inf:
                return []
            bound = max(bound, cost)
            done[suffix] = (cost, assertion)
            continue
        kids = {}
        for c in cands:
            if c not in suffix:
                kid = (c, *suffix)
                mine = best(kid)
                kids[kid] = mine if mine[0] < cost else (cost, assertion)
        if max(k[0] for k in kids.values()) >= cost and cost < np.inf:
            bound = max(bound, cost)
            done[suffix] = (cost, assertion)
        else:
            for kid, mine in kids.items():
                grow(kid, *mine)
    if any(c == np.inf for c, _ in done.values()):
        return []
    return few_assertions({suffix: a for suffix, (_, a) in done.items()})


def rules_out(assertion: tuple, suffix: tuple[int, ...]) -> bool:
    """Whether an assertion contradicts every elimination order that ends in the suffix (its first goes out first, its last wins)."""
    kind, winner, loser, standing, _ = assertion
    if kind == "NEB":  # the winner is not out before the loser
        return loser in suffix and (winner not in suffix or suffix.index(winner) < suffix.index(loser))
    return winner in suffix and set(suffix[suffix.index(winner) :]) == set(standing)  # it is not the next to go while these stand


def few_assertions(found: dict[tuple[int, ...], tuple]) -> list[tuple]:
    """A subset of the assertions found for suffixes that still rules out each of them.

    One "not eliminated before" takes the place of every "not eliminated next" of the same pair; then, as long as a
    suffix is left, the assertion that rules out most of them is kept (ties: the easier one), and what others rule out is dropped.
    """
    pool = set(found.values())
    pairs = {(a[1], a[2]): a for a in pool if a[0] == "NEB"}
    pool = {pairs.get((a[1], a[2]), a) for a in pool}
    covers = {a: {s for s in found if rules_out(a, s)} for a in pool}
    left, kept = set(found), []
    while left:
        a = max(covers, key=lambda a: (len(covers[a] & left), a[4], a))
        kept.append(a)
        left -= covers[a]
    for a in sorted(kept, key=lambda a: a[4]):  # the hardest first
        if set().union(*[covers[b] for b in kept if b is not a]) >= set(found):
            kept.remove(a)
    return sorted(kept, key=lambda a: (a[4], a))


# --- seats under risk ------------------------------------------------------------------------------


def seat_failures(votes: dict[int, int], seats: int, npop: int, min_fraction: float, risk_of: Callable[[float], float], limit: float = 0.05) -> tuple[dict[int, int], list[tuple[int, int, int, int]]]:
    """Reported seats of each party, and the seats that are not safe: (winner, its divisor, loser, its divisor) of each
    assertion whose risk is above the limit, in the reported outcome or in one that follows if others fail.

    A failed assertion flips one seat, which gives another outcome with assertions of its own; these are looked at breadth
    first, each pair of scores once, in whichever direction. A party so near to the least share that this is not safe
    gives outcomes in which it is on the other side, one party at a time. risk_of: the risk left at a comparison value.
    """
    valid = sum(votes.values())

    def assign(eligible: set[int]) -> dict[int, int]:
        scores = sorted(((votes[p] / d, -d, -p) for p in eligible for d in range(1, seats + 1)), reverse=True)[:seats]
        won = dict.fromkeys(votes, 0)
        for _, _, p in scores:
            won[-p] += 1
        return won

    def noerror(mean: float, upper: float) -> float:
        return 1 / (2 - (2 * mean - 1) / upper)

    def failing(won: dict[int, int], eligible: set[int]) -> list[tuple[int, int, int, int]]:
        out = []
        for a in sorted(eligible):
            for b in sorted(eligible):
                last, first = won[a], won[b] + 1
                if a != b and last > 0 and first <= seats:
                    mean = 0.5 + (votes[a] / last - votes[b] / first) * first / 2 / npop
                    if risk_of(noerror(mean, (first / last + 1) / 2)) > limit:
                        out.append((a, last, b, first))
        return out

    def other_side(eligible: set[int]) -> Iterator[set[int]]:
        for p in sorted(votes):
            gain, mine = votes[p] / (2 * min_fraction), p in eligible
            mean = ((gain if mine else (valid - votes[p]) / (2 * (1 - min_fraction))) + (npop - valid) * 0.5) / npop
            if risk_of(noerror(mean, 1 / (2 * min_fraction) if mine else 1 / (2 * (1 - min_fraction)))) > limit:
                yield eligible ^ {p}

    start = {p for p, v in votes.items() if v >= min_fraction * valid}
    reported = assign(start)
    done: set[frozenset] = set()
    queue = [(reported, start)] + ([(assign(e), e) for e in other_side(start) if e] if min_fraction > 0 else [])
    out = []
    for won, eligible in queue:
        for a, last, b, first in failing(won, eligible):
            pair = frozenset(((a, last), (b, first)))
            if pair not in done:
                done.add(pair)
                out.append((a, last, b, first))
                queue.append((won | {a: won[a] - 1, b: won[b] + 1}, eligible))
    return reported, out
