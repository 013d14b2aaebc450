"""Assorters: the number that a ballot contributes to an assertion, as Column expressions.

cands is the array of marked candidates of the contest, null where the ballot lacks the contest; such a
ballot counts 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballotlens.functions.votes import marks

HALF = 0.5


def _has(cands: Column, value: Column, phantom: Column | None, phantom_value: float = 0.0) -> Column:
    out = F.when(cands.isNull(), HALF).otherwise(value)
    return out if phantom is None else F.when(phantom, F.lit(phantom_value)).otherwise(out)


def plurality(cands: Column, winner: Column, loser: Column, phantom: Column | None = None) -> Column:
    """(w - l + 1) / 2, at most 1."""
    return _has(cands, (marks(cands, winner) - marks(cands, loser) + 1) * HALF, phantom)


def above_threshold(cands: Column, cand: Column, t: Column | float, known: Column, phantom: Column | None = None) -> Column:
    """Share above t: 1/(2t) for one mark of the candidate, 0 for one of another known candidate, else 1/2. At most 1/(2t)."""
    only = cands[0]
    value = F.when(F.size(cands) != 1, HALF).when(only == cand, 1 / (2 * (F.lit(t) if isinstance(t, float) else t))).when(F.array_contains(known, only), 0.0).otherwise(HALF)
    return _has(cands, value, phantom)


def below_threshold(cands: Column, cand: Column, t: Column | float, known: Column, phantom: Column | None = None) -> Column:
    """Share below t: 0 for one mark of the candidate, 1/(2(1-t)) for one of another known candidate, else 1/2. At most 1/(2(1-t))."""
    only = cands[0]
    value = F.when(F.size(cands) != 1, HALF).when(only == cand, 0.0).when(F.array_contains(known, only), 1 / (2 * (1 - (F.lit(t) if isinstance(t, float) else t)))).otherwise(HALF)
    return _has(cands, value, phantom)


def dhondt(cands: Column, winner: Column, loser: Column, last: Column, first: Column, phantom: Column | None = None) -> Column:
    """One mark: first/2 * g + 1/2 with g = 1/last for the winner, -1/first for the loser, else 0; other ballots 1/2. At most (first/last + 1)/2."""
    g = F.when(cands[0] == winner, 1 / last).when(cands[0] == loser, -1 / first).otherwise(0.0)
    return _has(cands, F.when(F.size(cands) != 1, HALF).otherwise(first / 2 * g + HALF), phantom)


def dhondt_upper(last: Column, first: Column) -> Column:
    return (first / last + 1) / 2


def not_eliminated_before(ranked: Column, winner: Column, loser: Column, phantom: Column | None = None) -> Column:
    """Ranked ballots: 1 if the winner is first, 0 if the loser stands before the winner or without it, else 1/2. A phantom counts 1/2."""
    w, x = F.array_position(ranked, winner), F.array_position(ranked, loser)
    awins, bwins = (w == 1).cast("int"), ((x > 0) & ((w == 0) | (x < w))).cast("int")
    return _has(ranked, (awins - bwins + 1) * HALF, phantom, HALF)


def not_eliminated_next(ranked: Column, winner: Column, loser: Column, remaining: Column, phantom: Column | None = None) -> Column:
    """Ranked ballots: 1, 0 or 1/2 as the first preference among the remaining candidates is the winner, the loser or neither."""
    top = F.get(F.filter(ranked, lambda c: F.array_contains(remaining, c)), F.lit(0))
    value = (F.coalesce((top == winner).cast("int"), F.lit(0)) - F.coalesce((top == loser).cast("int"), F.lit(0)) + 1) * HALF
    return _has(ranked, value, phantom, HALF)


def margin_to_mean(margin: Column) -> Column:
    return (margin + 1) / 2


def mean_to_margin(mean: Column) -> Column:
    return 2 * mean - 1


def noerror(margin: Column, upper: Column | float = 1.0) -> Column:
    """The comparison value of a ballot without error: 1 / (2 - margin / upper)."""
    return 1 / (2 - margin / upper)


def overstatement(cvr: Column, mvr: Column, cvr_phantom: Column, mvr_phantom: Column, mvr_missing: Column, own_population: bool = False) -> Column:
    """cvr - mvr, where a phantom CVR counts 1/2, a phantom MVR 0, and an MVR that lacks the contest 0 under
    the population of cards that should hold it, else 1/2."""
    c = F.when(cvr_phantom, HALF).otherwise(cvr)
    m = F.when(mvr_phantom, 0.0).when(mvr_missing, 0.0 if own_population else HALF).otherwise(mvr)
    return c - m


def comparison(over: Column, upper: Column | float, noerr: Column) -> Column:
    """(1 - overstatement / upper) * noerror."""
    return (1 - over / upper) * noerr


#: Relative values of two-candidate and general assorters, by name. Fixed values.
TAUS = {"p2o": 0.0, "p1o": 0.5, "noerror": 1.0, "p1u": 1.5, "p2u": 2.0}
GENERAL_TAUS = ("win-los", "win-oth", "oth-los", "noerror", "oth-win", "los-oth", "los-win")


def general_tau(name: str, upper: Column) -> Column:
    """The relative value of an error by its name, for an assorter with the given upper bound."""
    u2 = 1 / (2 * upper)
    return {"win-los": F.lit(0.0), "win-oth": u2, "oth-los": 1 - u2, "noerror": F.lit(1.0), "oth-win": 2 - u2, "los-oth": 1 + u2, "los-win": F.lit(2.0)}[name]


def tau_name(relative: Column) -> Column:
    """The name of a relative comparison value of an assorter with upper bound 1; null if it is none of them."""
    out = F.lit(None).cast("string")
    for name, value in TAUS.items():
        out = F.when(F.abs(relative - value) <= 1e-8 + 1e-5 * abs(value), name).otherwise(out)
    return out


def margin_from_votes(winner: Column, loser: Column, n: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise((winner - loser) / n)


def threshold_mean(cand_votes: Column, valid_votes: Column, t: Column | float, n: Column, above: bool = True) -> Column:
    """The mean of a threshold assorter over n cards, of which valid_votes hold exactly one known mark."""
    t = F.lit(t) if isinstance(t, float) else t
    gain = cand_votes / (2 * t) if above else (valid_votes - cand_votes) / (2 * (1 - t))
    return (gain + (n - valid_votes) * HALF) / n


def difficulty(margin: Column) -> Column:
    return 1 / margin
