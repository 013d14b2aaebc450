"""Betting martingales: Column expressions over running sums, and the numeric folds that need order."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-5
#: Rates of each error per fuzzed card, by the number of candidates (more than 10 as 10, fewer than 2 as 2). Fixed values.
FUZZ_RATES = {
    2: {"win-los": 0.21339818181818182, "win-oth": 0.2664109090909091, "oth-los": 0.2664109090909091, "los-oth": 0.2591127272727273, "oth-win": 0.2591127272727273, "los-win": 0.20853636363636363},
    3: {"win-los": 0.13128727272727272, "win-oth": 0.3697027272727273, "oth-los": 0.3697027272727273, "los-oth": 0.26815272727272726, "oth-win": 0.26815272727272726, "los-win": 0.0780790909090909},
    4: {"win-los": 0.08808363636363636, "win-oth": 0.3794666666666667, "oth-los": 0.3794666666666667, "los-oth": 0.23896242424242425, "oth-win": 0.23896242424242425, "los-win": 0.04194484848484849},
    5: {"win-los": 0.062468636363636365, "win-oth": 0.3578081818181818, "oth-los": 0.3578081818181818, "los-oth": 0.20814772727272726, "oth-win": 0.20814772727272726, "los-win": 0.025486818181818183},
    6: {"win-los": 0.048581454545454546, "win-oth": 0.3369643636363636, "oth-los": 0.3369643636363636, "los-oth": 0.19450036363636364, "oth-win": 0.19450036363636364, "los-win": 0.02000618181818182},
    7: {"win-los": 0.039082121212121214, "win-oth": 0.32060333333333335, "oth-los": 0.32060333333333335, "los-oth": 0.16815060606060606, "oth-win": 0.16815060606060606, "los-win": 0.013656969696969697},
    8: {"win-los": 0.03302077922077922, "win-oth": 0.30717766233766236, "oth-los": 0.30717766233766236, "los-oth": 0.15172103896103897, "oth-win": 0.15172103896103897, "los-win": 0.010150649350649351},
    9: {"win-los": 0.028155909090909093, "win-oth": 0.29654977272727273, "oth-los": 0.29654977272727273, "los-oth": 0.14481227272727273, "oth-win": 0.14481227272727273, "los-win": 0.008987727272727272},
    10: {"win-los": 0.02313131313131313, "win-oth": 0.2760222222222222, "oth-los": 0.2760222222222222, "los-oth": 0.1349258585858586, "oth-win": 0.1349258585858586, "los-win": 0.007379595959595959},
}


def mean_under_null(n: Column, total: Column, before: Column) -> Column:
    """(N/2 - S) / (N - j): the mean of what is left if the null hypothesis holds, after j samples of sum S."""
    return F.try_divide(n * 0.5 - total, n - before)


def eta_to_lambda(eta: Column, mu: Column, upper: Column | float) -> Column:
    return F.try_divide(F.try_divide(eta, mu) - 1, upper - mu)


def lambda_to_eta(lam: Column, mu: Column, upper: Column | float) -> Column:
    return mu * (1 + lam * (upper - mu))


def shrink_trunc(eta0: Column, d: int, j: Column, total: Column, mu: Column, upper: Column | float) -> Column:
    """The estimate of the mean from the samples so far and the prior eta0, kept between the null mean and the upper bound."""
    c = (eta0 - 0.5) / 2
    guess = (d * eta0 + total) / (d + j)
    return F.least(F.greatest(mu + c / F.sqrt(d + j), guess), F.lit(upper) * (1 - EPSILON) if isinstance(upper, float) else upper * (1 - EPSILON))


def margin_from_samples(bet: Column, alpha: Column | float, n: Column) -> Column:
    """The margin that n error-free samples confirm: 2 - 2b / (2 e^(-ln(alpha)/n) - 2 + b)."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return 2 - 2 * bet / (2 * F.exp(-F.log(a) / n) - 2 + bet)


def kaplan_markov(n: Column, o1: Column, o2: Column, u1: Column, u2: Column, gamma: Column | float, margin: Column) -> Column:
    """The comparison risk after n samples with counts of one- and two-vote over- and understatements, at most 1."""
    g = F.lit(gamma) if isinstance(gamma, float) else gamma
    big = 2 * g / margin
    return F.least(F.lit(1.0), F.pow(1 - 1 / big, n) * F.pow(1 - 1 / (2 * g), -o1) * F.pow(1 - 1 / g, -o2) * F.pow(1 + 1 / (2 * g), -u1) * F.pow(1 + 1 / g, -u2))


def agrapa(j: Column, mean: Column, variance: Column, mu: Column, first: float, c0: float, c_most: float, grow: float) -> Column:
    """The approximate growth-rate bet from the mean and variance of the samples before, kept between 0 and c / mu, where c grows from c0 to c_most; the first bet is given."""
    gap = mean - mu
    c = c0 + (c_most - c0) * (1 - 1 / (1 + grow * F.sqrt(j)))
    return F.when(j == 0, F.lit(first)).otherwise(F.greatest(F.lit(0.0), F.least(F.try_divide(gap, variance + gap * gap), F.try_divide(c, mu))))


def optimal_comparison(upper: Column, rate2: float, mu: Column) -> Column:
    """The bet that is optimal if two-vote overstatements at the given rate are the only errors: a constant estimate of the mean as a bet."""
    p0 = 1 - max(rate2, 1e-5)
    eta = (1 - upper * p0) / (2 - 2 * upper) + upper * p0 - 0.5
    return eta_to_lambda(eta, mu, upper)


def samples_with_errors(alpha: float, bet: Column, noerr: Column, p0: Column, terms: list[tuple[Column, Column]]) -> Column:
    """ceil(-ln(alpha) / (p0 ln(1 + b (noerror - 1/2)) + sum of rate * ln(1 + b (value - 1/2))))."""
    gain = p0 * F.log(1 + bet * (noerr - 0.5))
    for rate, value in terms:
        gain = gain + rate * F.log(1 + bet * (value - 0.5))
    return F.ceil(-math.log(alpha) / gain)


def sample_size(noerr: float, n: int, alpha: float, max_loss: float = 0.9) -> int:
    """The first sample at which an error-free comparison audit reaches the risk limit; 0 if it never does.

    The bet is max_loss / mu, with the null mean after the sample at hand has been counted. Samples are taken in growing
    chunks, so that memory and time follow the answer, not n.
    """
    goal, log_t, first, chunk = -math.log(alpha), 0.0, 1, 256
    while first <= n:
        j = np.arange(first, min(n, first + chunk - 1) + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            mu = np.where(j < n, (n * 0.5 - noerr * j) / (n - j), 0.0)
            logs = log_t + np.cumsum(np.log1p(np.where(mu > 0, max_loss / mu * (noerr - mu), 0.0)))
        hit = np.flatnonzero((mu <= 0) | (logs >= goal))
        if len(hit):
            return int(j[hit[0]])
        log_t, first, chunk = float(logs[-1]), int(j[-1]) + 1, min(2 * chunk, 1 << 20)
    return 0


def best_bet(values: np.ndarray, rates: np.ndarray, noerr: float, mu: float, max_loss: float) -> float:
    """The bet in [0, max_loss / mu] with the largest expected log gain; the function is concave, so its slope is bisected.

    values and their rates: errors and, in a pooled audit, the values of pooled cards; the rest of the cards has none.
    """
    top = max_loss / mu
    v = np.append(values, noerr) - mu
    p = np.append(rates, max(0.0, 1.0 - rates.sum()))

    def slope(lam: float) -> float:
        return float((p * v / (1 + lam * v)).sum())

    if slope(top) >= 0:
        return top
    if slope(0.0) <= 0:
        return 0.0
    low, high = 0.0, top
    while high - low > 1e-7 * top:
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return (low + high) / 2


class AdaptiveBet:
    """An adaptive comparison audit of one assertion, fed with runs of samples in order.

    The bet is the best one for the rates of errors measured so far; in a pooled audit, with the values of pooled cards and
    their rates (pooled) beside them, and pooled cards' own values count as no errors. It is used again for at most
    ``reuse`` samples while the counts of errors stay the same and more than ten samples have been seen. Without errors
    and pools it is max_loss / mu. A state may be carried into a later round (``resume``).
    """

    def __init__(self, n: int, noerr: float, upper: float, alpha: float, max_loss: float = 0.9, reuse: int = 10, pooled: tuple[np.ndarray, np.ndarray] | None = None):
        self.n, self.noerr, self.upper, self.goal, self.max_loss, self.reuse, self.pooled = n, noerr, upper, -math.log(alpha), max_loss, reuse, pooled
        self.j, self.total, self.log_t, self.counts, self.last = 0, 0.0, 0.0, {}, None
        self.status = ""

    def resume(self, samples: int, total: float, p: float, counts: dict[float, int]) -> AdaptiveBet:
        """Goes on where an earlier round ended: with its samples, their sum, its last p-value and its errors."""
        self.j, self.total, self.log_t, self.counts, self.last = samples, total, -math.log(p) if p > 0 else math.inf, dict(counts), None
        return self

    @property
    def p(self) -> float:
        return 0.0 if self.status == "sum_rejects_null" else min(1.0, math.exp(-self.log_t)) if self.log_t < 700 else 0.0

    def _bet(self, mu: np.ndarray) -> tuple[np.ndarray, int]:
        """The bets of the next samples with these null means, and of how many of them they hold."""
        most = self.max_loss / np.where(mu > 1e-12, mu, 1.0)
        if not self.counts and self.pooled is None:
            return most, len(mu)
        key = tuple(sorted(self.counts.items()))
        if self.last is not None and self.last[0] == key and self.last[2] < self.reuse and self.j > 10:
            k = min(self.reuse - self.last[2], len(mu))
            self.last = (key, self.last[1], self.last[2] + k)
            return np.minimum(self.last[1], most[:k]), k
        values, rates = np.array(list(self.counts)), np.array([c / self.j for c in self.counts.values()])
        if self.pooled is not None:
            values, rates = np.append(values, self.pooled[0]), np.append(rates, self.pooled[1])
        lam = best_bet(values, rates, self.noerr, float(mu[0]), self.max_loss) if mu[0] > 1e-12 else 0.0
        self.last = (key, lam, 0)
        return np.array([lam]), 1

    def feed(self, value: float, times: int = 1, error: bool | None = None) -> bool:
        """Takes so many samples of one value; whether more are wanted. error: whether it counts as one (None: if it is not noerror)."""
        while times > 0 and not self.status:
            m = min(times, 1 << 16)
            i = np.arange(m)
            mu = (self.n * 0.5 - self.total - value * i) / np.maximum(self.n - self.j - i, 1)
            lam, k = self._bet(mu)
            mu = mu[:k]
            factors = np.maximum(0.0, 1 + lam[:k] * (value - mu))
            with np.errstate(divide="ignore"):
                logs = self.log_t + np.cumsum(np.log(factors))
            over, done = np.flatnonzero((mu > self.upper) | (mu < 1e-12)), np.flatnonzero(logs > self.goal)
            if len(over) and (not len(done) or over[0] <= done[0]):
                at = int(over[0])
                self.status = "accept_null" if mu[at] > self.upper else "sum_rejects_null"
                self.log_t = float(logs[at - 1]) if at else self.log_t
                self.j += at
                return False
            taken = int(done[0]) + 1 if len(done) else k
            self.log_t, self.j, self.total, times = float(logs[taken - 1]), self.j + taken, self.total + value * taken, times - taken
            if error if error is not None else abs(value - self.noerr) > 1e-8 + 1e-5 * self.noerr:
                name = round(float(value), 12)
                self.counts[name] = self.counts.get(name, 0) + taken
            if len(done):
                self.status = "rejects_null"
        return not self.status


def adaptive_runs(bet: AdaptiveBet, samples: int, at: list[int], values: list[float], errors: list[bool] | None = None) -> tuple[int, float, str]:
    """Samples used, the last p-value and the status after so many samples, all without error but those at the given places (from 0, in order)."""
    done = 0
    for k, (place, value) in enumerate(zip(at, values)):
        if not bet.feed(bet.noerr, place - done) or not bet.feed(value, 1, None if errors is None else errors[k]):
            break
        done = place + 1
    else:
        bet.feed(bet.noerr, samples - done)
    return bet.j, bet.p, bet.status or "limit_reached"
