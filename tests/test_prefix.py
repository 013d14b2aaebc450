import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotlens.functions import betting
from ballotlens.functions.betting import AdaptiveBet, adaptive_runs, best_bet, sample_size
from ballotlens.operators import prefix, risk

KEYS = ["contest_id", "winner", "loser"]


@pytest.mark.parametrize("most", [10, 10**9])
def test_running_sums_with_and_without_buckets(spark, monkeypatch, most):
    monkeypatch.setattr(prefix, "PER_BUCKET", most)
    rng = random.Random(4)
    rows = [(k, rng.randrange(2**63), rng.randrange(100)) for k in [1] * 300 + [2] * 20 + [3]]
    df = spark.createDataFrame(rows, "k int, prn bigint, x int").repartition(5)
    bucket = prefix.number_bucket("prn", len(rows))
    assert (bucket is None) == (most > len(rows))
    got = {(r.k, r.prn): (r.s, r.n, r.m, r.before, r.place) for r in prefix.place(prefix.previous(prefix.before(df, ["k"], ["prn"], bucket, {"s": F.col("x"), "n": F.lit(1)}, {"m": F.col("x")}), ["k"], ["prn"], bucket, "x"), ["k"], ["prn"], bucket).collect()}
    want = {}
    for k in (1, 2, 3):
        seen = []
        for _, prn, x in sorted(r for r in rows if r[0] == k):
            want[k, prn] = (sum(seen), len(seen), max(seen, default=None), seen[-1] if seen else None, len(seen) + 1)
            seen.append(x)
    assert got == want


def test_no_window_over_a_whole_group(spark, monkeypatch):
    monkeypatch.setattr(prefix, "PER_BUCKET", 10)
    df = spark.range(100).selectExpr("1 as k", "id * 92233720368547758 as prn", "id as x")
    plan = prefix.before(df, ["k"], ["prn"], prefix.number_bucket("prn", 100), {"s": F.col("x")})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Window")]
    assert len(windows) == 2 and sum("__bucket" in line.split("],")[1] for line in windows) >= 1


def sequential(x, errors, n, noerr, upper, alpha, max_loss=0.9, reuse=10, pooled=None):
    """The audit one sample at a time."""
    counts, total, t, p, last, used = {}, 0.0, 1.0, 1.0, None, 0
    for j, value in enumerate(x):
        mu = (n * 0.5 - total) / (n - j)
        if mu > upper:
            return j, p, "accept_null"
        if mu < 1e-12:
            return j, 0.0, "sum_rejects_null"
        key = tuple(sorted(counts.items()))
        if not counts and pooled is None:
            lam = max_loss / mu
        elif last is not None and last[0] == key and used < reuse and j > 10:
            lam, used = min(last[1], max_loss / mu), used + 1
        else:
            v, r = np.array(list(counts)), np.array([c / j for c in counts.values()])
            if pooled is not None:
                v, r = np.append(v, pooled[0]), np.append(r, pooled[1])
            lam = best_bet(v, r, noerr, mu, max_loss)
            last, used = (key, lam), 0
        t *= max(0.0, 1 + lam * (value - mu))
        p = 1.0 if t <= 0 else min(1.0, 1 / t)
        if p < alpha:
            return j + 1, p, "rejects_null"
        total += value
        if errors[j]:
            name = round(float(value), 12)
            counts[name] = counts.get(name, 0) + 1
    return len(x), p, "limit_reached"


def test_runs_equal_the_sequential_audit():
    rng = np.random.default_rng(8)
    seen = set()
    for trial in range(60):
        n, margin = int(rng.integers(200, 3000)), float(rng.choice([0.005, 0.02, 0.1, 0.5]))
        noerr = 1 / (2 - margin)
        rate = float(rng.choice([0, 0.01, 0.1]))
        pools = trial % 3 == 0
        x = np.where(rng.random(n) < rate, rng.choice([0.0, 0.5, 1.5, 2.0], n) * noerr, noerr)
        errors = np.abs(x - noerr) > 1e-9
        pooled = None
        if pools:
            values = np.array([0.45, 0.95, 1.45]) * noerr
            mine = rng.random(n) < 0.2
            x, errors = np.where(mine, rng.choice(values, n), x), errors & ~mine
            pooled = (values, np.array([0.05, 0.08, 0.07]))
        want = sequential(x, errors, n, noerr, 2 * noerr, 0.05, pooled=pooled)
        at = np.flatnonzero(np.abs(x - noerr) > 1e-9)
        got = adaptive_runs(AdaptiveBet(n, noerr, 2 * noerr, 0.05, pooled=pooled), n, at.tolist(), x[at].tolist(), errors[at].tolist())
        assert got[0] == want[0] and got[2] == want[2] and abs(got[1] - want[1]) < 1e-6, (trial, got, want)
        seen.add(got[2])
    assert {"rejects_null", "limit_reached"} <= seen


def test_sample_size_in_chunks():
    for noerr, n in ((0.5025, 100_000), (0.51, 5_000), (0.75, 40), (0.5, 1_000)):
        total = log_t = 0.0
        want = 0
        for j in range(1, n + 1):
            total += noerr
            mu = (n * 0.5 - total) / (n - j) if j < n else 0.0
            log_t += np.log1p(0.9 / mu * (noerr - mu)) if mu > 0 else 0.0
            if mu <= 0 or log_t >= -np.log(0.05):
                want = j
                break
        assert sample_size(noerr, n, 0.05) == want


@pytest.mark.parametrize("most", [7, 10**9])
def test_adaptive_over_a_table(spark, monkeypatch, most):
    monkeypatch.setattr(prefix, "PER_BUCKET", most)
    rng = np.random.default_rng(1)
    ne, rows, want = 0.52, [], {}
    for c in (1, 2):
        prn = sorted(int(v) for v in rng.integers(0, 2**63 - 1, 500))
        x = np.where(rng.random(500) < 0.02, 0.5 * ne, ne)
        want[c] = sequential(x, x != ne, 600, ne, 2 * ne, 0.05)
        rows += [(c, 1, 2, p, float(v), 600, ne) for p, v in zip(prn, x)]
    df = spark.createDataFrame(rows, "contest_id int, winner int, loser int, prn bigint, value double, npop bigint, noerror double").repartition(6)
    got = {r.contest_id: (r.used, r.p_value, r.status) for r in risk.adaptive(df, KEYS, "prn", "value", "npop", "noerror", 0.05, bucket=prefix.number_bucket("prn", 1000)).collect()}
    assert all(got[c][0] == want[c][0] and got[c][2] == want[c][2] and abs(got[c][1] - want[c][1]) < 1e-6 for c in want)
    assert risk.adaptive(df.limit(0), KEYS, "prn", "value", "npop", "noerror", 0.05).count() == 0


def test_a_trial_goes_on_where_a_round_ended(spark):
    ne = 0.515
    a = spark.createDataFrame([(1, 1, 2, 2000, ne)], "contest_id int, winner int, loser int, npop bigint, noerror double")
    cards = spark.createDataFrame([(1, i * 5, i % 97 == 3) for i in range(2000)], "contest_id int, prn bigint, phantom boolean")
    whole = risk.comparison_trial(a, cards, 0.05).collect()[0]
    assert whole.status == "rejects_null" and whole.needed > 50
    k = 40
    bet = AdaptiveBet(2000, ne, 2 * ne, 1e-9)
    adaptive_runs(bet, k, [3], [ne / 2])
    previous = spark.createDataFrame([(1, 1, 2, k, float(bet.total), float(np.exp(-bet.log_t)), bet.counts)], "contest_id int, winner int, loser int, samples bigint, total double, p_value double, errors map<double,int>")
    # the bet after the break is found anew, so a few cards may differ, but none is looked at twice
    later = risk.comparison_trial(a, cards, 0.05, previous=previous).collect()[0]
    assert abs(later.needed + k - whole.needed) <= 3 and later.status == "rejects_null"


def test_polling_trials_draw_prefixes():
    rng = np.random.default_rng(3)
    small = [risk.polling_trial(rng, 600, 400, 1000, 0.05) for _ in range(30)]
    assert 1 <= min(small) and max(small) <= 1000 and np.mean(small) < 700
    # a huge electorate costs no more than the cards that are needed
    assert risk.polling_trial(rng, 60_000_000, 40_000_000, 100_000_000, 0.05) < 5_000
    assert risk.polling_trial(rng, 0, 0, 0, 0.05) == 0 and risk.polling_trial(rng, 500, 500, 1000, 0.05) <= 1000
    later = [risk.polling_trial(rng, 600, 400, 1000, 0.05, used=100, total=62.0, p_last=0.2) for _ in range(30)]
    assert np.mean(later) < np.mean(small)


def test_left_risk(spark):
    df = spark.createDataFrame([(1000, 0.55, 9), (10, 0.4, 9), (5, 0.6, 30)], "npop bigint, noerror double, n bigint")
    got = [r.risk for r in risk.risk_left(df).collect()]
    t = 1.0
    for j in range(1, 11):
        mu = (500 - 0.55 * j) / (1000 - j)
        t *= 1 + 2 / 1.03905 * (0.55 - mu)
    assert abs(got[0] - 1 / t) < 1e-12 and got[1] >= 1 and 0 < got[2] < 1
