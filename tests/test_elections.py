import hashlib
import hmac
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotlens.functions import assorters as A
from ballotlens.functions import betting
from ballotlens.functions.prn import prn
from ballotlens.functions.votes import add_contests, explode_votes, may_have_contest
from ballotlens.operators import draws, outcome, pools, risk, simulate, tabulate
from ballotlens.operators.county import distribute
from ballotlens.operators.rounds import run_rounds


def one(df):
    return df.collect()[0]


def ballots(spark, votes):
    return spark.createDataFrame([(i, v, False) for i, v in enumerate(votes)], "id int, votes map<int,array<int>>, phantom boolean")


def test_votes(spark):
    df = ballots(spark, [{1: [2], 3: []}, {1: []}, {}])
    rows = {(r.id, r.contest_id, tuple(r.cands)) for r in explode_votes(df, "id").collect()}
    assert rows == {(0, 1, (2,)), (0, 3, ()), (1, 1, ())}
    more = df.select("id", add_contests(F.col("votes"), F.array(F.lit(1), F.lit(9))).alias("v")).collect()
    assert more[2].v == {1: [], 9: []} and more[0].v == {1: [2], 3: [], 9: []}
    has = df.select(may_have_contest(F.col("votes"), F.lit(-1), F.array(F.lit(3)), F.lit(3)).alias("own"), may_have_contest(F.col("votes"), F.lit(5), F.array(F.lit(3)), F.lit(3)).alias("style")).collect()
    assert [tuple(r) for r in has] == [(True, True), (False, True), (False, True)]


@pytest.mark.parametrize("cands,expected", [([1], (1.0, 1.25, 0.0)), ([2], (0.0, 0.0, 1 / 1.2)), ([3], (0.5, 0.0, 1 / 1.2)), ([9], (0.5, 0.5, 0.5)), ([], (0.5, 0.5, 0.5)), ([1, 2], (0.5, 0.5, 0.5)), (None, (0.5, 0.5, 0.5))])
def test_assorters(spark, cands, expected):
    df = spark.createDataFrame([(cands,)], "c array<int>")
    known = F.array(*[F.lit(i) for i in (1, 2, 3)])
    row = one(df.select(A.plurality(F.col("c"), F.lit(1), F.lit(2)), A.above_threshold(F.col("c"), F.lit(1), 0.4, known), A.below_threshold(F.col("c"), F.lit(1), 0.4, known)))
    assert all(abs(x - y) < 1e-12 for x, y in zip(row, expected))


def test_phantoms_and_ranked_assorters(spark):
    df = spark.createDataFrame([([2, 1, 3], False), ([1], False), ([3], False), ([], False), (None, False), ([1], True)], "c array<int>, p boolean")
    got = df.select(A.not_eliminated_before(F.col("c"), F.lit(1), F.lit(2), F.col("p")).alias("neb"), A.not_eliminated_next(F.col("c"), F.lit(1), F.lit(3), F.array(F.lit(1), F.lit(3)), F.col("p")).alias("nen"), A.plurality(F.col("c"), F.lit(1), F.lit(2), F.col("p")).alias("p")).collect()
    assert [r.neb for r in got] == [0.0, 1.0, 0.5, 0.5, 0.5, 0.5] and [r.nen for r in got] == [1.0, 1.0, 0.0, 0.5, 0.5, 0.5] and got[-1].p == 0.0


def test_dhondt(spark):
    tab = spark.createDataFrame([(1, 1, 10000), (1, 2, 6000), (1, 3, 1500)], "contest_id int, cand int, nvotes bigint")
    scores = outcome.dhondt_scores(tab, 8, 0.05)
    seats = {r.cand: (r.seats, r.last_won, r.first_lost) for r in outcome.dhondt_seats(scores).collect()}
    assert {c: s[0] for c, s in seats.items()} == {1: 5, 2: 3, 3: 0} and seats[3][1] is None
    for r in outcome.dhondt_assertions(outcome.dhondt_seats(scores)).collect():
        votes = {1: 10000, 2: 6000, 3: 1500}
        df = spark.createDataFrame([([c], n) for c, n in votes.items()], "c array<int>, n bigint")
        m = one(df.select((F.sum(A.dhondt(F.col("c"), F.lit(r.winner), F.lit(r.loser), F.lit(r.last), F.lit(r.first)) * F.col("n")) / F.sum("n")).alias("m"))).m
        gap = votes[r.winner] / r.last - votes[r.loser] / r.first
        assert m > 0.5 and abs(m - (0.5 + gap * r.first / 2 / 17500)) < 1e-9


def test_winners_and_ties(spark):
    tab = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 1), (2, 7, 3)], "contest_id int, cand int, nvotes bigint")
    n = spark.createDataFrame([(1, 1), (2, 2)], "contest_id int, nwinners int")
    got = {(r.contest_id, r.cand): r.is_winner for r in outcome.winners(tab, n).collect()}
    assert got == {(1, 1): False, (1, 2): True, (1, 3): False, (2, 7): True}
    assert {r.status for r in outcome.runoff(tab).where("contest_id = 1").collect()} == {"advances", "loses"}
    assert outcome.winners(tab.limit(0), n).count() == 0


def test_irv_and_raire():
    prefs = [((1, 2, 3), 40), ((2, 1, 3), 35), ((3, 2, 1), 25)]
    rounds = outcome.irv_rounds(prefs)
    assert [x for x in rounds if x[0] == 2] == [(2, 1, 40), (2, 2, 60)]
    got = outcome.raire(prefs, 2, 100)
    assert got and all(a[4] > 0 for a in got)
    orders = [(1, 3, 2), (3, 1, 2), (1, 2, 3), (2, 1, 3), (2, 3, 1), (3, 2, 1)]  # elimination orders; the last wins

    def ruled_out(order, a):
        kind, w, x, standing, _ = a
        if kind == "NEB":  # w cannot go out before x
            return order.index(w) < order.index(x)
        left = [c for c in order if c in standing]
        return set(order[len(order) - len(standing):]) == set(standing) and left[0] == w
    assert all(any(ruled_out(o, a) for a in got) for o in orders if o[-1] != 2)
    assert not any(ruled_out((3, 1, 2), a) for a in got)
    assert outcome.irv_rounds([]) == [] and outcome.raire([((1,), 5), ((2,), 5)], 1, 10) == []


def test_prn(spark):
    seed = 0x1122334455667788
    rows = spark.range(50).select("id", prn(seed, F.col("id")).alias("p")).collect()
    for r in rows:
        low = hmac.new(seed.to_bytes(8, "big"), (r.id + 1).to_bytes(4, "big"), hashlib.sha256).digest()[-8:]
        assert r.p == abs(int.from_bytes(low, "big", signed=True))


def test_consistent_sample_is_the_scan(spark):
    rng = np.random.default_rng(4)
    for _ in range(3):
        cards = [(int(p), sorted(set(map(int, rng.integers(0, 5, rng.integers(1, 4)))))) for p in rng.permutation(400)]
        want = {c: int(rng.integers(0, 40)) for c in range(4)}
        cc = spark.createDataFrame([(p, c) for p, cs in cards for c in cs], "prn bigint, contest_id int")
        wanted = spark.createDataFrame(list(want.items()), "contest_id int, n bigint")
        have, taken = dict.fromkeys(want, 0), set()
        for p, cs in sorted(cards):
            if any(have[c] < want[c] for c in cs if c in want):
                taken.add(p)
                for c in cs:
                    if c in want:
                        have[c] += 1
        assert {r.prn for r in draws.consistent_sample(cc, wanted).collect()} == taken
        kept = {r.contest_id: r.n for r in draws.sample_with_limits(cc, wanted, spark.createDataFrame([(c, 1000) for c in want], "contest_id int, nc bigint"), 1.0, 1000, 45).collect()}
        now = dict(want)
        while now and draws.consistent_sample(cc, spark.createDataFrame(list(now.items()), "contest_id int, n bigint")).count() > 45:
            now.pop(min(now, key=lambda c: (-now[c], c)))
        assert {c: n for c, n in kept.items() if n} == {c: n for c, n in now.items() if n}


def test_phantoms(spark):
    need = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "contest_id int, n int")
    assert {(r.phantom_no, tuple(r.contests)) for r in draws.make_phantoms(need).collect()} == {(1, (1, 2)), (2, (1,))}
    assert draws.make_phantoms(need, shared=False).count() == 3 and draws.make_phantoms(need.limit(0)).count() == 0


def loop_alpha(x, n, eta0, d=100, u=1.0):
    s, t, out = 0.0, 1.0, []
    for j, v in enumerate(x):
        mu = (n * 0.5 - s) / (n - j)
        eta = min(max(mu + (eta0 - 0.5) / 2 / math.sqrt(d + j), (d * eta0 + s) / (d + j)), u * (1 - betting.EPSILON))
        t *= 1 + (eta / mu - 1) / (u - mu) * (v - mu)
        out.append(1 / t)
        s += v
    return out


def test_alpha_window_is_the_loop(spark):
    rng = np.random.default_rng(2)
    x = rng.choice([0.0, 0.5, 1.0], 600, p=[0.35, 0.1, 0.55])
    df = spark.createDataFrame([(1, i, float(v), 5000, 0.6) for i, v in enumerate(x)], "k int, o int, x double, n bigint, eta0 double")
    got = [r.p for r in risk.alpha_mart(df, ["k"], "o", "x", "n", 1.0, "eta0").orderBy("o").collect()]
    want = [min(1.0, p) for p in loop_alpha(x, 5000, 0.6)]
    assert np.allclose(got, want, rtol=1e-9)
    d = one(risk.decisions(risk.alpha_mart(df, ["k"], "o", "x", "n", 1.0, "eta0"), ["k"], 0.05, 1.0))
    stop = next(i for i, p in enumerate(want) if p < 0.05)
    assert (d.used, d.status) == (stop + 1, "rejects_null")


def test_status_at_the_edges(spark):
    rows = [(1, i, 1.0, 6) for i in range(5)] + [(2, i, 0.0, 6) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, o int, x double, n bigint")
    run = risk.martingale(risk.running(df, ["k"], "o", "x"), ["k"], "o", "x", F.lit(0.1), "n", 1.0)
    assert {r.k: r.status for r in risk.decisions(run, ["k"], 0.05, 1.0).collect()} == {1: "sum_rejects_null", 2: "accept_null"}


def test_adaptive_bet():
    ne = 1 / (2 - 0.02)
    run = lambda n, at, values: betting.adaptive_runs(betting.AdaptiveBet(100_000, ne, 2 * ne, 0.05), n, at, values)
    used, p, status = run(2000, [], [])
    assert status == "rejects_null" and abs(used - betting.sample_size(ne, 100_000, 0.05)) <= 2
    later, _, s = run(2000, [100], [0.5 * ne])
    assert s == "rejects_null" and later > used
    assert run(0, [], [])[2] == "limit_reached"
    grid = np.linspace(0, 0.9 / 0.5, 20001)
    v, r = np.array([0.5 * ne, 1.5 * ne]), np.array([0.01, 0.005])
    gain = 0.985 * np.log(1 + grid * (ne - 0.5)) + (r[:, None] * np.log(1 + grid[None] * (v[:, None] - 0.5))).sum(0)
    assert abs(betting.best_bet(v, r, ne, 0.5, 0.9) - grid[gain.argmax()]) < 1e-3


def test_integer_quantile(spark):
    df = spark.createDataFrame([([10, 1, 40, 2],), ([7],), ([827, 900],)], "v array<bigint>")
    assert [r.q for r in df.select(tabulate.quantile_integer(F.col("v"), 80).alias("q")).collect()] == [22, 7, 886]


def test_pool_values_sum_up(spark):
    v = spark.createDataFrame([(42, 0, [1])] * 1288 + [(42, 0, [2])] * 1187 + [(42, 0, [])] * 525, "pool_id int, contest_id int, cands array<int>")
    a = spark.createDataFrame([(0, 1, 2, 1 / (2 - 0.04), 50_000)], "contest_id int, winner int, loser int, noerror double, npop bigint")
    avg = pools.pool_averages(v, a)
    assert abs(one(avg).pool_avg - 0.5168333333) < 1e-9
    got = {r.kind: r for r in pools.pool_values(avg, a).collect()}
    assert abs(got["loser"].value - 0.2465136) < 1e-6 and abs(got["loser"].rate - 0.02374) < 1e-9 and abs(got["winner"].rate - 0.02576) < 1e-9 and abs(got["other"].rate - 0.0105) < 1e-9


def test_simulated_pool_has_exact_totals(spark):
    places = spark.range(100).selectExpr("1 as pool_id", "2 as contest_id", "id as card_key")
    counts = spark.createDataFrame([(1, 2, 5, 30), (1, 2, 6, 45)], "pool_id int, contest_id int, cand int, nvotes bigint")
    got = simulate.simulate_pool(places.repartition(7), counts, 3)
    assert {r.cand: r["count"] for r in got.groupBy("cand").count().collect()} == {5: 30, 6: 45, None: 25}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, simulate.simulate_pool(places, counts, 3).collect()), key=str)


def test_fuzz(spark):
    v = spark.range(4000).selectExpr("id as card_key", "1 as contest_id", "array(cast(id % 3 as int)) as cands")
    c = spark.createDataFrame([(1, i) for i in range(3)], "contest_id int, cand int")
    out = simulate.fuzz(v, c, 0.1, 5).collect()
    changed = [r for r in out if r.fuzzed != r.cands]
    assert 320 < len(changed) < 480 and {tuple(r.fuzzed) for r in changed} == {(), (0,), (1,), (2,)}


def test_distribute_is_exact(spark):
    w = spark.createDataFrame([(1, 1, 3), (1, 2, 3), (1, 3, 1), (2, 9, 0)], "k int, part int, weight bigint")
    need = spark.createDataFrame([(1, 10), (2, 4)], "k int, need bigint")
    assert {(r.k, r.part): r.share for r in distribute(w, need, ["k"], "part").collect()} == {(1, 1): 4, (1, 2): 4, (1, 3): 2}


def test_rounds(spark):
    ne = 1 / (2 - 0.2)
    c = spark.createDataFrame([(1, 1, 2, i, ne, 500, ne) for i in range(500)], "contest_id int, winner int, loser int, prn bigint, value double, npop bigint, noerror double")
    a = spark.createDataFrame([(1, 1, 2, 500, ne)], "contest_id int, winner int, loser int, npop bigint, noerror double")
    cc = spark.range(500).selectExpr("id as prn", "1 as contest_id")
    got = run_rounds(c, cc, a, 0.05).collect()
    assert got[-1].done and len(got) <= 2 and got[-1].status == "rejects_null"
    assert run_rounds(c, cc, a.limit(0), 0.05).count() == 0


def test_streaming_risk(spark, tmp_path):
    from ballotlens.streaming.arrivals import running_risk

    rows = [(k, 0.6 if i % 3 else 0.4) for i in range(60) for k in (1, 2)] + [(1, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = running_risk(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["k"], "v", 0.5).writeStream.outputMode("complete").format("memory").queryName("risk").start()
    q.processAllAvailable()
    q.stop()
    got = {r.k: r.p_value for r in spark.table("risk").collect()}
    want = {r.k: r.p_value for r in running_risk(df, ["k"], "v", 0.5).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_risk_queries_over_all_cards(spark):
    from ballotlens.plans import audits, ballots, base

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no data")
    cards = {(r.contest_id, r.winner, r.loser): r["count"] for r in ballots.compared(spark, d).where("prn is not null").groupBy("contest_id", "winner", "loser").count().collect()}
    got = audits.QUERIES["betting_mart"](spark, d).collect()
    assert {(r.contest_id, r.winner, r.loser): r.samples for r in got} == cards and max(cards.values()) > 26
    most = audits.QUERIES["betting_mart"](spark, d).agg(F.max("used")).first()[0]
    assert most > 26 and audits.QUERIES["adaptive_betting"](spark, d).agg(F.max("used")).first()[0] > 26


def test_runoff_and_dhondt_have_all_assertions(spark):
    tab = lambda *n: spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(n)], "contest_id int, cand int, nvotes bigint")
    rows = lambda df, *c: {tuple(r) for r in df.select(*c).collect()}
    got = outcome.runoff_assertions(outcome.runoff(tab(40, 35, 25)))
    assert rows(got, "kind", "cand", "loser") == {("below", 1, None), ("below", 2, None), ("plurality", 1, 3), ("plurality", 2, 3)}
    t = tab(10000, 6000, 1500, 800, 100)
    got = outcome.dhondt_thresholds(t, outcome.dhondt_scores(t, 8, 0.05), 0.05)
    # the last seat is party 1's fifth (2000); party 4 is nearer to 5 per cent of 18400 than to that seat, party 5 too
    assert rows(got, "kind", "winner", "loser", "last", "first") == {("above", 1, None, None, None), ("above", 2, None, None, None), ("above", 3, None, None, None), ("dhondt", 1, 4, 5, 1), ("dhondt", 1, 5, 5, 1)}
    t = tab(10000, 900)
    assert rows(outcome.dhondt_thresholds(t, outcome.dhondt_scores(t, 20, 0.1), 0.1), "kind", "winner") == {("above", 1), ("below", 2)}


def test_simulated_pool_with_several_votes(spark):
    places = spark.range(100).selectExpr("1 as pool_id", "2 as contest_id", "id as card_key")
    counts = spark.createDataFrame([(1, 2, 5, 70), (1, 2, 6, 100), (1, 2, 7, 65)], "pool_id int, contest_id int, cand int, nvotes bigint")
    got = simulate.simulate_pool(places, counts, 3).collect()
    assert {c: sum(r.cand == c for r in got) for c in (5, 6, 7)} == {5: 70, 6: 100, 7: 65} and len(got) == 235
    assert len({(r.card_key, r.cand) for r in got}) == 235 and len({r.card_key for r in got}) == 100


def test_irv_ties_fork(spark):
    ballots = spark.createDataFrame([(9, [1], 5), (9, [2, 3], 3), (9, [3, 2], 3)], "contest_id int, prefs array<int>, nballots bigint")
    got = {(r.path, r.round, r.cand, r.nvotes, r.goes, r.wins) for r in outcome.irv_count(ballots).collect()}
    assert got == {("", 1, 1, 5, False, False), ("", 1, 2, 3, True, False), ("", 1, 3, 3, True, False), ("2", 2, 1, 5, False, False), ("2", 2, 3, 6, False, True), ("3", 2, 1, 5, False, False), ("3", 2, 2, 6, False, True)}
    assert len({x[0] for x in outcome.irv_paths([((c,), 1) for c in range(8)])}) == 2**8 - 8 - 1


def test_query_runs_all_rounds(spark, monkeypatch):
    import inspect

    from ballotlens.plans import rest

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no data")
    asked = inspect.signature(run_rounds)
    monkeypatch.setattr(rest.rounds, "run_rounds", lambda *a, **kw: (b := asked.bind(*a, **kw)).apply_defaults() or b.arguments["most_rounds"])
    assert rest.QUERIES["run_rounds"](spark, d) == 7


def test_few_assertions_rule_out_all_orders():
    import itertools
    import random

    rng = random.Random(7)
    for k in (3, 4, 5, 6):
        for _ in range(5):
            prefs = {}
            for _ in range(300):
                p = tuple(sorted(range(k), key=lambda c: rng.random() * (c + 1)))[: rng.randrange(1, k + 1)]
                prefs[p] = prefs.get(p, 0) + 1
            prefs = list(prefs.items())
            last = [x for x in outcome.irv_paths(prefs) if x[5]]
            if len({x[2] for x in last}) > 1:
                continue
            winner = last[0][2]
            got = outcome.raire(prefs, winner, 300)
            orders = [o for o in itertools.permutations(range(k)) if o[-1] != winner]
            if got:
                assert all(any(outcome.rules_out(a, o) for a in got) for o in orders)
                assert all(any(not any(outcome.rules_out(b, o) for b in got if b is not a) for o in orders) for a in got) or len(got) <= len(orders)
                assert not any(outcome.rules_out(a, tuple(x for x in order)) for a in got for order in actual_orders(prefs, winner))
    assert outcome.rules_out(("NEB", 1, 2, (), 0.1), (1, 2)) and outcome.rules_out(("NEB", 1, 2, (), 0.1), (2,)) and not outcome.rules_out(("NEB", 1, 2, (), 0.1), (2, 1))
    assert outcome.rules_out(("NEN", 1, 2, (1, 2, 3), 0.1), (1, 2, 3)) and not outcome.rules_out(("NEN", 1, 2, (1, 2, 3), 0.1), (1, 3))


def actual_orders(prefs, winner):
    """Every order in which candidates may really go (ties: any of the last)."""
    todo, out = [((), frozenset(c for p, _ in prefs for c in p))], []
    while todo:
        gone, standing = todo.pop()
        if len(standing) == 1:
            out.append((*gone, *standing))
            continue
        tally = dict.fromkeys(standing, 0)
        for p, n in prefs:
            top = next((c for c in p if c in standing), None)
            if top is not None:
                tally[top] += n
        low = min(tally.values())
        todo += [((*gone, c), standing - {c}) for c in standing if tally[c] == low]
    return [o for o in out if o[-1] == winner]


def test_seats_that_are_not_safe(spark):
    votes = {1: 10000, 2: 6000, 3: 1500, 4: 890}
    safe = outcome.seat_failures(votes, 8, 18500, 0.05, lambda ne: 0.0)
    assert safe == ({1: 5, 2: 3, 3: 0, 4: 0}, [])
    # only the closest pair fails: party 2's third seat (2000) against nobody, party 1's fifth (2000) against party 3's first (1500)
    gap = lambda a, d, b, e: 1 / (2 - ((votes[a] / d - votes[b] / e) * e / 18500) / ((e / d + 1) / 2))
    limit = gap(1, 5, 3, 1) + 1e-9
    reported, got = outcome.seat_failures(votes, 8, 18500, 0.05, lambda ne: 1.0 if 0.5 < ne <= limit else 0.0)
    assert (1, 5, 3, 1) in got and reported == {1: 5, 2: 3, 3: 0, 4: 0}
    pairs = [frozenset(((a, d), (b, e))) for a, d, b, e in got]
    assert len(set(pairs)) == len(pairs)
    df = spark.createDataFrame([(1, c, v) for c, v in votes.items()], "contest_id int, cand int, nvotes bigint")
    rows = risk.seat_failures(df, spark.createDataFrame([(1, 18500, 200)], "contest_id int, npop bigint, n bigint"), 8, 0.05).collect()
    assert {r.cand: r.reported for r in rows} == {1: 5, 2: 3, 3: 0, 4: 0}
    assert risk.seat_failures(df.limit(0), spark.createDataFrame([], "contest_id int, npop bigint, n bigint"), 8, 0.05).count() == 0


def test_fuzz_of_ranked_cards(spark):
    v = spark.createDataFrame([(i, 1, [1, 2, 3], True) for i in range(3000)] + [(i, 2, [5], False) for i in range(3000)] + [(9999, 3, [], True)], "card_key bigint, contest_id int, cands array<int>, ranked boolean")
    known = spark.createDataFrame([(1, c) for c in (1, 2, 3, 4)] + [(2, 5), (2, 6), (3, 1)], "contest_id int, cand int")
    got = simulate.fuzz(v, known, 0.5, 3).collect()
    kinds = {tuple(r.fuzzed) for r in got if r.contest_id == 1}
    assert {(1, 2, 3), (), (2, 1, 3), (1, 3, 2), (1, 2, 3, 4)} == kinds
    assert {tuple(r.fuzzed) for r in got if r.contest_id == 2} == {(5,), (6,), ()}
    changed = sum(r.fuzzed != r.cands for r in got if r.contest_id == 1)
    assert 1300 < changed < 1700


def test_made_up_elections(spark):
    spec = spark.createDataFrame([(1, 100, 3, 10, [(1, 50), (2, 37)]), (2, 0, 0, 0, []), (3, 5, 0, 0, [(1, 9)])], "contest_id int, ncards bigint, nphantoms bigint, nundervotes bigint, candidates array<struct<cand:int,nvotes:bigint>>")
    got = simulate.make_election(spec, 4).collect()
    n = lambda c, f: sum(r.contest_id == c and f(r) for r in got)
    assert (n(1, lambda r: r.cands == [1]), n(1, lambda r: r.cands == [2]), n(1, lambda r: not r.cands and not r.phantom), n(1, lambda r: r.phantom)) == (50, 37, 10, 3)
    assert n(2, bool) == 0 and n(3, lambda r: r.cands == [1]) == 5


def test_sample_from_a_prefix(spark, tmp_path):
    import random

    rng = random.Random(9)
    cards = spark.createDataFrame([(rng.randrange(2**63), i % 7 if i % 50 else 7) for i in range(8000)], "prn bigint, contest_id int")
    cards.repartitionByRange(6, "prn").sortWithinPartitions("prn").write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    sizes = stored.groupBy("contest_id").agg(F.count("*").alias("cards"))
    for n in (3, 40, 10_000):
        wanted = spark.createDataFrame([(c, n) for c in (0, 3, 7, 99)], "contest_id int, n bigint")
        for slack in (0.2, 1.5):
            got = {r.prn for r in draws.consistent_sample_prefix(stored, wanted, sizes, slack=slack).collect()}
            assert got == {r.prn for r in draws.consistent_sample(stored, wanted).collect()}
    plan = draws.consistent_sample_prefix(stored, spark.createDataFrame([(0, 3)], "contest_id int, n bigint"), sizes)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(prn," in plan


def test_county_pools_without_ids(spark, monkeypatch):
    from ballotlens.operators import prefix
    from ballotlens.sources import text_tables as T

    lines = [(1, "countyPoolId, countyName"), (2, "7, Adams, 300, 4 9, 1, 1, 1 2, 300, 5, 5, 0, 0, , 1:120, 2:175,"), (3, ",,,, 3, 2, 7, 290, 0, 1, 0, 2, , 7:9,"), (4, "8, Baca, 10, , 1, 1, 1, 10, 10, 10, 0, 0, , "), (5, ",,,, 2, 1, 1, 10, 0, 0, 0, 0, , 1:3")]
    df = spark.createDataFrame(lines, "line_no bigint, value string")
    for most in (2, 10**9):
        monkeypatch.setattr(prefix, "PER_BUCKET", most)
        got = {(r.pool_id, r.contest_id): (r.county, r.total_cards, r.styles, r.tally) for r in T.read_county_pools(df).collect()}
        assert got == {(7, 1): ("Adams", 300, [4, 9], {"1": 120, "2": 175}), (7, 3): ("Adams", 300, [4, 9], {"7": 9}), (8, 1): ("Baca", 10, None, {}), (8, 2): ("Baca", 10, None, {"1": 3})} or got[8, 1][2] == []
    assert T.unread(df.select("value").unionAll(spark.createDataFrame([("9, x",)], "value string")), "pools").count() == 1


def test_first_of_each_with_very_different_sizes(spark):
    rows = spark.createDataFrame([(g, (i * 7919) % 5003, i) for g in (1, 2, 3, 4) for i in range(1000)], "g int, o int, rank2 int")
    wanted = spark.createDataFrame([(1, 2), (2, 700), (3, 0), (9, 5)], "g int, n bigint")
    got = draws.first_of_each(rows, wanted, "g", ["o"]).collect()
    best = {g: sorted((i * 7919) % 5003 for i in range(1000)) for g in (1, 2)}
    assert sorted(r.o for r in got if r.g == 1) == best[1][:2] and sorted(r.o for r in got if r.g == 2) == best[2][:700] and len(got) == 702
    assert draws.first_of_each(rows, wanted.limit(0), "g", ["o"]).count() == 0
    plan = draws.first_of_each(rows, wanted, "g", ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4 and "BroadcastHashJoin" in plan
