import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotlens.operators.copies import assign, diff_copies, field_differences, name_text, number_text, pair_up

COLS = "k int, a string, b string, __c string, side string"
FIELDS = {"a": F.col("a"), "b": F.col("b")} if False else None


def fields():
    return {"a": number_text(F.col("a")), "b": name_text(F.col("b"))}


def diff(spark, left, right, **kw):
    df = lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], COLS)
    return diff_copies(df(left), df(right), ["k"], fields(), **kw)


def test_assign_is_least():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 5))
        m = int(rng.integers(n, 6))
        c = rng.integers(0, 4, (n, m)).astype(float)
        got = assign(c)
        assert len(set(got)) == n
        assert sum(c[i, got[i]] for i in range(n)) == min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def test_pair_up_empty():
    assert pair_up([], [("x",)]) == ([], [], [0])


def test_differences(spark):
    left = [(1, "1,000", "Ann\t"), (2, "5", "Bo"), (3, "N/A", None), (4, "7", "C"), (4, "7", "C"), (None, "1", "x"), (6, " 2 ", "q")]
    right = [(1, "1000", " Ann"), (2, "6", "bo"), (3, None, ""), (4, "7", "C"), (5, "1", "new"), (None, "2", "x"), (6, "2.0", "q")]
    got = {(r.k, r.difference) for r in field_differences(diff(spark, left, right), ["k"], ["a", "b"], "no_left", "no_right").collect()}
    assert got == {(2, "a"), (2, "b"), (3, "b"), (5, "no_left"), (None, "a")}


def test_pairs_cost_least_within_key(spark):
    left = [(1, "1", "x"), (1, "2", "y"), (1, "3", "z"), (1, "3", "z")]
    right = [(1, "2", "x2"), (1, "9", "z"), (1, "1", "y"), (1, "3", "z")]
    out = diff(spark, left, right).collect()
    cost = sum((r.l.a != r.r.a) + (r.l.b != r.r.b) for r in out if r.l and r.r)
    assert len(out) == 3 and cost == min(sum((x[1] != y[1]) + (x[2] != y[2]) for x, y in zip(left[:3], p)) for p in itertools.permutations(right[:3]))


def test_large_key_is_paired_without_gathering(spark):
    left = [(1, str(i), f"n{i % 7}") for i in range(150)] + [(1, "5", "n5")] * 3
    right = [(1, str(i + 30), f"n{i % 7}") for i in range(160)]
    out = diff(spark, left, right, max_group=10)
    r = out.agg(F.sum(F.when(F.col("l").isNotNull(), F.col("n"))).alias("l"), F.sum(F.when(F.col("r").isNotNull(), F.col("n"))).alias("r"), F.sum(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.col("n"))).alias("both")).first()
    same = len({x[1:] for x in left} & {x[1:] for x in right})
    assert (r.l, r.r) == (153 - same, 160 - same) and r.both == min(r.l, r.r)


@pytest.mark.parametrize("sides", [([], []), ([(1, "1", "x")], []), ([], [(1, "1", "x")])])
def test_empty_sides(spark, sides):
    assert diff(spark, *sides).count() == len(sides[0]) + len(sides[1])


def test_equal_copies_give_nothing(spark):
    rows = [(i % 5, str(i), "n") for i in range(50)] + [(None, None, None)]
    assert diff(spark, rows, rows).count() == 0


def test_large_key_costs_least(spark):
    fields = {c: F.col(c) for c in ("a", "b", "c")}
    df = lambda rows: spark.createDataFrame(rows, "k int, a string, b string, c string")
    rng = np.random.default_rng(4)
    draw = lambda k: [(k, *(str(v) if v else None for v in rng.integers(0, 3, 3))) for _ in range(int(rng.integers(3, 7)))]
    left, right = [(0, "1", "1", "a"), (0, "3", "1", "b")], [(0, "1", "1", "b"), (0, "1", "2", "a")]
    for k in range(1, 40):
        left, right = left + draw(k), right + draw(k)
    out = diff_copies(df(left), df(right), ["k"], fields, max_group=1).collect()
    for k in range(40):
        a, b = [x[1:] for x in left if x[0] == k], [x[1:] for x in right if x[0] == k]
        for x in list(a):
            if x in b:
                a.remove(x), b.remove(x)
        a, b = sorted((a, b), key=len)
        differ = lambda x, y: sum(p != q for p, q in zip(x, y))
        least = min(sum(map(differ, a, p)) for p in itertools.permutations(b, len(a)))
        mine = [r for r in out if r.k == k]
        assert sum(r.n * differ(r.l, r.r) for r in mine if r.l and r.r) == least
        assert sum(r.n for r in mine if r.l and r.r) == len(a) and sum(r.n for r in mine) == len(b)
    assert {c for r in out if r.k == 0 for c in "abc" if r.l[c] != r.r[c]} == {"a", "b"}
