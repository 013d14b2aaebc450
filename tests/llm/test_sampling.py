import datetime as dt

from pyspark.sql import functions as F

from ballotlens.llm.sampling import audit_samples, golden_point, golden_sample, prn_number

T0 = dt.datetime(2031, 1, 1)
day = lambda n: T0 + dt.timedelta(days=n)
CARDS, ROUNDS = "county_id int, card_key bigint, prn string, added_at timestamp_ntz, number int, rank int", "county_id int, round_idx int, drawn_at timestamp_ntz, wanted int, sample_prns array<string>, need int"


def run(spark, cards, rounds):
    c = spark.createDataFrame([(*x, 0, 0) for x in cards], CARDS)
    r = spark.createDataFrame([(*x, 0) for x in rounds], ROUNDS)
    return {(x.county_id, x.round_idx, x.card_key) for x in audit_samples(c.repartition(3), r).collect()}


def test_numbers(spark):
    given = ["ff", "0xFF", "00fF", " ff ", "0", "7fffffffffffffff", "8000000000000000", "xyz", "", None, "0x"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, p string")
    assert [r.n for r in df.select("i", prn_number(F.col("p")).alias("n")).orderBy("i").collect()] == [255, 255, 255, 255, 0, 2**63 - 1, None, None, None, None, None]


def test_rounds(spark):
    cards = [(1, k, hex(100 - k) if k % 2 else f"{100 - k:04X}", day(0)) for k in range(1, 11)] + [(1, 20, "1", day(9)), (1, 21, None, day(0)), (1, 22, "2", None), (1, 3, "0061", day(1)), (2, 50, "5", day(0))]
    rounds = [(1, 1, day(1), 2, ["0x62", "63"]), (1, 2, day(5), 4, None), (1, 3, day(10), 6, None), (2, 1, day(1), 1, ["9"]), (2, 2, day(1), 5, None), (1, 2, day(5), 4, None)]
    got = run(spark, cards, rounds)
    assert {k for c, r, k in got if (c, r) == (1, 1)} == {1, 2}
    assert {k for c, r, k in got if (c, r) == (1, 2)} == {1, 2, 10, 9}
    assert {k for c, r, k in got if (c, r) == (1, 3)} == {1, 2, 10, 9, 20, 8}
    assert {(r, k) for c, r, k in got if c == 2} == {(2, 50)}


def test_nothing_drops_out_when_cards_arrive(spark):
    cards = [(1, k, hex(k * 7919 % 1009 + 1), day(k % 6)) for k in range(200)]
    rounds = [(1, 1, day(2), 5, [hex(k * 7919 % 1009 + 1) for k in range(5)]), (1, 2, day(3), 20, None), (1, 3, day(6), 60, None)]
    got = run(spark, cards, rounds)
    by = {r: {k for _, x, k in got if x == r} for r in (1, 2, 3)}
    assert by[1] < by[2] < by[3] and [len(by[r]) for r in (1, 2, 3)] == [5, 20, 60]
    assert run(spark, cards + [(1, 500 + k, hex(k + 2000), day(20)) for k in range(50)], rounds) == got


def test_a_skipped_round(spark):
    cards = [(c, k, hex(k), day(0)) for c in (1, 2) for k in range(1, 9)]
    rounds = [(1, 1, day(1), 2, ["8", "7"]), (1, 3, day(1), 3, None), (2, 1, day(1), 1, ["5"]), (2, 2, day(1), 2, None), (2, 3, day(1), 2, None)]
    got = run(spark, cards, rounds)
    assert {k for c, r, k in got if (c, r) == (1, 3)} == {8, 7, 1} and not any((c, r) == (1, 2) for c, r, _ in got)
    assert {k for c, r, k in got if (c, r) == (2, 3)} == {5, 1}


def test_empty(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [], [(1, 1, day(1), 3, ["a"])]) == set()
    assert run(spark, [(1, 1, "a", day(0))], [(1, 1, day(1), 3, None)]) == {(1, 1, 1)}


def test_golden_is_even_and_grows(spark):
    df = spark.range(20_000).withColumn("county_id", F.lit(1))
    small, big = ({r.id for r in golden_sample(df.where(F.col("id") < n).repartition(5), "id", 0.05, 77).collect()} for n in (8_000, 20_000))
    assert small == {i for i in big if i < 8_000}
    for begin in range(0, 19_000, 1_000):
        assert abs(sum(begin <= i < begin + 1_000 for i in big) - 50) <= 4
    assert golden_sample(spark.createDataFrame([(None,)], "id bigint"), "id", 0.5, 1).count() == 0
    assert df.select(golden_point(F.col("id"), 5).alias("p")).where("p < 0 or p >= 2147483648").count() == 0


def test_golden_with_gaps(spark):
    import random

    rng = random.Random(2)
    kept = [i for i in range(40_000) if rng.random() < 0.3]
    df = spark.createDataFrame([(i,) for i in kept], "id bigint")
    n = golden_sample(df, "id", 0.05, 77).count()
    assert abs(n - 0.05 * len(kept)) < 0.1 * 0.05 * len(kept)


def test_one_whole_copy_of_a_round(spark):
    cards = [(1, k, hex(k), day(0)) for k in range(1, 9)]
    # the copy with the stored sample counts, not its fields mixed with the other's
    assert run(spark, cards, [(1, 1, day(1), 1, ["3"]), (1, 1, day(2), 5, None)]) == {(1, 1, 3)}
