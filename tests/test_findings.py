"""Findings of a review, each with a small case that failed before."""

from ballotlens.plans import ballots

CVR = "cvr_key bigint, county_id int, id string, counting_group int, ballot_style_id int, precinct_portion_id int, votes map<int,array<int>>"
CONTEST = "contest_id int, county_id int, vote_for int, num_of_ranks int, description string"


def folder(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_ranked_contest_without_assertions(spark, tmp_path):
    votes = [{1: [11, 12]}] * 5 + [{1: [12]}] * 2 + [{2: [21]}] * 3 + [{2: [22]}] * 3 + [{3: []}]  # contest 2 is tied, 3 has blank ballots only
    d = folder(spark, tmp_path, cvr_export=([(i, 1, str(i), 1, 1, 1, v) for i, v in enumerate(votes)], CVR), contest_manifest=([(c, 1, 1, 3, "c") for c in (1, 2, 3)], CONTEST))
    got = ballots.QUERIES["assert_raire"](spark, d)
    assert dict(got.dtypes)["contest_id"] == "int"
    assert [(r.contest_id, r.kind, r.winner, r.loser, r.standing, round(r.margin, 9)) for r in got.collect()] == [(1, "NEB", 11, 12, "", round(3 / 7, 9))]


CARD = "card_key bigint, county_id int, id string, bin_location string, card_index int, prn string, phantom string, style_id int, pool_id int, added_at timestamp, votes map<int,array<int>>"


def card(key, votes, style=1, pool=None, prn=None):
    return (key, 1, str(key), None, key, prn, "no", style, pool, None, votes)


def test_pool_undervotes_do_not_widen_cards(spark, tmp_path):
    votes = [{1: [5], 2: []}, {3: []}, {}, None]
    d = folder(spark, tmp_path, card_manifest=([card(i, v, pool=7) for i, v in enumerate(votes)] + [card(9, {4: [1]}), card(10, {}, pool=8)], CARD))
    got = ballots.QUERIES["add_pool_undervotes"](spark, d)
    assert {tuple(r) for r in got.collect()} == {(0, 3, 1), (1, 3, 2), (2, 3, 3), (3, 3, 0)}  # as in SQL: the last card's votes are unknown
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "map_concat" not in plan and "collect_set" not in plan


def test_classes_draw_what_all_cards_and_contests_draw(spark):
    from pyspark.sql import functions as F

    from ballotlens.operators import draws

    cards = spark.createDataFrame([((i * 37) % 90, (None, 1, 2, 3)[i % 4] if i % 5 else 3) for i in range(120)], "prn bigint, style_id int")  # some prns twice, of several styles
    held = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 11), (3, 12), (4, 13), (None, 14)], "style_id int, contest_id int")
    wanted = spark.createDataFrame([(10, 3), (11, 40), (12, 500), (13, 2), (14, 2)], "contest_id int, n bigint")
    rows = lambda df: sorted(tuple(r) for r in df.select("prn", "contest_id", "rank", "n").collect())
    cc = cards.join(held, "style_id").select("prn", "contest_id").distinct()
    classes, contests = draws.card_classes(cards, held)
    assert rows(classes.join(contests, "class").select("prn", "contest_id", F.lit(0).alias("rank"), F.lit(0).alias("n"))) == sorted((r.prn, r.contest_id, 0, 0) for r in cc.collect())
    assert rows(draws.first_in_classes(classes, contests, wanted)) == rows(draws.first_of_each(cc, wanted, "contest_id", ["prn"]))


def test_samples_in_use_without_all_cards_and_contests(spark, tmp_path, monkeypatch):
    from ballotlens.operators import draws
    from ballotlens.plans import audits

    seen, ranked = [], draws.first_of_each
    monkeypatch.setattr(draws, "first_of_each", lambda rows, *a: seen.append(rows.count()) or ranked(rows, *a))

    votes = lambda s: {c: [] for c in range(100 * s, 100 * s + 60)}
    d = folder(spark, tmp_path, card_manifest=([card(i, votes(1 + i % 2), 1 + i % 2, prn=f"{i + 1:x}") for i in range(200)], CARD))
    df = audits.QUERIES["mvrs_used"](spark, d)
    assert {r.prn: r.used for r in df.collect()} == {p: p <= 26 for p in range(1, 53)}  # of each style 26 are drawn, and 13 used
    assert max(seen) <= 52 * 60  # not 200 cards beside 60 contests


def test_round_samples_by_class_without_all_cards_and_contests(spark, monkeypatch):
    from ballotlens.operators import draws, rounds

    monkeypatch.setattr(draws, "PER_RANGE", 4)
    cards = spark.createDataFrame([((i * 37) % 90 << 56 if i % 3 else i, (None, 1, 2, 3)[i % 4] if i % 5 else 3) for i in range(120)], "prn bigint, style_id int")
    held = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 11), (3, 12), (4, 13)], "style_id int, contest_id int")
    cc = cards.join(held, "style_id").select("prn", "contest_id").distinct()
    sizes = cc.groupBy("contest_id").count().withColumnRenamed("count", "cards")
    classes, contests = draws.card_classes(cards, held)
    for sizes_wanted in ([(10, 3), (11, 20), (12, 1)], [(10, 500), (11, 5), (12, 0)], [(11, 33), (13, 2)]):
        wanted = spark.createDataFrame(sizes_wanted, "contest_id int, n bigint")
        got = [r.prn for r in draws.consistent_sample_in_classes(classes, contests, wanted, sizes).collect()]
        assert sorted(got) == sorted(r.prn for r in draws.consistent_sample(cc, wanted).collect())

    names = []
    keep = rounds.written
    monkeypatch.setattr(rounds, "written", lambda df, name, *a: names.append((name, df.count())) or keep(df, name, *a))
    many = spark.range(60).selectExpr("1 as style_id", "cast(id + 1 as int) as contest_id")
    a = spark.createDataFrame([(1, 1, 2, 500, 1 / (2 - 0.3))], "contest_id int, winner int, loser int, npop bigint, noerror double")
    seen = spark.range(500).selectExpr("id as prn", "1 as contest_id", "1 as winner", "2 as loser", f"{1 / (2 - 0.3)}D as value", f"{1 / (2 - 0.3)}D as noerror", "500L as npop")
    got = rounds.run_rounds(seen, (spark.range(500).selectExpr("id as prn", "1 as style_id"), many), a, 0.05).collect()
    assert got[-1].done and max(n for _, n in names) == 500  # not 500 cards beside 60 contests


def test_batch_headings_are_taken_apart_once_a_file(spark):
    from ballotlens.sources import text_tables as T

    lines = spark.createDataFrame([("f", 1, 'Batch,"Judge, East - Cy",,Mayor - Al-B'), ("f", 2, "Box 1,3,9,0,7"), ("f", 3, "Box 2,4"), ("g", 1, "Batch,Mayor - Di"), ("g", 2, "Box 1,5,6")], "file_name string, line_no int, value string")
    df = T.read_batch_totals(lines)
    want = {("f", "Box 1", "Judge East", "Cy", 3), ("f", "Box 1", "Mayor - Al", "B", 0), ("f", "Box 2", "Judge East", "Cy", 4), ("g", "Box 1", "Mayor", "Di", 5)}
    assert {tuple(r) for r in df.collect()} == want and df.count() == 4
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "([^-]*)$" in plan and "([^-]*)$" not in plan[: plan.index("Join ")]  # above the join there are cells


def test_batch_below_zero_is_not_the_header(spark, tmp_path):
    from ballotlens.plans import files

    d = folder(spark, tmp_path, cvr_export=([(1, 4, "1", 1, 1, -1, {5: [1]}), (2, 4, "2", 1, 1, -1, {5: [2]}), (3, 4, "3", 1, 1, 7, {5: [3]}), (4, 4, "4", 1, 1, None, {5: [3]}), (5, 4, "5", 1, 1, 8, {5: [2]})], CVR))
    got = {(r.pool, r.choice, r.nballots, r.votes) for r in files.QUERIES["ga_case"](spark, d).collect()}
    assert got == {("county_4/Batch -1", "Cand 2", 2, 1), ("county_4/Batch 8", "Cand 2", 1, 1), ("county_4/Batch 7", "Cand 3", 1, 1), ("county_4/Batch 0", "Cand 3", 1, 1)}
