import json

from ballotlens.operators.nested import as_bool, as_int, flatten_sessions

SCHEMA = "session_id bigint, county_id int, payload string, row_key string, tag string"


def mark(c, r=1, v=True, **more):
    return {"CandidateId": c, "Rank": r, "IsVote": v, **more}


def rows(spark, payloads):
    df = spark.createDataFrame([(i + 1, 7, p if p is None or isinstance(p, str) else json.dumps(p), "clash", "clash") for i, p in enumerate(payloads)], SCHEMA)
    return flatten_sessions(df)


def test_leaves():
    assert [as_int(x) for x in (7, "7", " 7 ", 7.0, "7.0", "x", None, True, "", 1e30)] == [7, 7, 7, 7, 7, None, None, None, None, None]
    assert [as_bool(x) for x in (True, "TRUE", 1, "1", "no", 0, "maybe", None)] == [True, True, True, True, False, False, None, None]


def test_levels_states_and_parents(spark):
    a = {"TabulatorId": 1, "Original": {"BallotTypeId": "3", "IsCurrent": True, "Cards": [{"Id": 1, "Contests": [{"Id": 10, "Marks": [mark(1), None, mark("2", None, "false")]}, {"Id": 11, "Marks": None}]}, None, {"Id": 2, "Contests": []}]}}
    b = {"Original": {"IsCurrent": False, "Contests": [{"Id": 9, "Marks": [mark(5)]}]}, "Modified": {"IsCurrent": "true", "BallotTypeId": None, "Contests": {"Id": "12", "Marks": mark(None)}}}
    c = {"Original": {"Cards": [{"Contests": [{"Id": 1, "Marks": []}]}]}, "Modified": {"IsCurrent": False, "Cards": []}}
    flat = rows(spark, [a, b, c, a])
    marks = {(r.session_id, r.card_no, r.contest_id, r.mark_no, r.candidate_id, r.mark_rank, r.is_vote, r.ballot_style_id) for r in flat["mark"].collect()}
    assert (1, 1, 10, 1, 1, 1, True, 3) in marks
    assert (1, 1, 10, 3, 2, None, False, 3) in marks  # the null mark keeps its place
    assert (2, 1, 12, 1, None, 1, True, None) in marks and not any(m[2] == 9 for m in marks)
    assert {(r.session_id, r.card_no) for r in flat["card"].collect() if r.session_id == 1} == {(1, 1), (1, 3)}
    keys = {t: {r.row_key for r in flat[t].collect()} for t in ("session", "card", "contest", "mark")}
    for child, parent in (("card", "session"), ("contest", "card"), ("mark", "contest")):
        assert {r.parent_key for r in flat[child].collect()} <= keys[parent]


def test_rejects_and_empty(spark):
    flat = rows(spark, [None, "{bad", "[1]", {}, {"Original": None}, ""])
    assert sorted(r.reason for r in flat["reject"].collect()) == ["no JSON", "no JSON", "no object", "no state", "no state", "null"]
    assert flat["mark"].count() == 0
    odd = rows(spark, [{"Original": {"Contests": [{"Id": 1, "Marks": [mark("x"), mark(2**40), mark(5, 2**40), mark("", "")]}]}}])
    assert sorted((r.row_key, r.reason) for r in odd["reject"].collect()) == [("1/1/1/1", "unreadable CandidateId"), ("1/1/1/3", "unreadable Rank")]
    assert sorted((r.mark_no, r.candidate_id, r.mark_rank) for r in odd["mark"].collect()) == [(1, None, 1), (2, 2**40, 1), (3, 5, None), (4, None, None)]
    empty = flatten_sessions(spark.createDataFrame([], SCHEMA))
    assert empty["mark"].count() == 0 and "candidate_id" in empty["mark"].columns


def test_one_session_with_very_many_marks(spark):
    big = {"Original": {"Contests": [{"Id": 1, "Marks": [mark(i) for i in range(20_000)]}]}}
    assert rows(spark, [big])["mark"].count() == 20_000
