import json
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ballotlens.sources import records
from ballotlens.sources import text_tables as T
from ballotlens.sources import vendor

CARD = "id string, location string, card_index int, prn bigint, phantom boolean, style_id int, pool_id int, votes map<int,array<int>>"
CARDS = [("a-1", "bin 1", 0, 2**62 + 5, False, 3, None, {1: [2], 5: []}), ("a-2", "a-2", 1, None, True, None, 7, {}), ("a-3", "x", 2, 255, False, -1, 7, {9: [4, 1, 3]})]


def test_cards_round_trip(spark):
    df = spark.createDataFrame(CARDS, CARD)
    back = sorted(tuple(r) for r in T.read_cards(T.write_cards(df)).collect())
    assert back == sorted(CARDS)
    lines = spark.createDataFrame([("id, location, index, prn, phantom, style, pool, contests",), ("",), ("regular-7302, , 37053, 78de9cddb226, , -1, , 1, 1,",), ("p, , 5, ff, yes, 2, , ,",)], "value string")
    got = {r.id: r for r in T.read_cards(lines).collect()}
    assert got["regular-7302"].votes == {1: [1]} and got["regular-7302"].location == "regular-7302" and got["p"].phantom and got["p"].votes == {}


def test_cvrs_round_trip(spark):
    df = spark.createDataFrame([("1-2-3", 2, 5, None, {3: [1], 8: []}), ("1-2-4", 1, None, 6, {})], "id string, counting_group int, style_id int, precinct int, votes map<int,array<int>>")
    assert sorted(map(tuple, T.read_cvrs(T.write_cvrs(df)).collect())) == sorted(map(tuple, df.collect()))


def test_pools_with_continuation_lines(spark):
    lines = [(0, "poolId, poolName, hasExactContests"), (1, "42, north, true, 300, 0, 1, 1 2, 300, 5, 5, 0, 0, , 1:120, 2:175,"), (2, ",,,, 3, 2, 7, 290, 0, 1, 0, 2, , 7:9,"), (3, "43, south, false, 10, 0, 1, 1, 10, 10, 10, 0, 0, , ")]
    got = {(r.pool_id, r.contest_id): r for r in T.read_pools(spark.createDataFrame(lines, "line_no int, value string")).collect()}
    assert got[42, 3].pool_name == "north" and got[42, 3].total_cards == 300 and got[42, 0].tally == {"1": 120, "2": 175} and got[43, 0].tally == {} and not got[43, 0].has_exact and got[42, 3].nphantoms == 2


def test_ranked_ballots(spark):
    lines = spark.createDataFrame([("1",), ("Contest,339,4,15,16,17,18,winner,16",), ("339,99813_1,16,15",), ("339,7,17",), ("339,8,",)], "value string")
    assert [(r.ballot_id, r.prefs) for r in T.read_ranked(lines).orderBy("ballot_id").collect()] == [(7, [17]), (8, [])]


def test_named_files(spark, tmp_path):
    (tmp_path / "sov.csv").write_text('Precinct Code,Contest Title,Choice Name,Active Voters,Total Ballots,Total Votes,Round 1 Undervotes,Overvotes\n1,Mayor,"Ann, B","1,569",N/A,7,1,0\n')
    r = T.read_named(spark, str(tmp_path / "sov.csv"), T.STATEMENT_OF_VOTES).collect()[0]
    assert (r.contest_title, r.choice_name, r.active_voters, r.total_ballots, r.total_votes, r.total_undervotes, r.precinct_number) == ("Mayor", "Ann, B", 1569, -1, 7, 1, None)
    (tmp_path / "round.csv").write_text("contest_name,winners_allowed,ballot_card_count,min_margin,risk_limit,gamma\nMayor,1,100,5,0.03,1.03905\n")
    r = T.read_named(spark, str(tmp_path / "round.csv"), T.ROUND_CONTEST, "ISO-8859-1").collect()[0]
    assert (r.min_margin, r.risk_limit, r.estimated_samples) == (5, 0.03, None)
    (tmp_path / "canon.csv").write_text('CountyName,ContestName,ContestChoices\nA,Mayor,"Ann, Bo,Cy"\n')
    assert {r.choice for r in T.canonical_choices(T.read_named(spark, str(tmp_path / "canon.csv"), T.CANONICAL_LIST)).collect()} == {"Ann", "Bo", "Cy"}


def test_unpivot(spark):
    df = spark.createDataFrame([("b1", "1,200", "3", "x")], ["batch", "Governor - Ann B - C", "Governor - Cy", "note"])
    assert {tuple(r) for r in T.unpivot_candidates(df, ["batch"]).collect()} == {("b1", "Governor - Ann B", "C", 1200), ("b1", "Governor", "Cy", 3)}


HEAD = ["Test,5.10", ',,,,"Mayor (Vote For=1)","Mayor (Vote For=1)","Mayor (Vote For=1)","Rank (Number of positions=1, Number of ranks=2)","Rank (Number of positions=1, Number of ranks=2)","Rank (Number of positions=1, Number of ranks=2)","Rank (Number of positions=1, Number of ranks=2)"', ",,,,Ann,Bo,Write-in,P(1),Q(1),P(2),Q(2)", "CvrNumber,TabulatorNum,ImprintedId,BallotType,,,,,,,"]


def test_wide_export(spark):
    schema = vendor.WideSchema(HEAD)
    assert schema.heads == ["CvrNumber", "TabulatorNum", "ImprintedId", "BallotType"] and schema.contests[1]["choices"] == ["P", "Q"]
    body = ["1,2,a,t,1,0,0,0,1,1,0", '="2",="2",b,"t ""x""",0,0,1,,,,', "3,2,c,t,,,,0,0,0,0", "Redacted and summed,,,t,5,7,0,,,,", "RCV Redacted,,,t,,,,1,0,0,1", ",,,u,1,0,0,,,,", "4,2,d,t, x ,X,X,,,,", "5,2,e,t,*,*,*,,,,"]
    lines = spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(HEAD + body)] + [("short", 1, "x")], "file_name string, line_no int, value string")
    meaning = vendor.wide_meaning(lines)
    rows = vendor.wide_rows(lines, meaning)
    assert [r.why for r in rows.orderBy("line_no").collect()] == [None, None, None, "Redacted", "RCV Redacted", "empty", "x", "*"]
    second = rows.where("line_no = 6").collect()[0]
    assert (second.cvr_number, second.tabulator, second.ballot_type, second.precinct) == ("2", "2", 't "x"', None)
    got = {(r.line_no, r.contest): r.cands for r in vendor.wide_votes(rows, ["line_no"]).collect()}
    assert got == {(5, 1): [1], (5, 2): [2, 1], (6, 1): [], (7, 2): [], (9, 2): [1, 2]}
    groups = {(r.ballot_type, r.cand): r.nvotes for r in vendor.redacted_groups(rows, ["ballot_type"]).where("nvotes > 0").collect()}
    assert groups == {("t", 1): 5, ("t", 2): 7, ("u", 1): 1}
    names = {r.contest: (r.name, r.vote_for, r.ranks) for r in vendor.contest_names(meaning).collect()}
    assert names == {1: ("Mayor", 1, 0), 2: ("Rank", 1, 2)}


def test_boxes_layout(spark):
    lines = [',,,,,,,,"Mayor (Vote For=2)","Mayor (Vote For=2)"', "RowNumber,Tabulator,BoxID,BoxPosition,BallotID,CG,PrecinctID,BallotStyleID,Ann,Write-in", "1,,VBM-1,7,VBM-1+7,All,17,3,1,1"]
    df = spark.createDataFrame([("g", i + 1, v) for i, v in enumerate(lines)], "file_name string, line_no int, value string")
    rows = vendor.wide_rows(df, vendor.wide_meaning(df, vendor.BOXES), vendor.BOXES)
    r = rows.collect()[0]
    assert (r.cvr_number, r.batch_id, r.record_id, r.ballot_type, r.tabulator) == ("1", "VBM-1", "7", "3", None)
    assert [(r.contest, r.cands) for r in vendor.wide_votes(rows, []).collect()] == [(1, [1])]


def test_leading_equals(spark):
    assert [r.x for r in spark.createDataFrame([('="5"',), ("a=b",), (None,)], "c string").select(vendor.leading_equals(F.col("c")).alias("x")).collect()] == ["5", "a=b", None]


def test_batches(spark):
    lines = [(1, 'Batch,"Governor - Ann B-C","Judge, East - Cy",'), (2, '"Box, 1","1,200",3,'), (3, "Box 2,,x,")]
    got = {tuple(r) for r in T.read_batch_totals(spark.createDataFrame([("f", n, v) for n, v in lines], "file_name string, line_no int, value string")).select("batch", "contest", "choice", "votes").collect()}
    assert got == {("Box 1", "Governor - Ann B", "C", 1200), ("Box 1", "Judge East", "Cy", 3), ("Box 2", "Judge East", "Cy", None)}
    m = T.read_batch_manifest(spark.createDataFrame([("f", 'mail,"Box, 1", 40'), ("f", ",,")], "file_name string, value string")).collect()
    assert [(r.batch, r.kind, r.nballots) for r in m] == [("Box 1", "mail", 40)]


def test_zip_of_many_parts(spark, tmp_path):
    df = spark.range(1000).selectExpr("cast(id as string) as value").repartition(3)
    records.write_zip(df, str(tmp_path / "z"), "lines.csv", most=100)
    back = records.unzip_lines(spark, str(tmp_path / "z") + "/*.zip")
    assert {r.value for r in back.collect()} == {str(i) for i in range(1000)} and len(list((tmp_path / "z").glob("*.zip"))) >= 10
    records.write_zip(df.limit(0), str(tmp_path / "none"), "x.csv")


def test_records(spark, tmp_path):
    df = spark.createDataFrame(CARDS, CARD)
    folder = str(tmp_path / "record")
    records.commit(df, folder, "cards")
    with pytest.raises(AnalysisException):
        records.commit(df, folder, "cards")
    with pytest.raises(ValueError):
        records.commit(df, folder, "other")
    records.commit_round(df.select("id"), folder, "sample", 1)
    records.commit_round(df.select("id"), folder, "sample", 2)
    assert records.read_record(spark, folder, "sample").groupBy("round").count().count() == 2


def test_json_zip_xml(spark, tmp_path):
    (tmp_path / "styles.json").write_text(json.dumps({"batches": [{"name": "12-A.b", "id": 4, "possibleContests": [1, 2], "hasExactContests": True, "ncards": 9}]}))
    assert records.read_styles(spark, str(tmp_path / "styles.json")).collect()[0].pool_name == "12"
    (tmp_path / "prns.json").write_text(json.dumps({"samplePrns": ["ff", "10"]}))
    assert [tuple(r) for r in records.read_sample_prns(spark, str(tmp_path / "prns.json")).collect()] == [(0, 255), (1, 16)]
    with zipfile.ZipFile(tmp_path / "cards.zip", "w") as z:
        z.writestr("cards.csv", "\n".join(r.value for r in T.write_cards(spark.createDataFrame(CARDS, CARD)).collect()))
    assert T.read_cards(records.unzip_lines(spark, str(tmp_path / "cards.zip"))).count() == 3
    (tmp_path / "s.xml").write_text('<summary><contest id="3" ballotsCast="10" undervotes="1" overvotes="0" blanks="2"/></summary>')
    assert tuple(records.read_summary_xml(spark, str(tmp_path / "s.xml")).collect()[0]) == (3, 10, 1, 0, 2)
    (tmp_path / "p.json").write_text(json.dumps({"name": "North", "lists": [{"party": "A", "votes": 5, "seats": 1}]}))
    assert tuple(records.read_party_lists(spark, str(tmp_path / "p.json")).collect()[0]) == ("North", "A", 5, 1)


def test_session_ids(spark):
    df = spark.createDataFrame([(1, "2", "3", "a/Images/9_000007*.*"), (1, "2", "X", "D:\\\\r\\\\Images\\\\00001_000007*.*"), (1, "2", "X", "scans/00012/00001_000001*.*"), (1, None, "X", None)], "t int, b string, r string, m string")
    got = [x.i for x in df.select(vendor.session_id(F.col("t"), F.col("b"), F.col("r"), F.col("m")).alias("i")).collect()]
    assert got[0] == "1-2-3" and got[1].startswith("1-2-") and got[1].endswith("00001_000007") and got[2] == "1-2-00012/00001_000001" and got[3] == "1"
