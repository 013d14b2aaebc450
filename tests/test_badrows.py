import pytest

from ballotlens.functions.csvline import cells
from ballotlens.operators.badrows import bad_lines, diagnose, load_lines

HEADER = "CvrNumber,TabulatorNum,BatchId,RecordId,ImprintedId,PrecinctPortion,BallotType,C1:A"
H = HEADER.split(",")
CASES = [
    ('1,2,3,4,2-3-4,p,Type,0', ""), ('1,2,3,4,2-3-4,,Type,\r', ""), ('="1","2",3,4,="2-3-4","p, q","a ""b""",1', ""), (" 1 , 2 ,3,4,2-3-4 ,p,Type,", ""), ("0007,2,3,4,2-3-4,p,Type,0", ""),
    ("0,2,3,4,2-3-4,p,Type,0", "value"), ("-1,2,3,4,2-3-4,p,Type,0", "value"), ("1e3,2,3,4,2-3-4,p,Type,0", "value"), ("1,2,3,4,2-3-5,p,Type,0", "value"), ("1,2,3,4,2-3-4,p, ,0", "value"), (",2,3,4,2-3-4,p,T,0", "value"),
    ("1,2,3,4,2-3-4,p,Type", "columns"), ("1,2,3,4,2-3-4,p,Type,0,0", "columns"), ("", "columns"), ("1;2", "columns"), (None, "columns"),
    ('1,2,3,4,2-3-4,"p"x,Type,0', "quoting"), ('1,2,3,4,2-3-4,"p,Type,0', "quoting"), ('1,2,3,4,2-3-4,p,Type "6" old,0', "quoting"), ('1,"a', "quoting"), ('1,2,3,4,2-3-4, "p",T,0', "quoting"), ('1,2,3,4,2-3-4,"a,=""b",T,0', ""),
]


@pytest.mark.parametrize("line,reason", CASES)
def test_reason(line, reason):
    assert diagnose(line, H)[0] == reason


def test_cells():
    assert cells('a,"b ""c"", d",="e",') == ["a", 'b "c", d', "e", ""]
    assert cells("") == [""] and cells('""') == [""] and cells('"') is None


def test_bulk_equals_strict(spark):
    lines = [(i, "f", i + 2, c[0], "extra") for i, c in enumerate(CASES * 7)] + [(10_000 + i, "f", 0, "1,2,3,4,2-3-4,p,Type,0", "") for i in range(500)] + [(99_999, "unknown", 1, "1", "")]
    df = spark.createDataFrame(lines, "line_id bigint, file_name string, line_no int, line string, header_line string").drop("header_line")
    files = spark.createDataFrame([("f", HEADER, 1), ("f", HEADER, 1)], "file_name string, header_line string, line int")
    loaded = load_lines(df.repartition(3), files, block=64)
    assert {(r.line_id, r.reason) for r in bad_lines(loaded).collect()} == {(i, c[1]) for i, c in enumerate(CASES * 7) if c[1]} | {(99_999, "columns")}
    good = loaded.where("reason is null").collect()
    assert len(good) == len([c for c in CASES * 7 if not c[1]]) + 500 and all(r.cvr_number >= 1 and len(r.cells) == 8 for r in good)
    assert {r.cells[5] for r in good if r.line_id < 154 and CASES[r.line_id % len(CASES)][0].startswith('="1"')} == {"p, q"}


def test_long_numbers_and_only_bad(spark):
    given = ["9223372036854775807", "9223372036854775808", "1" * 40, "0" * 30 + "5"]
    lines = [(i, "f", i, f"{n},2,3,4,2-3-4,p,T,0") for i, n in enumerate(given)] + [(9, "f", 9, "x")]
    df = spark.createDataFrame(lines, "line_id bigint, file_name string, line_no int, line string")
    files = spark.createDataFrame([("f", HEADER)], "file_name string, header_line string")
    got = {r.line_id: r for r in load_lines(df, files).collect()}
    assert [got[i].cvr_number for i in range(4)] == [2**63 - 1, None, None, 5] and [got[i].cvr_text for i in range(4)] == given and got[9].reason == "columns"
    assert [(r.line_id, r.reason) for r in load_lines(df, files, only_bad=True).collect()] == [(9, "columns")]


def test_empty(spark):
    lines = spark.createDataFrame([], "line_id bigint, file_name string, line_no int, line string")
    files = spark.createDataFrame([], "file_name string, header_line string")
    assert load_lines(lines, files).count() == 0


def test_very_long_line(spark):
    long = "1,2,3,4,2-3-4," + "p" * 500_000 + ",Type,0"
    df = spark.createDataFrame([(1, "f", 2, long), (2, "f", 3, long + '"')], "line_id bigint, file_name string, line_no int, line string")
    assert [r.reason for r in load_lines(df, spark.createDataFrame([("f", HEADER)], "file_name string, header_line string")).orderBy("line_id").collect()] == [None, "quoting"]
