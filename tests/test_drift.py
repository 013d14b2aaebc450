import datetime as dt

from pyspark.sql import functions as F

from ballotlens.operators.drift import Node, change_scripts, compile_projections, edit_script, field_kinds, name_likeness, one_table, schema_changes, typed

FILES = "file_id bigint, county_id int, exported_at timestamp_ntz, header_line string, heading string"
LINES = "file_id bigint, line_no int, line string, cells string"
T0 = dt.datetime(2031, 1, 1)


def tables(spark, files):
    f = [(i, c, None if t is None else T0 + dt.timedelta(days=t), h, "x") for i, c, t, h, _ in files]
    rows = [(i, n + 1, line, "y") for i, _, _, _, ls in files for n, line in enumerate(ls)]
    return spark.createDataFrame(f, FILES), spark.createDataFrame(rows, LINES)


def numbered(k, f):
    return [f(i) for i in range(1, k + 1)]


def test_changes_and_table(spark):
    a = numbered(12, lambda i: f"{i},{i % 5 + 1},Type {i},true")
    b = numbered(12, lambda i: f'"{i % 4 + 1}","{100 + i}","Type {i + 3}","2031-01-{i:02d}"')
    c = numbered(12, lambda i: f"T{i % 4 + 1},{200 + i},Type {i + 3}")
    files = [(9, 1, 0, "CvrNumber,TabulatorNum,BallotType,Remade", a), (3, 1, 1, ' "TABULATOR_ID" , "CvrNumber","BallotType","ScanTime"'.replace(' "TABULATOR_ID" ', '"TABULATOR_ID"'), b), (5, 1, 2, "TABULATOR_ID,CvrNumber,BallotTypeName ", c), (7, 2, 0, "A", ["1"])]
    f, lines = tables(spark, files)
    scripts = change_scripts(f.unionAll(f.limit(1)), lines.unionAll(lines.limit(5)))
    got = {(r.file_id, r.change_kind, r.heading) for r in schema_changes(scripts).collect()}
    assert got == {(3, "renamed", "TABULATOR_ID"), (3, "removed", "Remade"), (3, "added", "ScanTime"), (5, "removed", "ScanTime"), (5, "renamed", "BallotTypeName"), (5, "type", "TABULATOR_ID")}
    fields = {(r.file_id, r.pos): r.field for r in compile_projections(scripts).collect()}
    assert fields[5, 0] == "TabulatorNum" and fields[3, 1] == "CvrNumber" and fields[5, 2] == "BallotType"
    rows = {(r.file_id, r.line_no): r.cells for r in one_table(lines, compile_projections(scripts)).collect()}
    assert rows[5, 1] == {"TabulatorNum": "T2", "CvrNumber": "201", "BallotType": "Type 4"} and len(rows) == 37


def test_empty_cells_have_no_type(spark):
    files = [(1, 1, 0, "A,B", ["1,", "2,"]), (2, 1, 1, "A,B", [",x", ","]), (3, 1, 2, "A,B", ["1.5,x", "2,x"]), (4, 1, 3, "A,B", ["3,y"])]
    f, lines = tables(spark, files)
    assert {(r.file_id, r.change_kind, r.heading) for r in schema_changes(change_scripts(f, lines)).collect()} == {(4, "type", "A")}


def test_odd_files(spark):
    files = [(1, 1, 0, None, []), (2, 1, 1, "", ["", None]), (3, 1, None, 'A,"B', ["1"]), (4, None, 0, "A,A", ["1,2", '"'])]
    f, lines = tables(spark, files)
    scripts = change_scripts(f, lines)
    assert schema_changes(scripts).count() >= 0
    rows = {(r.file_id, r.line_no): r.cells for r in one_table(lines, compile_projections(scripts)).collect()}
    assert rows[4, 1] == {"A": "1", "A#2": "2"} and rows[4, 2] == {"#line": '"'}
    empty = tables(spark, [])
    assert schema_changes(change_scripts(*empty)).count() == 0


def test_nested_trees_and_moves():
    old = Node("", None, [Node("session", None, [Node("TabulatorId"), Node("BatchId")]), Node("note")])
    new = Node("", None, [Node("session", None, [Node("TabulatorNumId"), Node("BatchId"), Node("note")])])
    cost, steps = edit_script(old, new)
    kinds = {(s[0], (s[1] or s[2]).name) for s in steps}
    assert ("rename", "TabulatorId") in kinds and ("move", "note") in kinds and ("keep", "BatchId") in kinds and 0 < cost < 4


def test_nested_headings_in_files(spark):
    cells = numbered(12, lambda i: f"{i},{i % 2},{(i + 1) % 2},Type {i}")
    wider = numbered(12, lambda i: f"{i},{i % 2},{(i + 1) % 2},{i % 2},Type {i}")
    files = [(1, 1, 0, "Id,Mayor:Ann,Mayor:Bob,Type", cells), (2, 1, 1, "Id,Mayor:Ann,Mayor:Bob,Clerk:Cy,Type", wider), (3, 1, 2, "Id,Mayoral:Ann,Mayoral:Bob,Type", cells), (4, 1, 3, "Id,Ann,Mayoral:Bob,Type", cells)]
    f, lines = tables(spark, files)
    scripts = change_scripts(f, lines, nested=":")
    assert {(r.file_id, r.change_kind, r.heading) for r in schema_changes(scripts).collect()} == {(2, "added", "Clerk:Cy"), (3, "removed", "Clerk:Cy"), (3, "renamed", "Mayoral:Ann"), (3, "renamed", "Mayoral:Bob")}
    assert {(r.file_id, r.heading, r.previous_heading) for r in scripts.where("step = 'move'").collect()} == {(4, "Ann", "Mayoral:Ann")}
    fields = {(r.file_id, r.pos): r.field for r in compile_projections(scripts).collect()}
    assert fields[4, 1] == fields[3, 1] == fields[1, 1] and fields[4, 2] == fields[1, 2]


def test_one_kind_a_field(spark):
    files = [(1, 1, 0, "A,B,C,D", ["007,1,TRUE,x"]), (2, 1, 1, "A,B,C,D", ["+8,2.50,false,"]), (3, 1, 2, "A,B,C,D", ["9,x,,"])]
    f, lines = tables(spark, files)
    scripts = change_scripts(f, lines)
    names = compile_projections(scripts)
    kinds = {r.field: r.kind for r in field_kinds(scripts, names).collect()}
    assert kinds == {"A": "whole", "B": "text", "C": "boolean", "D": "text"}
    df = spark.createDataFrame([("007", "whole"), ("+8", "whole"), ("3", "decimal"), ("2.50", "decimal"), ("TRUE", "boolean"), ("x", "whole"), (None, "text")], "v string, k string")
    assert [r.o for r in df.select(typed(F.col("v"), F.col("k")).alias("o")).collect()] == ["7", "8", "3.0", "2.5", "true", "x", None]


def test_names():
    assert name_likeness("ScanTime", "SCAN_TIME") == 1 and name_likeness("DeviceModel", "MODEL_NM") > 0.4 and name_likeness("Party", "BatchId") == 0
