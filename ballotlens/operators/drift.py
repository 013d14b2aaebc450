"""Schemas that drift between files: change scripts, and one table of all files.

Each file has a schema tree, whose nodes carry a profile of their cells. The tree edit distance between
a file's tree and the one before it (unordered, as order is no change) gives the cheapest script of
added, removed and renamed (and, between levels, moved) nodes. The scripts are compiled into one
projection for each file, applied to all its lines. Cell profiles are merged from partial ones in a
single pass; no file's lines are gathered anywhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotlens.functions.csvline import cells, lenient_cells, strip_end
from ballotlens.functions.profile import KINDS, REGISTERS, cell_kind, pattern, registers
from ballotlens.operators.copies import assign
from ballotlens.scratch import written

#: A node may be renamed into another whose dissimilarity (0 to 1) is below this; it costs less than remove and add.
RENAME_BELOW = 0.5
BLANKS = " \t\""


@dataclass
class Node:
    """A field of a schema: its name, its cells' profile (see ``profile_lines``; None if it has none) and its children."""

    name: str
    profile: dict | None = None
    children: list[Node] = field(default_factory=list)
    place: float = 0.0  # among its siblings, 0 to 1
    pos: int | None = None  # its column, if it is a leaf
    heading: str = ""  # its whole heading, with those of the nodes above it

    def leaves(self) -> list[Node]:
        return [self] if not self.children else [x for c in self.children for x in c.leaves()]


def kind_of(profile: dict | None) -> str | None:
    """The kind all non-empty cells have; whole and decimal numbers together are decimal, other mixtures text; None without cells."""
    if not profile:
        return None
    seen = [k for k in KINDS if profile.get(f"n_{k}")]
    if not seen:
        return None
    return seen[0] if len(seen) == 1 else "decimal" if seen == ["whole", "decimal"] else "text"


def _words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", name)]


def _consonants(word: str) -> str:
    return word[:1] + re.sub("[aeiou]", "", word[1:])


def _word_likeness(a: str, b: str) -> float:
    """1 for the same word, less for an abbreviation (a prefix, or its letters in order from the same first letter)."""
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 2 and long.startswith(short):
        return 0.9
    if len(short) >= 2 and short[0] == long[0]:
        rest = iter(long)
        if all(c in rest for c in short):
            return 0.8
        if _consonants(short) == _consonants(long):
            return 0.8
    return 0.0


def name_likeness(a: str, b: str) -> float:
    """0 to 1: the share of the letters of both names' words that have a like word in the other name."""
    x, y = _words(a), _words(b)
    if not x or not y:
        return float(a.strip().lower() == b.strip().lower())
    if "".join(x) == "".join(y):
        return 1.0
    best = [max(_word_likeness(w, v) for v in y) * len(w) for w in x] + [max(_word_likeness(w, v) for v in x) * len(w) for w in y]
    return sum(best) / (len("".join(x)) + len("".join(y)))


def profile_likeness(p: dict | None, q: dict | None) -> float:
    """0 to 1: how alike two fields' cells are, by kind, values, patterns, length and number range; 0.5 if one has no cells."""
    a, b = kind_of(p), kind_of(q)
    if a is None or b is None:
        return 0.5
    same = lambda k: float((np.asarray(p[k]) == np.asarray(q[k])).mean())
    values, patterns = same("values"), same("patterns")
    if a != b:
        return 0.15 + 0.35 * values
    if a in ("boolean", "timestamp"):
        return 0.85 + 0.15 * values
    if a in ("whole", "decimal"):
        if p["run"] is not None and q["run"] is not None and p["run"] != q["run"]:
            return 0.1  # only one of them counts the lines
        if p["run"]:
            return 1.0
        scale = lambda x: math.log10(1 + abs(x))
        gap = max(abs(scale(p["high"]) - scale(q["high"])), abs(scale(p["mean"]) - scale(q["mean"])))
        return max(0.0, min(1.0, 1 - 1.3 * max(0.0, gap - 0.08)) * (0.8 + 0.2 * max(patterns, values)))
    length = 1 - abs(p["length"] - q["length"]) / max(p["length"], q["length"], 1)
    return max(values, 0.75 * patterns + 0.25 * max(length, 0)) if patterns or values else 0.2 * max(length, 0)


def unlikeness(a: Node, b: Node) -> float:
    """0 to 1: what it costs to take b for a; the same name, apart from blanks and quotes, costs nothing."""
    if a.name.strip(BLANKS) == b.name.strip(BLANKS):
        return 0.0
    names, cells_alike = name_likeness(a.name, b.name), profile_likeness(a.profile, b.profile)
    return 1 - min(1.0, 0.5 * names + 0.5 * cells_alike + 0.12 * (1 - min(1.0, 6 * abs(a.place - b.place))) + (0.1 if names >= 0.6 else 0.0))


def _size(node: Node) -> int:
    return 1 + sum(map(_size, node.children))


def edit_script(old: Node, new: Node) -> tuple[float, list[tuple[str, Node | None, Node | None]]]:
    """The least cost and script that turns the children of ``old`` into those of ``new``.

    Adding or removing a node costs 1 for it and each node below, taking one for another its unlikeness
    (if that is at most RENAME_BELOW) and the distance of their children. Children are matched at least cost whatever their
    order. Steps: ("keep" | "rename", old, new), ("remove", old, None), ("add", None, new). A node removed
    in one place and added in another under the same name is one ("move", old, new).
    """
    steps: list[tuple[str, Node | None, Node | None]] = []
    # leaves whose name occurs once on either side are the same field at no cost; only the others are matched
    once = lambda xs: {k: x for x in xs if names[k := x.name.strip(BLANKS)] == 1 and not x.children}
    names = Counter(x.name.strip(BLANKS) for x in old.children)
    here = once(old.children)
    names = Counter(x.name.strip(BLANKS) for x in new.children)
    there = once(new.children)
    same = here.keys() & there.keys()
    steps += [("keep", here[k], there[k]) for k in sorted(same)]
    a = [x for x in old.children if here.get(x.name.strip(BLANKS)) is not x or x.name.strip(BLANKS) not in same]
    b = [x for x in new.children if there.get(x.name.strip(BLANKS)) is not x or x.name.strip(BLANKS) not in same]
    n, m = len(a), len(b)
    total, below = 0.0, {}
    if n and m:
        cost = np.full((n + m, n + m), 0.0)
        cost[:n, m:], cost[n:, :m] = 1e6, 1e6
        for i, x in enumerate(a):
            cost[i, m + i] = _size(x)
            for j, y in enumerate(b):
                u = unlikeness(x, y)
                if u > RENAME_BELOW:
                    cost[i, j] = 1e6
                    continue
                deeper, inner = edit_script(x, y)
                below[i, j] = inner
                cost[i, j] = u + deeper
        for j, y in enumerate(b):
            cost[n + j, j] = _size(y)
        to = assign(cost)
        total = float(cost[np.arange(n + m), to].sum())
    else:
        to = np.array([m + i for i in range(n)] + list(range(m)))
        total = float(sum(map(_size, a)) + sum(map(_size, b)))
    for i, x in enumerate(a):
        j = int(to[i])
        if j >= m:
            steps.append(("remove", x, None))
        else:
            steps.append(("keep" if x.name.strip(BLANKS) == b[j].name.strip(BLANKS) else "rename", x, b[j]))
            steps += below[i, j]
    steps += [("add", None, b[j]) for j in sorted(int(t) for t in to[n:] if t < m)]
    return total, _moves(steps)


def _moves(steps: list) -> list:
    gone = {s[1].name.strip(BLANKS): s for s in steps if s[0] == "remove"}
    out = list(steps)
    for s in steps:
        if s[0] == "add" and (r := gone.pop(s[2].name.strip(BLANKS), None)):
            out.remove(s)
            out.remove(r)
            out.append(("move", r[1], s[2]))
    return out


PROFILE = "file_id bigint, pos int, n bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", total double, high double, length bigint, run_low bigint, run_high bigint, " + ", ".join(f"v{i} bigint, p{i} bigint" for i in range(REGISTERS))


def profile_lines(lines: DataFrame) -> DataFrame:
    """file_id, pos and the profile of each column's cells, over all lines.

    Batches are profiled by column and the partial profiles merged by sums, minima and maxima. Lines
    that are null or not well-formed give no cells. Row copies change nothing but the counts.
    """
    schema = T._parse_datatype_string(PROFILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], list[tuple[int, str]]] = {}
            for fid, no, line in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                for pos, cell in enumerate(cells(strip_end(line)) or [] if line is not None else []):
                    if text := cell.strip():
                        found.setdefault((fid, pos), []).append((no or 0, text))
            rows, values, shapes = [], [], []
            for (fid, pos), got in found.items():
                texts = [t for _, t in got]
                kinds = [cell_kind(t) for t in texts]
                numbers = [float(t) for t, k in zip(texts, kinds) if k in ("whole", "decimal")]
                runs = [int(t) - no for (no, t), k in zip(got, kinds) if k == "whole" and len(t) < 18]
                rows.append([fid, pos, len(texts), *[kinds.count(k) for k in KINDS], float(sum(numbers)), max(numbers, default=None), sum(map(len, texts)), min(runs, default=None), max(runs, default=None)])
                distinct = set(texts)
                values.append(sorted(distinct))
                shapes.append(sorted({pattern(t) for t in distinct}))
            sketches = [pa.array(x[:, i]) for v, p in [(registers(values), registers(shapes))] for i in range(REGISTERS) for x in (v, p)]
            arrow = _arrow(schema)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * (len(schema) - 2 * REGISTERS), arrow)], *sketches], schema=arrow)

    partial = lines.select("file_id", "line_no", "line").mapInArrow(run, schema)
    sums = ["n", *[f"n_{k}" for k in KINDS], "total", "length"]
    lows = ["run_low", *[f"{x}{i}" for i in range(REGISTERS) for x in "vp"]]
    return partial.groupBy("file_id", "pos").agg(*[F.sum(c).alias(c) for c in sums], F.max("high").alias("high"), F.max("run_high").alias("run_high"), *[F.min(c).alias(c) for c in lows])


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


#: What a packed profile holds, in its order; then come the registers of values and of patterns.
PACKED = ("pos", "n", *[f"n_{k}" for k in KINDS], "total", "high", "length", "run_low", "run_high")


def packed() -> Column:
    """A column's profile as one short text, which costs less to hand to Python than its many fields."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("|", *[text(c) for c in PACKED], *[F.concat_ws(",", *[f"{x}{i}" for i in range(REGISTERS)]) for x in "vp"])


def unpacked(text: str) -> dict:
    """The profile of a packed text, with mean and mean length, run (whether the column counts the lines; None if it cannot) and registers."""
    *head, values, patterns = text.split("|")
    p = {c: (float(x) if c in ("total", "high") else int(x)) if x else None for c, x in zip(PACKED, head)}
    p["mean"], p["length"] = (p["total"] or 0.0) / max(1, p["n_whole"] + p["n_decimal"]), p["length"] / max(1, p["n"])
    p["run"] = None if p["run_low"] is None or p["n"] < 3 else p["run_low"] == p["run_high"]
    p["values"], p["patterns"] = np.array(values.split(","), np.int64), np.array(patterns.split(","), np.int64)
    return p


def _tree(header: str | None, profiles: list | None, nested: str | None = None) -> Node:
    """The schema tree of a header. nested: what separates the levels of a heading, as in contest:choice; None: all columns
    lie under the root."""
    names = lenient_cells(strip_end(header)) if header is not None else []
    by = {p["pos"]: p for p in map(unpacked, profiles if profiles is not None else [])}
    root = Node("")
    for pos, name in enumerate(names):
        p = by.get(pos)
        above = root
        *path, last = name.split(nested) if nested else [name]
        for part in path:
            known = next((c for c in above.children if c.pos is None and c.name == part), None)
            if known is None:
                known = Node(part, heading=(above.heading + nested if above.heading else "") + part)
                above.children.append(known)
            above = known
        above.children.append(Node(last, p, pos=pos, heading=name))
    _place(root)
    return root


def _place(node: Node) -> None:
    for i, c in enumerate(node.children):
        c.place = i / max(1, len(node.children) - 1)
        _place(c)


def leaf_steps(script: list[tuple[str, Node | None, Node | None]]) -> list[tuple[str, Node | None, Node | None]]:
    """A script's steps for columns only: a node with children that is added or removed is all of its columns; a column that
    is kept under a renamed node is renamed; a node that moves takes its columns along, the same under the same name."""
    out: list[tuple[str, Node | None, Node | None]] = []
    for step, x, y in script:
        if step == "remove":
            out += [(step, c, None) for c in x.leaves() if c.pos is not None]
        elif step == "add":
            out += [(step, None, c) for c in y.leaves() if c.pos is not None]
        elif step == "move" and (x.children or y.children):
            out += [("move" if s == "keep" else s, a, b) for s, a, b in leaf_steps(edit_script(x, y)[1])]
        elif x.pos is not None and y.pos is not None:
            same = x.heading.strip(BLANKS) == y.heading.strip(BLANKS)
            out.append(("rename" if step == "keep" and not same else step, x, y))
    return out


SCRIPT = "file_id bigint, previous_id bigint, step string, pos int, heading string, previous_pos int, previous_heading string, kind string, previous_kind string"


def change_scripts(files: DataFrame, lines: DataFrame, group: str = "county_id", order: str = "exported_at", nested: str | None = None) -> DataFrame:
    """Script steps from each file's predecessor in its group (by order, then file_id) to it.

    nested: what separates the levels of a heading (None: flat). A group's first file has a step "first" for each column. Files sent twice count once. Only the slim
    list of files is sorted within a group; each pair of files is then solved on its own.
    """
    slim = files.groupBy("file_id").agg(F.min(group).alias("g"), F.min(order).alias("t"), F.min("header_line").alias("header_line"))
    pairs = slim.select("file_id", F.lag("file_id").over(Window.partitionBy("g").orderBy(F.col("t").asc_nulls_first(), "file_id")).alias("previous_id"))
    prof = profile_lines(lines)
    side = written(slim.select("file_id", "header_line").join(prof.groupBy("file_id").agg(F.collect_list(packed()).alias("profiles")), "file_id", "left"), "profiles")
    before = side.select(F.col("file_id").alias("previous_id"), F.col("header_line").alias("previous_line"), F.col("profiles").alias("previous_profiles"))
    both = pairs.join(side, "file_id").join(before, "previous_id", "left").select("file_id", "previous_id", "header_line", "profiles", "previous_line", "previous_profiles")
    schema = T._parse_datatype_string(SCRIPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                new, old = _tree(r["header_line"], r["profiles"], nested), _tree(r["previous_line"], r["previous_profiles"], nested)
                steps = [("first", None, x) for x in new.leaves() if x.pos is not None] if r["previous_id"] is None else leaf_steps(edit_script(old, new)[1])
                for step, x, y in steps:
                    rows.append({"file_id": r["file_id"], "previous_id": r["previous_id"], "step": step, "pos": y and y.pos, "heading": y and y.heading.strip(BLANKS), "previous_pos": x and x.pos, "previous_heading": x and x.heading.strip(BLANKS), "kind": y and kind_of(y.profile), "previous_kind": x and kind_of(x.profile)})
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(schema))

    return both.mapInArrow(run, schema)


def schema_changes(scripts: DataFrame) -> DataFrame:
    """file_id, change_kind (added, removed, renamed, type) and heading, of each change; moves are no change."""
    names = {"add": "added", "remove": "removed", "rename": "renamed"}
    kind = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    a = scripts.where(F.col("step").isin(*names)).select("file_id", kind[F.col("step")].alias("change_kind"), F.coalesce("heading", "previous_heading").alias("heading"))
    b = scripts.where("step in ('keep', 'rename', 'move') and kind is not null and previous_kind is not null and kind <> previous_kind").select("file_id", F.lit("type").alias("change_kind"), "heading")
    return a.unionAll(b).distinct()


def compile_projections(scripts: DataFrame) -> DataFrame:
    """file_id, pos and field: the name under which each column of each file stands in the common table.

    Inside a group a column descends from the heading that its field had first; chains of steps are
    followed by pointer doubling, so that a group of any length takes a logarithmic number of joins.
    Over all groups, a heading stands for the first heading from which it descends most often (ties:
    the least). Two columns of a file that come to the same name are told apart by "#2" and so on.
    """
    node = written(scripts.where("pos is not null").select("file_id", "pos", "heading", F.when(F.col("previous_pos").isNotNull(), F.col("previous_id")).alias("up_file"), F.col("previous_pos").alias("up_pos"), F.col("heading").alias("root")), "chain")
    while node.where("up_file is not null").limit(1).count():
        up = node.select(F.col("file_id").alias("up_file"), F.col("pos").alias("up_pos"), F.col("up_file").alias("far_file"), F.col("up_pos").alias("far_pos"), F.col("root").alias("far_root"))
        node = written(node.join(up, ["up_file", "up_pos"], "left").select("file_id", "pos", "heading", F.col("far_file").alias("up_file"), F.col("far_pos").alias("up_pos"), F.coalesce("far_root", "root").alias("root")), "chain")
    votes = node.groupBy("heading", "root").count()
    best = votes.groupBy(F.col("heading").alias("root")).agg(F.max_by("root", F.struct("count", F.col("root") == F.col("heading"), "root")).alias("field"))
    twin = F.row_number().over(Window.partitionBy("file_id", "field").orderBy("pos"))
    return node.join(best, "root", "left").select("file_id", "pos", F.coalesce("field", "root").alias("field")).select("file_id", "pos", F.when(twin == 1, F.col("field")).otherwise(F.concat("field", F.lit("#"), twin)).alias("field"))


def field_kinds(scripts: DataFrame, projections: DataFrame) -> DataFrame:
    """field and kind of the common table: the kind that its columns have in all files; whole and decimal numbers together
    are decimal, other mixtures text. A field without any cell has the kind text."""
    kinds = scripts.where("pos is not null and kind is not null").join(projections, ["file_id", "pos"]).groupBy("field").agg(F.array_sort(F.collect_set("kind")).alias("k"))  # at most as many as there are kinds
    one = F.when(F.size("k") == 1, F.col("k")[0]).when(F.array_join("k", ",") == "decimal,whole", "decimal").otherwise("text")
    return projections.select("field").distinct().join(kinds, "field", "left").select("field", F.coalesce(one, F.lit("text")).alias("kind"))


def typed(value: Column, kind: Column) -> Column:
    """A cell's text as its kind is written in the common table: numbers without a plus sign or leading zeros, true and false small."""
    number = F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("decimal(38,0)").cast("string")).otherwise(value.try_cast("double").cast("string"))
    return F.when(kind == "whole", F.coalesce(number, value)).when(kind == "decimal", F.coalesce(value.try_cast("double").cast("string"), value)).when(kind == "boolean", F.lower(value)).otherwise(value)


def one_table(lines: DataFrame, projections: DataFrame) -> DataFrame:
    """file_id, line_no and cells (a map from field to text) of every line, once.

    The projection of a file is a short array of names beside each of its lines. Empty cells are null;
    cells beyond the header, and lines that are not well-formed, keep their text under "#<place>" and "#line".
    """
    names = projections.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "field"))).alias("names"))
    schema = T._parse_datatype_string("file_id bigint, line_no int, cells map<string,string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for line, pairs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                by = dict(pairs or [])
                found = cells(strip_end(line)) if line is not None else []
                out.append([("#line", line)] if found is None else [(by.get(i, f"#{i + 1}"), c.strip() or None) for i, c in enumerate(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.map_(pa.string(), pa.string()))], names=["file_id", "line_no", "cells"])

    slim = lines.select("file_id", "line_no", "line").distinct()
    return slim.join(names, "file_id", "left").select("file_id", "line_no", "line", "names").mapInArrow(run, schema)

