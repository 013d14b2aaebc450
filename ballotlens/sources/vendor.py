"""Vendor exports: wide 0/1 matrices with header rows, and nested session files.

The header rows of a wide export say what its columns mean. They are read once a file into a row of that file's meaning, which
stands beside each of its lines, so that exports of any number of counties are read by one plan. Cells are split and votes
are gathered by built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlens.functions.csvline import cells

#: How a redacted row begins: the start of its first cell. Fixed values.
REDACTED = ("Redacted", "RCV Redacted")
#: How the first vote cell of a redacted row begins, without case. Fixed values.
HIDDEN = ("redacted", "x", "*")
CELL = r',(=?"(?:[^"]|"")*"|[^",]*)'
#: Meanings are broadcast only if there are no more files.
BROADCAST_FILES = 20_000


@dataclass(frozen=True)
class Layout:
    """Header rows of a wide export: how many, and which has the contests, the choices and the headings; and the heading of each column of a record."""

    rows: int
    contests: int
    choices: int
    headings: int
    names: tuple[tuple[str, str], ...]


#: The layouts that are known: the usual one, and one without a line for the election, whose headings share the choices' row.
USUAL = Layout(4, 1, 2, 3, (("cvr_number", "CvrNumber"), ("tabulator", "TabulatorNum"), ("batch_id", "BatchId"), ("record_id", "RecordId"), ("imprinted_id", "ImprintedId"), ("counting_group", "CountingGroup"), ("precinct", "PrecinctPortion"), ("ballot_type", "BallotType")))
BOXES = Layout(2, 0, 1, 1, (("cvr_number", "RowNumber"), ("tabulator", "Tabulator"), ("batch_id", "BoxID"), ("record_id", "BoxPosition"), ("imprinted_id", "BallotID"), ("counting_group", "CG"), ("precinct", "PrecinctID"), ("ballot_type", "BallotStyleID")))
LAYOUTS = {"usual": USUAL, "boxes": BOXES}


def leading_equals(cell: Column) -> Column:
    """="5" means 5."""
    return F.when(cell.startswith("="), F.regexp_replace(cell, '[="]', "")).otherwise(cell)


def raw_cells(line: Column) -> Column:
    """The cells of a well-formed line as they stand, with their quotes."""
    return F.regexp_extract_all(F.concat(F.lit(","), F.regexp_replace(line, r"\r?\n?$", "")), F.lit(CELL), F.lit(1))


def line_cells(line: Column) -> Column:
    """The cells of a well-formed line: without quotes, doubled ones single, and ="x" as x."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, '^=?"', ""), '"$', ""), '""', '"')
    return F.transform(raw_cells(line), lambda x: F.when(x.startswith('"') | x.startswith('="'), bare(x)).otherwise(x))


def redaction(first: Column, first_vote: Column) -> Column:
    """Why a row is redacted: how its first cell begins ("empty" if it is), else how its first vote cell does; null if it is not."""
    out = F.when(F.coalesce(F.trim(first), F.lit("")) == "", "empty")
    for word in REDACTED:
        out = out.when(first.startswith(word), word)
    for word in HIDDEN:
        out = out.when(F.lower(F.trim(first_vote)).startswith(word), word)
    return out


def name_votes_ranks(title: Column) -> tuple[Column, Column, Column]:
    """A contest's name without the remark at its end, how many are voted for, and how many ranks there are (0: not ranked)."""
    name = F.regexp_replace(title, r"\s*\((?:Vote For|Number of positions)=[^()]*\)\s*$", "")
    votes = F.coalesce(F.nullif(F.regexp_extract(title, r"(?:Vote For|Number of positions)=(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return F.trim(name), votes, F.coalesce(F.nullif(F.regexp_extract(title, r"Number of ranks=(\d+)", 1), F.lit("")).cast("int"), F.lit(0))


MEANING = "file_name string, election string, version string, first int, heads array<string>, contests array<struct<contest: int, title: string, choices: array<string>>>, columns array<struct<contest: int, cand: int, rank: int, write_in: boolean>>"


class WideSchema:
    """What the header rows of one file say: its contests with their choices, and each vote column's contest, choice, rank and whether it is for write-ins.

    A ranked contest has a block of columns for each rank, in the order of its choices; contests and choices count from 1.
    """

    def __init__(self, rows: list[str], layout: Layout = USUAL):
        parsed = [cells(r.rstrip("\r\n")) or [] for r in rows]
        titles, choices, heads = parsed[layout.contests], parsed[layout.choices], parsed[layout.headings]
        top = parsed[0] if layout.contests else []
        self.election, self.version = (top + ["", ""])[0], (top + ["", ""])[1].strip()
        named = [i for i, t in enumerate(titles) if t.strip()]
        self.first = named[0] if named else len(heads)
        self.heads = [h.strip() for h in heads[: self.first]]
        self.columns: list[tuple[int, int, int, bool]] = []
        self.contests: list[dict] = []
        for i in range(self.first, len(titles)):
            title = titles[i].strip()
            if not self.contests or title != self.contests[-1]["title"]:
                self.contests.append({"contest": len(self.contests) + 1, "title": title, "choices": [], "ranked": "Number of ranks=" in title})
            contest = self.contests[-1]
            ranked = re.fullmatch(r"(.*)\((\d+)\)\s*", choices[i]) if contest["ranked"] else None
            name = (ranked[1] if ranked else choices[i]).strip()
            if name not in contest["choices"]:
                contest["choices"].append(name)
            self.columns.append((contest["contest"], contest["choices"].index(name) + 1, int(ranked[2]) if ranked else 0, name.lower().startswith("write-in")))

    def row(self, file_name: str) -> dict:
        contests = [{k: c[k] for k in ("contest", "title", "choices")} for c in self.contests]
        return {"file_name": file_name, "election": self.election, "version": self.version, "first": self.first, "heads": self.heads, "contests": contests, "columns": [dict(zip(("contest", "cand", "rank", "write_in"), c)) for c in self.columns]}


def wide_meaning(lines: DataFrame, layout: Layout = USUAL) -> DataFrame:
    """One row a file: what its header rows (lines 1 to layout.rows) say. Files without all of them are left out."""
    kinds = pa.schema([
        ("file_name", pa.string()), ("election", pa.string()), ("version", pa.string()), ("first", pa.int32()), ("heads", pa.list_(pa.string())),
        ("contests", pa.list_(pa.struct([("contest", pa.int32()), ("title", pa.string()), ("choices", pa.list_(pa.string()))]))), ("columns", pa.list_(pa.struct([("contest", pa.int32()), ("cand", pa.int32()), ("rank", pa.int32()), ("write_in", pa.bool_())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [WideSchema([h["value"] for h in heads], layout).row(name) for name, heads in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    heads = lines.where(F.col("line_no") <= layout.rows).groupBy("file_name").agg(F.array_sort(F.collect_set(F.struct("line_no", "value"))).alias("heads"))
    return heads.where(F.size("heads") == layout.rows).mapInArrow(run, MEANING)


def wide_rows(lines: DataFrame, meaning: DataFrame, layout: Layout = USUAL) -> DataFrame:
    """file_name, line_no, the record's columns as text, why (see ``redaction``), cells and columns of each line below the headers.

    lines: file_name, line_no (from 1) and value. A record's column that the file lacks is null.
    """
    m = meaning.select("file_name", "first", "heads", "columns")
    m = F.broadcast(m) if m.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES else m
    rows = lines.where(F.col("line_no") > layout.rows).join(m, "file_name").withColumn("cells", line_cells(F.col("value")))
    cell = lambda h: F.nullif(F.trim(F.get("cells", F.nullif(F.array_position("heads", h), F.lit(0)).cast("int") - 1)), F.lit(""))
    return rows.select("file_name", "line_no", *[cell(h).alias(c) for c, h in layout.names], redaction(F.get("cells", F.lit(0)), F.get("cells", F.col("first"))).alias("why"), "first", "cells", "columns")


def _paired() -> Column:
    votes = F.slice("cells", F.col("first") + 1, F.greatest(F.size("columns"), F.lit(1)))
    return F.filter(F.arrays_zip(F.col("columns").alias("m"), votes.alias("v")), lambda p: p["m"].isNotNull() & (F.coalesce(F.trim(p["v"]), F.lit("")) != ""))


def wide_votes(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, contest and cands of each contest on each row: the choices with a number above 0, ranked ones by rank, each once.

    A contest whose cells are all blank is not on the ballot; write-ins are skipped. Redacted rows hold no votes of a card, but
    those that begin with "RCV Redacted" hold a ranked ballot. Only the cells of one row meet.
    """
    cards = rows.where(F.col("why").isNull() | (F.col("why") == "RCV Redacted")).select(*keep, _paired().alias("paired"))
    marked = lambda p: (F.trim(p["v"]).try_cast("int") > 0) & ~p["m"]["write_in"]
    on = F.array_distinct(F.transform("paired", lambda p: p["m"]["contest"]))
    mine = F.filter("paired", lambda p: (p["m"]["contest"] == F.col("contest")) & marked(p))
    ordered = F.array_sort(F.transform(mine, lambda p: F.struct(p["m"]["rank"].alias("rank"), p["m"]["cand"].alias("cand"))))
    return cards.select(*keep, "paired", F.explode(on).alias("contest")).select(*keep, "contest", F.array_distinct(F.transform(ordered, lambda s: s["cand"])).alias("cands"))


def redacted_groups(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, contest, cand and nvotes: the summed votes of rows that stand for several redacted cards (first cell "Redacted..." or empty)."""
    groups = rows.where(F.col("why").isin("Redacted", "empty")).select(*keep, F.inline(_paired()))
    return groups.groupBy(*keep, F.col("m.contest").alias("contest"), F.col("m.cand").alias("cand")).agg(F.sum(F.trim("v").try_cast("bigint")).alias("nvotes"))


def contest_names(meaning: DataFrame) -> DataFrame:
    """file_name, contest, name, vote_for, ranks and choices of each contest of each file."""
    c = meaning.select("file_name", F.inline("contests"))
    name, votes, ranks = name_votes_ranks(F.col("title"))
    return c.select("file_name", "contest", name.alias("name"), votes.alias("vote_for"), ranks.alias("ranks"), "choices")


def write_wide(cards: DataFrame, columns: DataFrame, layout: Layout = USUAL) -> DataFrame:
    """file_name, line_no and value of wide exports.

    cards: file_name, line_no (above layout.rows), heads (the cells before the votes, as text) and votes. columns: file_name,
    election, version and columns, an array of contest_id, title, cand (null: write-in), choice and rank (0: not ranked) in the order of the file.
    """
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(x, F.lit("")), '"', '""'), F.lit('"'))
    line = lambda heads, votes: F.array_join(F.concat(F.transform(heads, quoted), votes), ",")
    names = F.array(*[F.lit(h) for _, h in layout.names])
    blank = F.transform(names, lambda _: F.lit(""))
    of = lambda f: F.transform("columns", lambda c: quoted(f(c)))
    choice = lambda c: F.when(c["rank"] > 0, F.concat(c["choice"], F.lit("("), c["rank"], F.lit(")"))).otherwise(c["choice"])
    titles, choices, none = of(lambda c: c["title"]), of(choice), of(lambda c: F.lit(""))
    top = F.concat_ws(",", quoted(F.col("election")), quoted(F.col("version")))
    heads = [top, line(blank, titles), line(blank, choices), line(names, none)] if layout.contests else [line(blank, titles), line(names, choices)]
    headers = columns.select("file_name", F.posexplode(F.array(*heads)).alias("k", "value")).select("file_name", (F.col("k") + 1).alias("line_no"), "value")
    on = lambda c: F.try_element_at("votes", c["contest_id"])
    mark = lambda c: F.when(~F.map_contains_key(F.col("votes"), c["contest_id"]), "").when(c["cand"].isNull(), "0").when(F.coalesce(F.when(c["rank"] == 0, F.array_contains(on(c), c["cand"])).otherwise(F.get(F.array_distinct(on(c)), c["rank"] - 1) == c["cand"]), F.lit(False)), "1").otherwise("0")
    body = cards.join(columns.select("file_name", "columns"), "file_name").select("file_name", "line_no", line(F.col("heads"), F.transform("columns", mark)).alias("value"))
    return headers.unionByName(body)


def session_votes(marks: DataFrame) -> DataFrame:
    """session_id, contest_id and cands of the marks that are votes, by rank, each candidate once (its first rank)."""
    rows = marks.where("is_vote and candidate_id is not null").groupBy("session_id", "card_no", "contest_id", "candidate_id").agg(F.min(F.struct(F.coalesce("mark_rank", F.lit(0)), "mark_no")).alias("at"))
    return rows.groupBy("session_id", "card_no", "contest_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "candidate_id"))), lambda s: s["candidate_id"]).alias("cands"))  # the marks of one contest on one card


def session_id(tabulator: Column, batch: Column, record: Column, mask: Column) -> Column:
    """A session's id tabulator-batch-record; a record X is told by the image mask: what stands after its folder Images (else after its first folder), up to *.*"""
    told = F.when(mask.rlike(r"Images.*\*\.\*"), F.regexp_extract(mask, r"^.*Images.(.*)\*\.\*", 1)).otherwise(F.regexp_extract(mask, r"^[^/\\]*[/\\](.*)\*\.\*", 1))
    return F.concat_ws("-", tabulator, batch, F.when(record == "X", told).otherwise(record))
