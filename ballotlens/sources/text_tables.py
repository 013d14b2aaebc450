"""Comma-separated layouts of election records, as DataFrames of text lines and back.

Readers take a DataFrame with the column ``value`` (``spark.read.text``), so that files of any size are
split by Spark; writers give such a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotlens.operators import prefix
from ballotlens.sources.vendor import line_cells as vendor_cells

INTS = "array<int>"


def _cell(i: int) -> Column:
    return F.trim(F.get("c", F.lit(i)))


def _ints(text: Column) -> Column:
    """A list of whole numbers separated by blanks; an empty text is an empty list."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: w.cast("int"))


def _votes(contests: Column, first: int) -> Column:
    """The votes map from the list of contests and one cell of candidates for each, from cell ``first`` on."""
    lists = F.transform(contests, lambda _, i: _ints(F.coalesce(F.get("c", i + first), F.lit(""))))
    return F.map_from_arrays(contests, lists)


# --- card manifest: id, location, index, prn (hex), phantom (yes), style, pool, "c1 c2", cands1, cands2 ---


def read_cards(lines: DataFrame) -> DataFrame:
    """id, location (the id where empty), card_index, prn, phantom, style_id, pool_id and votes. Header and blank lines are skipped."""
    rows = lines.select(F.split("value", ",").alias("c")).where((F.size("c") >= 8) & _cell(2).rlike("^[0-9]+$"))
    none = lambda i: F.when(_cell(i) != "", _cell(i))
    contests = _ints(_cell(7))
    return rows.select(
        _cell(0).alias("id"), F.coalesce(none(1), _cell(0)).alias("location"), _cell(2).cast("int").alias("card_index"), F.conv(none(3), 16, 10).cast("bigint").alias("prn"),
        (_cell(4) == "yes").alias("phantom"), none(5).cast("int").alias("style_id"), none(6).cast("int").alias("pool_id"), _votes(contests, 8).alias("votes"),
    )


def write_cards(cards: DataFrame) -> DataFrame:
    entries = F.array_sort(F.map_entries("votes"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cands = F.transform(entries, lambda e: F.array_join(F.coalesce(e["value"], F.array().cast(INTS)).cast("array<string>"), " "))
    head = [F.col("id"), F.when(F.col("location") == F.col("id"), "").otherwise(text("location")), text("card_index"), F.coalesce(F.lower(F.conv(F.col("prn").cast("string"), 10, 16)), F.lit("")), F.when(F.col("phantom"), "yes").otherwise(""), text("style_id"), text("pool_id"), F.array_join(F.transform(entries, lambda e: e["key"].cast("string")), " ")]
    return cards.select(F.concat(F.concat_ws(", ", *head), F.lit(", "), F.array_join(F.transform(cands, lambda c: F.concat(c, F.lit(","))), " ")).alias("value"))


# --- card-vote records: id, group, style, precinct, "contests", cands ... --------------------------


def read_cvrs(lines: DataFrame) -> DataFrame:
    rows = lines.select(F.split(F.regexp_replace("value", '"', ""), ",").alias("c")).where((F.size("c") >= 5) & _cell(1).rlike("^[0-9]+$"))
    none = lambda i: F.when(_cell(i) != "", _cell(i)).cast("int")
    return rows.select(_cell(0).alias("id"), none(1).alias("counting_group"), none(2).alias("style_id"), none(3).alias("precinct"), _votes(_ints(_cell(4)), 5).alias("votes"))


def write_cvrs(cvrs: DataFrame) -> DataFrame:
    entries = F.array_sort(F.map_entries("votes"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cands = F.transform(entries, lambda e: F.array_join(F.coalesce(e["value"], F.array().cast(INTS)).cast("array<string>"), " "))
    head = F.concat_ws(",", "id", text("counting_group"), text("style_id"), text("precinct"), F.concat(F.lit('"'), F.array_join(F.transform(entries, lambda e: e["key"].cast("string")), " "), F.lit('"')))
    return cvrs.select(F.concat(head, F.lit(","), F.array_join(cands, ",")).alias("value"))


# --- pools: pool, name, exact, cards, then contest, vote for, cands, five counts, irv, cand:votes; continuation lines leave the pool cells empty ---


def _pool_lines(lines: DataFrame, order: str, heads: dict[str, tuple[int, str]]) -> DataFrame:
    """Pool and contest of each line, with the pool's heads (name to cell and type) carried forward from its first line.

    A line that leaves the pool's id empty belongs to the pool of the last line before it that has one. Where that happens, ids are
    carried forward by running maxima over ranges of the order, so no file is one window; the rest stays within a pool.
    """
    rows = lines.select(order, F.split("value", ",").alias("c")).where((F.size("c") >= 13) & _cell(4).rlike("^[0-9]+$"))
    rows = rows.withColumn("p", F.when(_cell(0) != "", _cell(0)).cast("int"))
    if rows.where("p is null").limit(1).count():
        mark = F.when(F.col("p").isNotNull(), F.struct(F.col(order).alias("at"), F.col("p").alias("p")))
        rows = prefix.before(rows.withColumn("k", F.lit(0)), ["k"], [order], prefix.index_bucket(order, rows.count()), {}, {"last": mark})
        rows = rows.withColumn("p", F.coalesce("p", "last.p"))
    own = Window.partitionBy("p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # a pool has a line a contest
    last = lambda i, kind: F.last(F.when(_cell(i) != "", _cell(i)).cast(kind), ignorenulls=True).over(own)
    number = lambda i: _cell(i).cast("bigint")
    tally = F.map_from_entries(F.transform(F.filter(F.slice("c", 14, F.size("c")), lambda x: F.instr(x, ":") > 0), lambda x: F.struct(F.trim(F.split(x, ":")[0]), F.trim(F.split(x, ":")[1]).cast("bigint"))))
    return rows.select(
        F.col("p").alias("pool_id"), *[last(i, kind).alias(n) for n, (i, kind) in heads.items()],
        _cell(4).cast("int").alias("contest_id"), _cell(5).cast("int").alias("vote_for"), number(7).alias("ncards"), number(8).alias("novote"), number(9).alias("undervotes"), number(10).alias("overvotes"), number(11).alias("nphantoms"), (_cell(12) == "yes").alias("is_irv"), tally.alias("tally"),
    )


def read_pools(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """pool_id, pool_name, has_exact, total_cards, contest_id, vote_for, ncards, novote, undervotes, overvotes, nphantoms, is_irv, tally.

    Continuation lines may repeat or omit the pool's id; names and totals are carried forward in line order.
    """
    rows = _pool_lines(lines, order, {"pool_name": (1, "string"), "has_exact": (2, "string"), "total_cards": (3, "bigint")})
    return rows.withColumn("has_exact", F.col("has_exact") == "true")


def read_county_pools(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """The same of a county's pools, whose heads are the county's name, its cards and the ids of its styles: county, total_cards and styles in place of the first three."""
    rows = _pool_lines(lines, order, {"county": (1, "string"), "total_cards": (2, "bigint"), "styles": (3, "string")})
    return rows.withColumn("styles", _ints(F.col("styles")))


def write_pools(pools: DataFrame, heads: tuple[str, ...] = ("pool_name", "has_exact", "total_cards"), repeat_id: bool = True) -> DataFrame:
    """line_no and value, from the columns that a reader of pools gives; a pool's first line names it, the others have its id or nothing."""
    w = Window.partitionBy("pool_id").orderBy("contest_id")
    rows = pools.withColumn("k", F.row_number().over(w))
    entries = F.array_sort(F.map_entries("tally"))
    votes = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ", ")
    cands = F.array_join(F.transform(entries, lambda e: e["key"]), " ")
    head = F.when(F.col("k") == 1, F.concat_ws(", ", "pool_id", *[F.col(h).cast("string") for h in heads])).otherwise(F.concat(F.col("pool_id").cast("string") if repeat_id else F.lit(""), F.lit(",,,")))
    body = F.concat_ws(", ", "contest_id", "vote_for", cands, "ncards", "novote", "undervotes", "overvotes", "nphantoms", F.when(F.col("is_irv"), "yes").otherwise(""), votes)
    return rows.select((F.col("pool_id").cast("bigint") * 1_000_000 + F.col("k")).alias("line_no"), F.concat(head, F.lit(", "), body).alias("value"))


# --- ranked ballots: contest, ballot, preferences ... ----------------------------------------------


def read_ranked(lines: DataFrame) -> DataFrame:
    """contest_id, ballot_id and prefs of the ballot lines; the count and the Contest lines are skipped."""
    rows = lines.select(F.split("value", ",").alias("c")).where((F.size("c") >= 2) & _cell(0).rlike("^[0-9]+$") & _cell(1).rlike("^[0-9]+$"))
    prefs = F.transform(F.filter(F.slice("c", 3, F.size("c")), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    return rows.select(_cell(0).cast("int").alias("contest_id"), _cell(1).cast("int").alias("ballot_id"), prefs.alias("prefs"))


#: What a line of each layout must look like; anything else but a blank line or a header is not read.
PATTERNS = {
    "cards": lambda: (F.size("c") >= 8) & _cell(2).rlike("^[0-9]+$"),
    "cvrs": lambda: (F.size("c") >= 5) & _cell(1).rlike("^[0-9]+$"),
    "pools": lambda: (F.size("c") >= 13) & _cell(4).rlike("^[0-9]+$"),
    "ranked": lambda: (F.size("c") >= 2) & _cell(0).rlike("^[0-9]+$") & _cell(1).rlike("^[0-9]+$"),
}


def unread(lines: DataFrame, layout: str, header: str = "^(id|poolId|countyPoolId|Contest|[0-9]+$)") -> DataFrame:
    """The lines that a reader leaves out though they are neither blank nor headers (which begin as the pattern says): value."""
    rows = lines.select("value", F.split("value", ",").alias("c")).where(~F.coalesce(PATTERNS[layout](), F.lit(False)))
    return rows.where((F.trim("value") != "") & ~F.trim("value").rlike(header)).select("value")


# --- state files with a header ---------------------------------------------------------------------


def whole(text: Column) -> Column:
    """A whole number with thousands separators or quotes; N/A is -1, anything else null."""
    t = F.trim(F.regexp_replace(text, '[",]', ""))
    return F.when(F.upper(t) == "N/A", -1).otherwise(t.try_cast("bigint"))


def read_named(spark, path: str, columns: dict[str, tuple[tuple[str, ...], str]], encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header. columns: output name to its possible headings (without case, blanks and signs) and kind
    ("text", "whole" or an SQL type). Missing headings give null; other columns are not read."""
    raw = spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').csv(path)
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    have = {plain(c): c for c in raw.columns}
    out = []
    for name, (headings, kind) in columns.items():
        found = next((have[plain(h)] for h in headings if plain(h) in have), None)
        value = F.col(f"`{found}`") if found else F.lit(None).cast("string")
        out.append((whole(value) if kind == "whole" else value if kind == "text" else F.trim(value).try_cast(kind)).alias(name))
    return raw.select(*out)


#: Headings of the state and county files, by layout. Fixed values.
STATEMENT_OF_VOTES = {"precinct_code": (("Precinct Code", "Precinct"), "text"), "precinct_number": (("Precinct Number",), "text"), "contest_title": (("Contest Title", "Contest"), "text"), "choice_name": (("Choice Name", "Choice", "Candidate"), "text"), "active_voters": (("Active Voters",), "whole"), "total_ballots": (("Total Ballots", "Ballots"), "whole"), "total_votes": (("Total Votes", "Votes"), "whole"), "total_undervotes": (("Total Undervotes", "Undervotes", "Round 1 Undervotes"), "whole"), "total_overvotes": (("Total Overvotes", "Overvotes"), "whole")}
ROUND_CONTEST = {"contest_name": (("contest_name",), "text"), "audit_reason": (("audit_reason",), "text"), "winners_allowed": (("winners_allowed",), "whole"), "ballot_card_count": (("ballot_card_count",), "whole"), "contest_ballot_card_count": (("contest_ballot_card_count",), "whole"), "min_margin": (("min_margin",), "whole"), "risk_limit": (("risk_limit",), "double"), "gamma": (("gamma",), "double"), "optimistic_samples": (("optimistic_samples_to_audit",), "whole"), "estimated_samples": (("estimated_samples_to_audit",), "whole")}
COUNTY_TABULATION = {"county_name": (("county_name",), "text"), "contest_name": (("contest_name",), "text"), "choice": (("choice",), "text"), "votes": (("votes",), "whole")}
MVR_COMPARISON = {"county_name": (("county_name",), "text"), "contest_name": (("contest_name",), "text"), "imprinted_id": (("imprinted_id",), "text"), "ballot_type": (("ballot_type",), "text"), "choice_per_cvr": (("choice_per_voting_computer", "cvr_choice"), "text"), "choice_per_audit": (("choice_per_audit_board", "audit_board_selection", "mvr_choice"), "text"), "cvr_id": (("cvr_id",), "whole"), "consensus": (("did_audit_board_agree", "consensus"), "text"), "record_type": (("record_type",), "text"), "audit_reason": (("audit_reason",), "text")}
IMAGE_AUDIT = {"county": (("County",), "text"), "contest_id": (("Contest Id",), "int"), "contest": (("Contest",), "text"), "detail_id": (("Detail Id",), "text"), "detail_name": (("Detail",), "text"), "org_count": (("Original Count",), "whole"), "audit_count": (("Audit Count",), "whole"), "diff_count": (("Difference",), "whole")}
CANONICAL_LIST = {"county_name": (("CountyName", "county_name"), "text"), "contest_name": (("ContestName", "contest_name"), "text"), "choices": (("ContestChoices", "choices"), "text")}


def canonical_choices(rows: DataFrame) -> DataFrame:
    """county_name, contest_name and choice, from a canonical list whose choices are separated by commas."""
    return rows.select("county_name", "contest_name", F.explode(F.split("choices", r"\s*,\s*")).alias("choice")).distinct()


def image_audit(rows: DataFrame) -> DataFrame:
    """county (without the word), contest_id, detail_id, detail_name and the three counts, 0 where the first is missing."""
    some = lambda c: F.when(F.col("org_count").isNull(), 0).otherwise(F.coalesce(c, F.lit(0))).cast("bigint").alias(c)
    return rows.select(F.trim(F.regexp_replace("county", "County", "")).alias("county"), "contest_id", F.trim("detail_id").alias("detail_id"), F.trim("detail_name").alias("detail_name"), some("org_count"), some("audit_count"), some("diff_count"))


def plain_name(text: Column) -> Column:
    """A name without commas and quotes; doubled quotes are one apostrophe."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, '""', "'"), '[",]', ""))


def read_batch_manifest(lines: DataFrame, name_first: bool = False) -> DataFrame:
    """file_name, batch, kind and nballots. lines: file_name and value, without the header; name_first: the columns are name, ballots, kind."""
    c = vendor_cells(F.col("value"))
    at = (0, 1, 2) if name_first else (1, 2, 0)
    return lines.select("file_name", plain_name(F.get(c, F.lit(at[0]))).alias("batch"), F.trim(F.get(c, F.lit(at[2]))).alias("kind"), F.trim(F.get(c, F.lit(at[1]))).try_cast("bigint").alias("nballots")).where("batch <> ''")


def read_batch_totals(lines: DataFrame) -> DataFrame:
    """file_name, batch, contest, choice and votes of wide totals whose headings are "contest - choice".

    lines: file_name, line_no (1 is the header) and value. Empty cells, as after a comma at the end, are skipped; a file's
    header stands beside each of its lines, so that files may have other contests. Headings are taken apart once a file, not once a cell.
    """
    c = vendor_cells(F.col("value"))
    part = lambda h, i: F.trim(F.regexp_extract(plain_name(h), r"^(.*)-([^-]*)$", i))
    heads = lines.where("line_no = 1").groupBy("file_name").agg(F.first(F.slice(c, 2, F.size(c))).alias("heads"))
    heads = heads.select("file_name", F.transform("heads", lambda h: F.when(F.coalesce(h, F.lit("")) != "", F.struct(part(h, 1).alias("contest"), part(h, 2).alias("choice")))).alias("heads"))
    rows = lines.where("line_no > 1").join(heads, "file_name").select("file_name", plain_name(F.get(c, F.lit(0))).alias("batch"), F.explode(F.arrays_zip(F.col("heads").alias("h"), F.slice(c, 2, F.size(c)).alias("v"))).alias("p"))
    return rows.where("p.h is not null and coalesce(p.v, '') <> ''").select("file_name", "batch", F.col("p.h.contest").alias("contest"), F.col("p.h.choice").alias("choice"), whole(F.col("p.v")).alias("votes"))


def read_parties(lines: DataFrame) -> DataFrame:
    """party_id and party, from lines "number, name"; a name may hold commas. Lines without a number are skipped."""
    return lines.where(F.col("value").rlike(r"^\s*\d+\s*,")).select(F.trim(F.regexp_extract("value", r"^\s*(\d+)", 1)).cast("int").alias("party_id"), F.trim(F.regexp_extract("value", r"^[^,]*,(.*)$", 1)).alias("party"))


def read_kingdom(lines: DataFrame) -> DataFrame:
    """constituency, seats and votes, from lines "name; seats; votes". Other lines, as the header, are skipped."""
    c = F.split("value", ";")
    return lines.select(F.trim(c[0]).alias("constituency"), F.trim(F.get(c, F.lit(1))).try_cast("int").alias("seats"), F.trim(F.get(c, F.lit(2))).try_cast("bigint").alias("votes")).where("seats is not null and votes is not null")


def unpivot_candidates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, contest, choice and votes, from a wide table whose other headings are "contest - choice"."""
    wide = [c for c in rows.columns if c not in keys and " - " in c]
    pairs = F.array(*[F.struct(F.lit(c.rsplit(" - ", 1)[0].strip()).alias("contest"), F.lit(c.rsplit(" - ", 1)[1].strip()).alias("choice"), whole(F.col(f"`{c}`")).alias("votes")) for c in wide])
    return rows.select(*keys, F.inline(pairs))
