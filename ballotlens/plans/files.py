"""Queries that write the tables in the file layouts of vendors, states and counties, and read them again with the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlens.plans import base
from ballotlens.plans.base import Registry
from ballotlens.scratch import new_path, written
from ballotlens.sources import records
from ballotlens.sources import text_tables as T
from ballotlens.sources import vendor
from ballotlens.tables import table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
#: Of the cards of an export, these are shown only as sums of their style, and these not at all. By key.
GROUPED, HIDDEN = 29, 31
OLDER = vendor.Layout(4, 1, 2, 3, tuple(n for n in vendor.USUAL.names if n[0] != "counting_group"))


# --- wide vendor exports ---------------------------------------------------------------------------


def _columns(spark: SparkSession, d: str) -> DataFrame:
    """file_name, election, version and the vote columns of each county's export: its contests' candidates, in blocks by rank where they are ranked, and a write-in."""
    xv = base.cvr_votes(spark, d).select("county_id", "contest_id", "cands")
    cands = xv.select("county_id", "contest_id", F.explode("cands").alias("c")).groupBy("county_id", "contest_id").agg(F.sort_array(F.collect_set("c")).alias("cs"))
    c = xv.select("county_id", "contest_id").distinct().join(cands, ["county_id", "contest_id"], "left").join(base.contests(spark, d).select("contest_id", "vote_for", "num_ranks"), "contest_id", "left")
    cs = F.coalesce("cs", F.array().cast("array<int>"))
    k, name = F.size(cs), F.concat(F.lit("Contest "), F.col("contest_id"))
    ranked = (F.coalesce("num_ranks", F.lit(0)) > 0) & (k > 0)
    title = F.when(ranked, F.concat(name, F.lit(" (Number of positions=1, Number of ranks="), k, F.lit(")"))).otherwise(F.concat(name, F.lit(" (Vote For="), F.coalesce("vote_for", F.lit(1)), F.lit(")")))
    cell = lambda cand, choice, rank: F.struct(F.col("contest_id"), title.alias("title"), cand.cast("int").alias("cand"), choice.alias("choice"), rank.cast("int").alias("rank"))
    choice = lambda x: F.concat(F.lit("Cand "), x)
    blocks = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda r: F.transform(cs, lambda x: cell(x, choice(x), r))))
    plain = F.concat(F.transform(cs, lambda x: cell(x, choice(x), F.lit(0))), F.array(cell(F.lit(None), F.lit("Write-in"), F.lit(0))))
    per = c.select("county_id", "contest_id", F.when(ranked, blocks).otherwise(plain).alias("cols"))
    columns = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("contest_id", "cols"))), lambda s: s["cols"]))
    return per.groupBy("county_id").agg(columns.alias("columns")).select("county_id", F.concat(F.lit("county_"), "county_id").alias("file_name"), F.lit("General").alias("election"), F.lit("5.10").alias("version"), "columns")


def export_lines(spark: SparkSession, d: str, layout: vendor.Layout = vendor.USUAL) -> DataFrame:
    """file_name, line_no and value of one wide export a county, with redacted rows."""
    columns = written(_columns(spark, d), "columns")
    text = lambda c: F.col(c).cast("string")
    part = F.split("id", "-")
    fields = {"cvr_number": text("cvr_key"), "tabulator": F.get(part, F.lit(0)), "batch_id": F.get(part, F.lit(1)), "record_id": F.get(part, F.lit(2)), "imprinted_id": F.col("id"), "counting_group": text("counting_group"), "precinct": text("precinct"), "ballot_type": text("style_id")}
    cards = base.cvrs(spark, d).withColumn("file_name", F.concat(F.lit("county_"), "county_id")).withColumn("line_no", F.col("cvr_key") + layout.rows).withColumn("heads", F.array(*[fields[n] for n, _ in layout.names]))
    cards = cards.withColumn("fate", F.when(F.col("cvr_key") % GROUPED == 0, "group").when(F.col("cvr_key") % HIDDEN == 0, "hidden").otherwise("shown"))
    out = vendor.write_wide(cards.where("fate = 'shown'").select("file_name", "line_no", "heads", "votes"), columns, layout)
    quoted = lambda heads: F.array_join(F.transform(heads, lambda x: F.concat(F.lit('"'), F.coalesce(x, F.lit("")), F.lit('"'))), ",")
    sized = columns.select("file_name", "columns", F.size("columns").alias("n"))
    hidden = cards.where("fate = 'hidden'").join(sized, "file_name").select("file_name", "line_no", F.concat(quoted("heads"), F.repeat(F.lit(",X"), F.col("n"))).alias("value"))
    marks = cards.where("fate = 'group'").select("county_id", F.coalesce(F.col("style_id").cast("string"), F.lit("")).alias("style_id"), "cvr_key", F.explode("votes").alias("contest_id", "cands"))
    counts = marks.select("county_id", "style_id", "contest_id", F.explode(F.array_distinct("cands")).alias("cand")).groupBy("county_id", "style_id", "contest_id", "cand").agg(F.count("*").alias("n"))
    counts = counts.groupBy("county_id", "style_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("contest_id", "cand").alias("k"), "n"))).alias("counts"))
    sums = marks.groupBy("county_id", "style_id").agg(F.min("cvr_key").alias("cvr_key"), F.collect_set("contest_id").alias("on")).join(counts, ["county_id", "style_id"], "left").withColumn("file_name", F.concat(F.lit("county_"), "county_id"))
    none = F.create_map().cast("map<struct<contest_id:int,cand:int>,bigint>")
    count = lambda c: F.when((c["rank"] > 0) | ~F.array_contains("on", c["contest_id"]), "").otherwise(F.coalesce(F.try_element_at(F.coalesce("counts", none), F.struct(c["contest_id"].alias("contest_id"), c["cand"].alias("cand"))), F.lit(0)).cast("string"))
    heads = F.array(*[F.lit("Redacted and aggregated") if i == 0 else F.col("style_id") if n == "ballot_type" else F.lit("") for i, (n, _) in enumerate(layout.names)])
    groups = sums.join(sized, "file_name").select("file_name", (F.col("cvr_key") + layout.rows).alias("line_no"), F.concat_ws(",", quoted(heads), F.array_join(F.transform("columns", count), ",")).alias("value"))
    return written(out.unionByName(hidden).unionByName(groups), "export")


def _read(spark: SparkSession, d: str, layout: vendor.Layout = vendor.USUAL) -> tuple[DataFrame, DataFrame]:
    lines = export_lines(spark, d, layout)
    meaning = written(vendor.wide_meaning(lines, layout), "meaning")
    return vendor.wide_rows(lines, meaning, layout), meaning


def _numbered(votes: DataFrame, meaning: DataFrame) -> DataFrame:
    """Votes with the contest's number and name, vote_for, ranks, and choices."""
    c = vendor.contest_names(meaning)
    return votes.join(c, ["file_name", "contest"]).withColumn("contest_id", F.regexp_extract("name", r"(\d+)$", 1).cast("int"))


def _votes(spark: SparkSession, d: str, ranked: bool) -> DataFrame:
    rows, meaning = _read(spark, d)
    v = _numbered(vendor.wide_votes(rows, ["file_name", "cvr_number"]), meaning).where("ranks > 0" if ranked else "ranks = 0")
    ids = F.transform("cands", lambda i: F.regexp_extract(F.get("choices", i - 1), r"(\d+)$", 1))
    return v.select("file_name", F.col("cvr_number").cast("bigint").alias("cvr_number"), "contest_id", F.array_join(ids, " ").alias("cands"))


_WIDE = """, has as (select distinct county_id, contest_id from xv where len(cands) > 0),
 wide as (select 'county_' || xv.county_id as file_name, cvr_key as cvr_number, xv.contest_id, cands, coalesce(m.num_ranks, 0) > 0 and h.contest_id is not null as ranked from xv left join contests m on m.contest_id = xv.contest_id left join has h on h.county_id = xv.county_id and h.contest_id = xv.contest_id where cvr_key % 29 <> 0 and cvr_key % 31 <> 0)"""


@R.add(_WIDE + " select file_name, cvr_number, contest_id, array_to_string(list_sort(list_distinct(cands)), ' ') as cands from wide where not ranked")
def vendor_regular_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes of contests without ranks, read from wide exports."""
    return _votes(spark, d, False)


@R.add(_WIDE + " select file_name, cvr_number, contest_id, array_to_string(list_filter(cands, lambda c, i: list_position(cands, c) = i), ' ') as cands from wide where ranked")
def vendor_irv_votes(spark: SparkSession, d: str) -> DataFrame:
    """Rankings, read from the blocks of a wide export."""
    return _votes(spark, d, True)


_FIELDS = "split_part(id, '-', 1) as tabulator, split_part(id, '-', 2) as batch_id, split_part(id, '-', 3) as record_id, id as imprinted_id, precinct::varchar as precinct, style_id::varchar as ballot_type, len(map_keys(votes))::int as n_contests"


def _records(spark: SparkSession, d: str, layout: vendor.Layout) -> DataFrame:
    rows, _ = _read(spark, d, layout)
    n = F.size(F.array_distinct(F.transform(vendor._paired(), lambda p: p["m"]["contest"])))
    return rows.where("why is null").select("file_name", F.col("cvr_number").cast("bigint").alias("cvr_number"), *[n_ for n_, _ in layout.names[1:]], n.alias("n_contests"))


@R.add(f"select 'county_' || county_id as file_name, cvr_key as cvr_number, counting_group::varchar as counting_group, {_FIELDS} from cvrs where cvr_key % 29 <> 0 and cvr_key % 31 <> 0")
def scan_vendor_csv(spark: SparkSession, d: str) -> DataFrame:
    """The records of wide exports with four header rows, found by their headings; redacted rows are set apart."""
    return _records(spark, d, vendor.USUAL)


@R.add(f"select 'county_' || county_id as file_name, cvr_key as cvr_number, counting_group::varchar as counting_group, {_FIELDS} from cvrs where cvr_key % 29 <> 0 and cvr_key % 31 <> 0")
def scan_vendor_garfield(spark: SparkSession, d: str) -> DataFrame:
    """The same in the layout without a line for the election, whose headings share the choices' row and have other names."""
    return _records(spark, d, vendor.BOXES)


_GROUPS = """, grp as (select county_id, style_id, contest_id, unnest(list_distinct(cands)) as cand from xv where cvr_key % 29 = 0), has as (select distinct county_id, contest_id from xv where len(cands) > 0),
 grouped as (select county_id, style_id, contest_id, cand, count(*) as nvotes from grp join has using (county_id, contest_id) left join (select contest_id as k, num_ranks from contests) m on m.k = contest_id where coalesce(num_ranks, 0) = 0 group by all)"""


@R.add(_GROUPS + " select 'county_' || county_id as file_name, style_id::varchar as ballot_type, contest_id, cand, nvotes from grouped")
def scan_boulder_csv(spark: SparkSession, d: str) -> DataFrame:
    """The redacted groups of the older layout without a counting group: summed votes of each ballot type."""
    rows, meaning = _read(spark, d, OLDER)
    v = _numbered(vendor.redacted_groups(rows, ["file_name", "ballot_type"]), meaning).where("nvotes > 0")
    cand = F.regexp_extract(F.get("choices", F.col("cand") - 1), r"(\d+)$", 1).cast("int")
    return v.select("file_name", "ballot_type", "contest_id", cand.alias("cand"), "nvotes")


@R.add(_GROUPS + " select 'county_' || county_id as file_name, style_id::varchar as ballot_type, max(ceil(v / f))::bigint as min_cards from (select county_id, style_id, contest_id, sum(nvotes) as v, max(coalesce(vote_for, 1)) as f from grouped left join (select contest_id, vote_for from contests) using (contest_id) group by all) group by all")
def redacted_merge(spark: SparkSession, d: str) -> DataFrame:
    """The least number of cards in each redacted group, by its summed votes and how many each contest allows."""
    rows, meaning = _read(spark, d)
    v = _numbered(vendor.redacted_groups(rows, ["file_name", "ballot_type"]), meaning)
    per = v.groupBy("file_name", "ballot_type", "contest_id").agg(F.sum("nvotes").alias("v"), F.max("vote_for").alias("f"))
    return per.where("v > 0").groupBy("file_name", "ballot_type").agg(F.max(F.ceil(F.col("v") / F.col("f"))).cast("bigint").alias("min_cards"))


@R.add(", fates as (select case when cvr_key % 29 = 0 then 'Redacted' when cvr_key % 31 = 0 then 'x' end as why, county_id, style_id, cvr_key, votes from cvrs) select why, count(*) as n from fates where why is null or why = 'x' group by all union all select 'Redacted', count(distinct (county_id, style_id)) from fates where why = 'Redacted' and cardinality(votes) > 0")
def vendor_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Rows by why they are redacted (most are not), judged by the first cell and the first vote cell, which the header tells."""
    return _read(spark, d)[0].groupBy("why").agg(F.count("*").alias("n"))


@R.add(r"""select line_id, cell, count(*) as n from (select line_id, case when x like '=%' then regexp_replace(x, '[="]', '', 'g') else x end as cell from (select line_id, unnest(regexp_extract_all(',' || regexp_replace(line, '\r?\n?$', ''), ',(=?"(?:[^"]|"")*"|[^",]*)', 1)) as x from (select distinct line_id, line from raw_cvr_lines))) group by all""")
def vendor_leading_equals(spark: SparkSession, d: str) -> DataFrame:
    """All cells of all lines, an equal sign and quotes at their beginning removed."""
    lines = table(spark, d, "raw_cvr_lines", "line_id", "line").distinct()
    return lines.select("line_id", F.explode(vendor.raw_cells(F.col("line"))).alias("x")).groupBy("line_id", vendor.leading_equals(F.col("x")).alias("cell")).agg(F.count("*").alias("n"))


_CASE = _GROUPS + """, pool_size as (select county_id, style_id, max(ceil(v / f)) as n from (select county_id, style_id, contest_id, sum(nvotes) as v, max(coalesce(vote_for, 1)) as f from grouped left join (select contest_id, vote_for from contests) using (contest_id) group by all) group by all),
 shown as (select 'county_' || county_id as file_name, contest_id, sum(len(list_distinct(cands)))::bigint as v, count(*) as n from xv where cvr_key % 29 <> 0 and cvr_key % 31 <> 0 group by all),
 pooled as (select 'county_' || g.county_id as file_name, contest_id, sum(v)::bigint as v, sum(n)::bigint as n from (select county_id, style_id, contest_id, sum(nvotes) as v from grouped group by all) g join pool_size p on p.county_id is not distinct from g.county_id and p.style_id is not distinct from g.style_id group by all)"""


def _pooled_case(spark: SparkSession, d: str) -> DataFrame:
    """file_name, contest_id and, of its cards outside pools (source cvr) and of the cards made for redacted groups (pool): cards and votes.

    A group has the fewest cards that hold its votes; votes are laid out on them so that the group's totals come out."""
    from ballotlens.operators import simulate

    rows, meaning = _read(spark, d)
    shown = _numbered(vendor.wide_votes(rows, ["file_name", "line_no"]), meaning).groupBy("file_name", "contest_id").agg(F.count("*").alias("ncards"), F.sum(F.size("cands")).alias("nvotes"))
    groups = written(_numbered(vendor.redacted_groups(rows, ["file_name", "ballot_type"]), meaning).where("nvotes > 0"), "groups").withColumn("pool", F.concat_ws("/", "file_name", F.coalesce("ballot_type", F.lit(""))))
    per = groups.groupBy("file_name", "pool", "contest_id").agg(F.sum("nvotes").alias("v"), F.max("vote_for").alias("f"))
    size = per.groupBy("pool").agg(F.max(F.ceil(F.col("v") / F.col("f"))).cast("int").alias("n"))
    places = per.join(size, "pool").select("file_name", "pool", "contest_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("card_key"))
    made = simulate.simulate_pool(places.select("pool", "contest_id", "card_key"), groups.select("pool", "contest_id", "cand", "nvotes"), 7, ("pool", "contest_id"))
    made = made.groupBy("pool", "contest_id").agg(F.countDistinct("card_key").alias("ncards"), F.count("cand").alias("nvotes"))
    pooled = made.join(per.select("file_name", "pool", "contest_id"), ["pool", "contest_id"]).groupBy("file_name", "contest_id").agg(F.sum("ncards").alias("ncards"), F.sum("nvotes").alias("nvotes"))
    return shown.select("file_name", "contest_id", F.lit("cvr").alias("source"), "ncards", "nvotes").unionByName(pooled.select("file_name", "contest_id", F.lit("pool").alias("source"), "ncards", "nvotes"))


@R.add(_CASE + """, sov as (select 'county_' || county_id as file_name, contest_id, sum(coalesce(try_cast(replace(trim(total_votes), ',', '') as bigint), 0))::bigint as sov_votes from (select distinct county_id, contest_id, choice_no, total_votes from summary_official) group by all)
 select coalesce(s.file_name, p.file_name) as file_name, coalesce(s.contest_id, p.contest_id) as contest_id, coalesce(s.v, 0)::bigint as cvr_votes, coalesce(p.v, 0)::bigint as pool_votes, coalesce(s.n, 0)::bigint as cvr_cards, coalesce(p.n, 0)::bigint as pool_cards, sov_votes
 from shown s full join pooled p on p.file_name = s.file_name and p.contest_id = s.contest_id left join sov on sov.file_name = coalesce(s.file_name, p.file_name) and sov.contest_id = coalesce(s.contest_id, p.contest_id)""")
def boulder_case(spark: SparkSession, d: str) -> DataFrame:
    """A county's contests from its export and its official summary: votes and cards of records, votes and cards made for the redacted groups (their totals are the groups'), and official votes."""
    c = _pooled_case(spark, d)
    of = lambda source, what: F.sum(F.when(F.col("source") == source, F.col(what)).otherwise(0))
    per = c.groupBy("file_name", "contest_id").agg(of("cvr", "nvotes").alias("cvr_votes"), of("pool", "nvotes").alias("pool_votes"), of("cvr", "ncards").alias("cvr_cards"), of("pool", "ncards").alias("pool_cards"))
    sov = table(spark, d, "summary_official", "county_id", "contest_id", "choice_no", "total_votes").distinct().groupBy(F.concat(F.lit("county_"), "county_id").alias("file_name"), "contest_id").agg(F.sum(F.coalesce(F.regexp_replace(F.trim("total_votes"), ",", "").try_cast("bigint"), F.lit(0))).alias("sov_votes"))
    return per.join(sov, ["file_name", "contest_id"], "left")


@R.add(_CASE + """, strata as (select file_name, sum(n)::bigint as npop from (select 'county_' || county_id as file_name, count(*) as n from cvrs where cvr_key % 29 <> 0 and cvr_key % 31 <> 0 group by all union all select 'county_' || county_id, sum(n) from pool_size group by all) group by all)
 select contest_id, sum(coalesce(s.n, 0) + coalesce(p.n, 0))::bigint as ncards, sum(coalesce(s.v, 0) + coalesce(p.v, 0))::bigint as nvotes, sum(npop)::bigint as npop from shown s full join pooled p using (file_name, contest_id) join strata using (file_name) group by contest_id""")
def county_with_cvrs(spark: SparkSession, d: str) -> DataFrame:
    """The exports of all counties as one election: cards and votes of each contest, records and redacted groups together; its population is all cards of its counties, as in a uniform audit."""
    rows, meaning = _read(spark, d)
    c = written(_pooled_case(spark, d), "case")
    v = _numbered(vendor.redacted_groups(rows, ["file_name", "ballot_type"]), meaning).where("nvotes > 0")
    per = v.groupBy("file_name", "ballot_type", "contest_id").agg(F.sum("nvotes").alias("v"), F.max("vote_for").alias("f")).groupBy("file_name", "ballot_type").agg(F.max(F.ceil(F.col("v") / F.col("f"))).cast("bigint").alias("n"))
    strata = rows.where("why is null").groupBy("file_name").agg(F.count("*").alias("n")).unionByName(per.groupBy("file_name").agg(F.sum("n").alias("n"))).groupBy("file_name").agg(F.sum("n").alias("npop"))
    one = c.groupBy("file_name", "contest_id").agg(F.sum("ncards").alias("ncards"), F.sum("nvotes").alias("nvotes")).join(strata, "file_name")
    return one.groupBy("contest_id").agg(F.sum("ncards").alias("ncards"), F.sum("nvotes").alias("nvotes"), F.sum("npop").alias("npop"))


# --- state and county files ------------------------------------------------------------------------


def _as_csv(df: DataFrame, name: str, **options) -> str:
    path = new_path(df.sparkSession, name)
    df.write.option("header", True).option("quote", '"').option("escape", '"').options(**options).csv(path)
    return path


@R.add(""", r as (select contest_id, min(winner_votes - loser_votes)::bigint as min_margin from asn group by all)
 select 'Contest, ' || contest_id as contest_name, case when contest_id % 5 = 0 then 'state_wide_contest' else 'county_wide_contest' end as audit_reason, vote_for::bigint as winners_allowed, npop::bigint as ballot_card_count, nc::bigint as contest_ballot_card_count, min_margin, 0.03::double as risk_limit, 1.03905::double as gamma, (npop // 2)::bigint as optimistic_samples, npop::bigint as estimated_samples
 from r join totals using (contest_id) join contests using (contest_id)""")
def scan_round_contest(spark: SparkSession, d: str) -> DataFrame:
    """A state's file of the contests of a round: whole numbers with separators, winners in quotes, headings in another order."""
    r = base.assertions(spark, d).groupBy("contest_id").agg(F.min(F.col("winner_votes") - F.col("loser_votes")).alias("min_margin")).join(base.totals(spark, d), "contest_id").join(base.contests(spark, d).select("contest_id", "vote_for"), "contest_id")
    comma = lambda c: F.format_number(c, 0)
    out = r.select(
        F.concat(F.lit("Contest, "), "contest_id").alias("contest_name"), F.when(F.col("contest_id") % 5 == 0, "state_wide_contest").otherwise("county_wide_contest").alias("audit_reason"), F.lit("in_progress").alias("random_audit_status"),
        F.col("vote_for").alias("winners_allowed"), comma("npop").alias("ballot_card_count"), comma("nc").alias("contest_ballot_card_count"), F.lit('"Ann, B"').alias("winners"), comma("min_margin").alias("min_margin"), F.lit("0.03000000").alias("risk_limit"),
        F.lit("1.03905000").alias("gamma"), F.expr("npop div 2").alias("optimistic_samples_to_audit"), F.col("npop").alias("estimated_samples_to_audit"))
    return T.read_named(spark, _as_csv(out, "round-contest", encoding="ISO-8859-1"), T.ROUND_CONTEST, "ISO-8859-1")


@R.add("select 'County ' || county_id as county_name, 'Contest ' || contest_id as contest_name, 'Cand ' || cand as choice, count(*) as votes from (select county_id, contest_id, unnest(cands) as cand from xv) group by all")
def scan_county_tabulate(spark: SparkSession, d: str) -> DataFrame:
    """Votes per county, contest and choice from a state's tabulation; a choice that comes on several lines has their sum."""
    v = base.cvr_votes(spark, d).select("county_id", "contest_id", F.explode("cands").alias("c")).groupBy("county_id", "contest_id", "c").agg(F.count("*").alias("votes"))
    halves = v.select("*", F.explode(F.array(F.expr("votes div 2"), F.expr("votes - votes div 2"))).alias("part"))
    out = halves.select(F.concat(F.lit("County "), "county_id").alias("county_name"), F.concat(F.lit("Contest "), "contest_id").alias("contest_name"), F.concat(F.lit(" Cand "), "c").alias("choice"), F.col("part").alias("votes"))
    rows = T.read_named(spark, _as_csv(out, "tabulation"), T.COUNTY_TABULATION, "ISO-8859-1")
    return rows.groupBy("county_name", "contest_name", F.trim("choice").alias("choice")).agg(F.sum("votes").alias("votes"))


_MVR = """, lines as (select card_key, county_id, contest_id, contest_id % 5 = 0 as wide from pairs), cards2 as (select card_key, bool_or(wide) as statewide from lines group by all)"""


def _comparison(spark: SparkSession, d: str) -> DataFrame:
    p = base.pairs(spark, d)
    text = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), " "), F.lit("blank"))
    out = p.select(
        F.concat(F.lit("County "), "county_id").alias("county_name"), F.concat(F.lit("Contest "), "contest_id").alias("contest_name"), F.col("card_key").cast("string").alias("imprinted_id"), F.col("style_id").alias("ballot_type"), text("cands").alias("choice_per_voting_computer"), text("mvr").alias("audit_board_selection"),
        F.lit("YES").alias("consensus"), F.lit("uploaded").alias("record_type"), F.lit("a, b").alias("audit_board_comment"), F.lit("2031").alias("timestamp"), F.col("card_key").alias("cvr_id"), F.when(F.col("contest_id") % 5 == 0, "STATE_WIDE_CONTEST").otherwise("COUNTY_WIDE_CONTEST").alias("audit_reason"))
    return T.read_named(spark, _as_csv(out, "comparison"), T.MVR_COMPARISON, "ISO-8859-1")


@R.add(_MVR + " select 'Contest ' || contest_id as contest_name, count(*) filter (not statewide) as n_mvrs, count(*) filter (statewide) as n_statewide from lines join cards2 using (card_key) group by all")
def scan_mvr_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Cards read by hand per contest, from the comparison file: a card is statewide if any of its lines is."""
    lines = _comparison(spark, d).withColumn("wide", F.col("audit_reason") == "STATE_WIDE_CONTEST")
    cards = lines.groupBy("cvr_id").agg(F.bool_or("wide").alias("statewide"))
    return lines.join(cards, "cvr_id").groupBy("contest_name").agg(F.count_if(~F.col("statewide")).alias("n_mvrs"), F.count_if("statewide").alias("n_statewide"))


@R.add(", per as (select 'County ' || min(county_id) as county_name, card_key, array_to_string(list_sort(list('Contest ' || contest_id)), '|') as contests from pairs group by card_key) select county_name, contests, count(*) as ncards from per group by all")
def county_styles_from_mvrs(spark: SparkSession, d: str) -> DataFrame:
    """Styles of each county as the cards read by hand show them: the sets of contests on a card."""
    per = _comparison(spark, d).groupBy("cvr_id").agg(F.min("county_name").alias("county_name"), F.array_join(F.sort_array(F.collect_list("contest_name")), "|").alias("contests"))  # the contests of one card
    return per.groupBy("county_name", "contests").agg(F.count("*").alias("ncards"))


@R.add(", c as (select distinct county_id, contest_id, unnest(cands) as cand from xv) select 'County ' || county_id as county_name, 'Contest ' || contest_id as contest_name, 'Cand ' || cand as choice from c")
def scan_canonical_list(spark: SparkSession, d: str) -> DataFrame:
    """A state's canonical list: the choices of each contest in one cell."""
    c = base.cvr_votes(spark, d).select("county_id", "contest_id", F.explode("cands").alias("c")).distinct()
    out = c.groupBy("county_id", "contest_id").agg(F.array_join(F.collect_list(F.concat(F.lit("Cand "), "c")), ", ").alias("choices")).select(F.concat(F.lit("County "), "county_id").alias("CountyName"), F.concat(F.lit("Contest "), "contest_id").alias("ContestName"), F.col("choices").alias("ContestChoices"))
    return T.canonical_choices(T.read_named(spark, _as_csv(out, "canonical"), T.CANONICAL_LIST))


_BATCH = """, b as (select county_id, coalesce(precinct, 0) as batch, contest_id, unnest(cands) as cand from xv), bt as (select county_id, batch, contest_id, cand, count(*) as nvotes from b group by all),
 manifest as (select county_id, coalesce(precinct, 0) as batch, count(*) as nballots from cvrs group by all)"""


def _batches(spark: SparkSession, d: str) -> DataFrame:
    """county, batch, nballots, contest, cand and nvotes, read from each county's batch manifest and wide file of candidate totals."""
    xv = base.cvr_votes(spark, d).withColumn("batch", F.coalesce("precinct", F.lit(0)))
    counts = xv.select("county_id", "batch", "contest_id", F.explode("cands").alias("cand")).groupBy("county_id", "batch", "contest_id", "cand").agg(F.count("*").alias("n"))
    heads = counts.select("county_id", "contest_id", "cand").distinct().groupBy("county_id").agg(F.array_sort(F.collect_list(F.struct("contest_id", "cand"))).alias("heads"))
    title = lambda h: F.concat(F.lit('"Contest, No. '), h["contest_id"], F.lit(" - Cand "), h["cand"], F.lit('"'))
    county = F.concat(F.lit("county_"), "county_id").alias("file_name")
    header = heads.select(county, F.lit(1).cast("bigint").alias("line_no"), F.concat(F.lit("Batch Name,"), F.array_join(F.transform("heads", title), ","), F.lit(",")).alias("value"))  # a comma at the end
    per = counts.groupBy("county_id", "batch").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("contest_id", "cand").alias("k"), "n"))).alias("m"))
    cell = lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0)).cast("string")
    batch = F.col("batch").cast("bigint")
    line = F.when(batch < 0, -2 * batch + 1).otherwise(2 * batch) + 2  # a line of its own, never the header's, also below 0
    body = per.join(heads, "county_id").select(county, line.alias("line_no"), F.concat(F.lit('"Batch, '), "batch", F.lit('",'), F.array_join(F.transform("heads", cell), ","), F.lit(",")).alias("value"))
    totals = T.read_batch_totals(header.unionByName(body))
    manifest = base.cvrs(spark, d).groupBy("county_id", F.coalesce("precinct", F.lit(0)).alias("batch")).agg(F.count("*").alias("n"))
    lines = manifest.select(F.concat(F.lit("county_"), "county_id").alias("file_name"), F.concat(F.lit('in person,"Batch, '), "batch", F.lit('", '), "n").alias("value"))
    return T.read_batch_manifest(lines).join(totals, ["file_name", "batch"])


@R.add(_BATCH + " select 'county_' || county_id as file_name, 'Batch ' || batch as batch, nballots, 'Contest No. ' || contest_id as contest, 'Cand ' || cand as choice, nvotes as votes from bt join manifest using (county_id, batch)")
def scan_ga_batches(spark: SparkSession, d: str) -> DataFrame:
    """Votes of each batch by contest and choice, beside the batch's ballots."""
    return _batches(spark, d).where("votes > 0").select("file_name", "batch", "nballots", "contest", "choice", "votes")


@R.add(_BATCH + " select 'Contest No. ' || contest_id as contest, 'Cand ' || cand as choice, sum(nvotes)::bigint as votes, count(*) as n_batches from bt group by all")
def ga_batch_totals(spark: SparkSession, d: str) -> DataFrame:
    """Batches summed to contests."""
    return _batches(spark, d).where("votes > 0").groupBy("contest", "choice").agg(F.sum("votes").alias("votes"), F.count("*").alias("n_batches"))


@R.add(_BATCH + """, cv2 as (select contest_id, cand, sum(nvotes) as v from bt group by all), ct as (select contest_id, cand, row_number() over (partition by contest_id order by v desc, cand desc) as place, v / sum(v) over (partition by contest_id) as share from cv2),
 on_it as (select contest_id, cand from ct t where place <= 2 and (select max(share) from ct x where x.contest_id = t.contest_id) < 0.5)
 select 'county_' || county_id || '/Batch ' || batch as pool, 'Contest No. ' || contest_id as contest, 'Cand ' || cand as choice, nballots, nvotes as votes from bt join manifest using (county_id, batch) join on_it using (contest_id, cand)""")
def ga_case(spark: SparkSession, d: str) -> DataFrame:
    """One pool for each batch of each county, for contests in which nobody has half the votes: the pool's votes of the two who advance."""
    from ballotlens.operators import outcome

    b = written(_batches(spark, d).where("votes > 0"), "batches")
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("int")
    tab = b.groupBy("contest", "choice").agg(F.sum("votes").alias("nvotes")).select(number("contest").alias("contest_id"), number("choice").alias("cand"), "contest", "choice", "nvotes")
    going = outcome.runoff(tab).where("status = 'advances'").select("contest", "choice")
    return b.join(going, ["contest", "choice"]).select(F.concat_ws("/", "file_name", "batch").alias("pool"), "contest", "choice", "nballots", "votes")


@R.add(", v as (select county_id, contest_id, cand, count(*) as n from (select county_id, contest_id, unnest(cands) as cand from xv) group by all) select county_id::varchar as county, contest_id, 'D' || cand as detail_id, 'Cand ' || cand as detail_name, case when contest_id % 7 = 0 then 0 else n end as org_count, case when contest_id % 7 = 0 then 0 else n + cand % 2 end::bigint as audit_count, case when contest_id % 7 = 0 then 0 else cand % 2 end::bigint as diff_count from v")
def scan_ga_image_audit(spark: SparkSession, d: str) -> DataFrame:
    """A county comparison of results with a second reading of images; rows without counts have none."""
    v = base.cvr_votes(spark, d).select("county_id", "contest_id", F.explode("cands").alias("cand")).groupBy("county_id", "contest_id", "cand").agg(F.count("*").alias("n"))
    some = lambda c: F.when(F.col("contest_id") % 7 != 0, c)
    out = v.select(F.concat(F.col("county_id"), F.lit(" County")).alias("County"), F.col("contest_id").alias("Contest Id"), F.lit("x").alias("Contest"), F.concat(F.lit(" D"), "cand").alias("Detail Id"), F.concat(F.lit(" Cand "), "cand").alias("Detail"), some(F.col("n")).alias("Original Count"), some(F.col("n") + F.col("cand") % 2).alias("Audit Count"), some(F.col("cand") % 2).alias("Difference"))
    return T.image_audit(T.read_named(spark, _as_csv(out, "image-audit"), T.IMAGE_AUDIT))


@R.add(", s as (select contest_id, count(*) as ncards, count(*) filter (len(cands) = 0) as blanks, count(*) filter (len(cands) > vote_for) as overvotes, sum(greatest(vote_for - len(cands), 0))::bigint as undervotes from xv join contests using (contest_id) group by all) select contest_id, ncards, undervotes, overvotes, blanks from s")
def scan_summary_xml(spark: SparkSession, d: str) -> DataFrame:
    """Summaries in XML, one element for each contest; here four documents, each a file with one root."""
    v = base.cvr_votes(spark, d).join(base.contests(spark, d).select("contest_id", "vote_for"), "contest_id")
    n = F.size("cands")
    s = v.groupBy("contest_id").agg(F.count("*").alias("ncards"), F.count_if(n == 0).alias("blanks"), F.count_if(n > F.col("vote_for")).alias("overvotes"), F.sum(F.greatest(F.col("vote_for") - n, F.lit(0))).alias("undervotes"))
    line = F.format_string('<contest id="%d" ballotsCast="%d" undervotes="%d" overvotes="%d" blanks="%d"></contest>', "contest_id", "ncards", "undervotes", "overvotes", "blanks")
    path = new_path(spark, "xml")
    docs = s.groupBy((F.col("contest_id") % 4).alias("part")).agg(F.concat(F.lit("<summary>"), F.array_join(F.collect_list(line), ""), F.lit("</summary>")).alias("value"))
    docs.write.partitionBy("part").text(path)
    return records.read_summary_xml(spark, path)


@R.add("select 'Contest ' || contest_id as constituency, 'Party ' || cand as party, nvotes as votes from tab")
def scan_belgium(spark: SparkSession, d: str) -> DataFrame:
    """Party lists as a JSON document for each constituency."""
    lists = base.card_tab(spark, d).groupBy("contest_id").agg(F.collect_list(F.struct(F.concat(F.lit("Party "), "cand").alias("party"), F.col("nvotes").alias("votes"), F.lit(0).alias("seats"))).alias("lists"))
    return records.read_party_lists(spark, _json(lists.select(F.concat(F.lit("Contest "), "contest_id").alias("name"), "lists"), "lists"), False).drop("seats")


@R.add("select contest_id as party_id, 'Party, ' || contest_id as party from contests")
def scan_belgium_parties(spark: SparkSession, d: str) -> DataFrame:
    """A list of parties as text: number, name."""
    return T.read_parties(base.contests(spark, d).select(F.concat(F.col("contest_id"), F.lit(", Party, "), F.col("contest_id")).alias("value")))


@R.add("select 'Contest ' || contest_id as constituency, max(vote_for)::int as seats, sum(nvotes)::bigint as votes from tab join contests using (contest_id) group by contest_id")
def scan_belgium_kingdom(spark: SparkSession, d: str) -> DataFrame:
    """Seats and votes of each constituency as text with semicolons."""
    t = base.card_tab(spark, d).groupBy("contest_id").agg(F.sum("nvotes").alias("v")).join(base.contests(spark, d).select("contest_id", "vote_for"), "contest_id")
    return T.read_kingdom(t.select(F.format_string("Contest %d; %d ; %d", "contest_id", "vote_for", "v").alias("value")))


# --- records as JSON, archives ---------------------------------------------------------------------


def _json(df: DataFrame, name: str) -> str:
    """Each row as a JSON document on a line of its own."""
    path = new_path(df.sparkSession, name)
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
    return path


@R.add("select contest_id, vote_for, num_ranks, description, null::int as candidate_id from contests union all select contest_id, null, null, description, candidate_id from (select distinct contest_id, candidate_id, description from candidate_manifest)")
def scan_manifests_json(spark: SparkSession, d: str) -> DataFrame:
    """Contest and candidate manifests, each a JSON document with a list."""
    c = base.contests(spark, d).select(F.col("description").alias("Description"), F.col("contest_id").alias("Id"), F.col("vote_for").alias("VoteFor"), F.col("num_ranks").alias("NumOfRanks"))
    k = table(spark, d, "candidate_manifest", "contest_id", "candidate_id", "description").distinct().select(F.col("description").alias("Description"), F.col("candidate_id").alias("Id"), F.col("contest_id").alias("ContestId"))
    as_list = lambda df, key: df.groupBy((F.col(key) % 16).alias("part")).agg(F.collect_list(F.struct(*df.columns)).alias("List")).drop("part")
    a = records.read_manifest(spark, _json(as_list(c, "Id"), "contest-manifest"), records.CONTEST_MANIFEST).select(F.col("Id").alias("contest_id"), F.col("VoteFor").alias("vote_for"), F.col("NumOfRanks").alias("num_ranks"), F.col("Description").alias("description"), F.lit(None).cast("int").alias("candidate_id"))
    b = records.read_manifest(spark, _json(as_list(k, "Id"), "candidate-manifest"), records.CANDIDATE_MANIFEST).select(F.col("ContestId").alias("contest_id"), F.lit(None).cast("int").alias("vote_for"), F.lit(None).cast("int").alias("num_ranks"), F.col("Description").alias("description"), F.col("Id").alias("candidate_id"))
    return a.unionByName(b)


@R.add(" select contest_id, vote_for, num_ranks > 0 as ranked, nc::int as nc, ncast::int as ncast, npop::int as npop, cand, nvotes from totals join contests using (contest_id) join tab using (contest_id)")
def scan_contests_json(spark: SparkSession, d: str) -> DataFrame:
    """Contests with their votes as JSON, told apart by class."""
    votes = base.card_tab(spark, d).groupBy("contest_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("cand").cast("string"), F.col("nvotes").cast("int")))).alias("votes"))
    c = base.totals(spark, d).join(base.contests(spark, d), "contest_id").join(votes, "contest_id")
    info = F.struct(F.col("description").alias("name"), F.col("contest_id").alias("id"), F.when(F.col("num_ranks") > 0, "IRV").otherwise("PLURALITY").alias("choiceFunction"), F.col("vote_for").alias("nwinners"), F.col("vote_for").alias("voteForN"))
    doc = c.select(F.when(F.col("num_ranks") > 0, "IrvContest").otherwise("Contest").alias("className"), info.alias("info"), "votes", F.col("nc").cast("int").alias("Nc"), F.col("ncast").cast("int").alias("Ncast"), F.col("npop").cast("int").alias("Npop"))
    r = records.read_contests(spark, _json(doc, "contests"))
    return r.select("contest_id", "vote_for", "ranked", "nc", "ncast", "npop", F.explode("votes").alias("cand", "v")).select("contest_id", "vote_for", "ranked", "nc", "ncast", "npop", F.col("cand").cast("int").alias("cand"), F.col("v").cast("bigint").alias("nvotes"))


@R.add("select style_id, 'style' || style_id as pool_name, contest_id, ncards::int as ncards from style_contests join (select style_id, count(*) as ncards from cards group by all) using (style_id)")
def scan_styles_json(spark: SparkSession, d: str) -> DataFrame:
    """Styles as JSON documents with lists."""
    s = base.card_votes(spark, d).groupBy("style_id").agg(F.collect_set("contest_id").alias("possibleContests")).join(base.cards(spark, d).groupBy("style_id").agg(F.count("*").cast("int").alias("ncards")), "style_id")
    doc = s.groupBy((F.col("style_id") % 8).alias("part")).agg(F.collect_list(F.struct(F.concat(F.lit("style"), "style_id", F.lit("-A.1")).alias("name"), F.col("style_id").alias("id"), "possibleContests", F.lit(True).alias("hasExactContests"), "ncards")).alias("batches")).drop("part")
    return records.read_styles(spark, _json(doc, "styles"), False).select("style_id", "pool_name", F.explode("possible_contests").alias("contest_id"), "ncards")


@R.add("select county_id::bigint as round, p.pos::int as place, prn from (select county_id, row_number() over (partition by county_id order by prn) - 1 as pos, prn from cards where prn is not null) p where pos < 20")
def scan_prns_json(spark: SparkSession, d: str) -> DataFrame:
    """Stored samples as JSON: hexadecimal numbers in order; here the first twenty of each county, one document each."""
    from pyspark.sql import Window

    first = base.cards(spark, d).where("prn is not null").withColumn("k", F.row_number().over(Window.partitionBy("county_id").orderBy("prn"))).where(F.col("k") <= 20)
    doc = first.groupBy("county_id").agg(F.transform(F.array_sort(F.collect_list("prn")), lambda p: F.lower(F.conv(p.cast("string"), 10, 16))).alias("samplePrns"), F.first("county_id").cast("bigint").alias("round")).drop("county_id")
    return records.read_sample_prns(spark, _json(doc, "prns"), "round")


@R.add("select contest_id, 'PluralityAssorter' as kind, winner, loser, round(reported_margin, 9) as margin, round(noerror, 9) as noerror from asn")
def scan_assertions_json(spark: SparkSession, d: str) -> DataFrame:
    """Assertions with their assorters as JSON, told apart by class."""
    a = base.assertions(spark, d)
    assorter = F.struct(F.lit("PluralityAssorter").alias("className"), "winner", "loser", F.col("reported_margin").alias("reportedMargin"), F.lit(None).cast("double").alias("t"))
    r = records.read_assertions(spark, _json(a.select("contest_id", F.struct(assorter.alias("assorter"), "noerror").alias("cassorter")), "assertions"))
    return r.select("contest_id", "kind", "winner", "loser", F.round("margin", 9).alias("margin"), F.round("noerror", 9).alias("noerror"))


@R.add("select 'General' as election, 'CLCA' as audit_type, count(*)::int as ncards, (select count(*)::int from contests) as ncontests, 0.03::double as risk_limit, 20311104::bigint as seed, [50, 80] as percentiles, 0.9::double as max_loss from cards")
def scan_election_json(spark: SparkSession, d: str) -> DataFrame:
    """What an election's and an audit's configuration say, from their JSON documents."""
    one = base.cards(spark, d).agg(F.count("*").cast("int").alias("ncards")).join(F.broadcast(base.contests(spark, d).agg(F.count("*").cast("int").alias("ncontests"))))  # one row each
    info = _json(one.select(F.lit("General").alias("electionName"), F.lit("CLCA").alias("auditType"), "ncards", "ncontests"), "election")
    creation = _json(one.select(F.lit("CLCA").alias("auditType"), F.lit(0.03).alias("riskLimit"), F.lit(format(20311104, "x")).alias("seed")), "creation")
    rounds = _json(one.select(F.struct(F.lit(20).alias("nsimEst"), F.array(F.lit(50), F.lit(80)).alias("estPercentile")).alias("simulation"), F.struct(F.lit(0.9).alias("maxLoss")).alias("clcaConfig")), "config")
    return records.read_configuration(spark, info, creation, rounds)


@R.add("select 1::int as round, contest_id, winner, loser, winner_votes::int as estimate, (winner_votes % 3 = 0) as done from asn")
def scan_rounds_json(spark: SparkSession, d: str) -> DataFrame:
    """The state of a round as JSON: contests, their assertions and results."""
    a = base.assertions(spark, d)
    per = a.groupBy("contest_id").agg(F.collect_list(F.struct("winner", "loser", F.col("winner_votes").cast("int").alias("estSampleSize"), F.struct(F.when(F.col("winner_votes") % 3 == 0, "StatRejectNull").otherwise("LimitReached").alias("status")).alias("auditResult"))).alias("assertionRounds"))
    doc = per.groupBy((F.col("contest_id") % 8).alias("part")).agg(F.lit(1).alias("roundIdx"), F.collect_list(F.struct(F.col("contest_id").alias("id"), "assertionRounds")).alias("contestRounds")).drop("part")
    return records.read_rounds(spark, _json(doc, "rounds"))


_MARKS = "list_sum(list_transform(map_values(votes), lambda v: len(v)))::bigint"


@R.add(f"select id, location, card_index, prn, phantom, style_id, pool_id, cardinality(votes)::bigint as n_contests, {_MARKS} as n_marks from cards")
def scan_card_csv_zip(spark: SparkSession, d: str) -> DataFrame:
    """The card manifest in zip archives, written and read again."""
    path = new_path(spark, "zip")
    records.write_zip(T.write_cards(base.cards(spark, d)), path, "cards.csv")
    rows = T.read_cards(records.unzip_lines(spark, f"{path}/*.zip"))
    return rows.select("id", "location", "card_index", "prn", "phantom", "style_id", "pool_id", F.size("votes").cast("bigint").alias("n_contests"), F.aggregate(F.map_values("votes"), F.lit(0).cast("bigint"), lambda a, v: a + F.size(v)).alias("n_marks"))


@R.add("select count(*) as n_lines, sum(length(county_id::varchar || ',' || card_key))::bigint as n_chars from cards")
def sink_zip(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as zip archives, as many as partitions, and read again."""
    path = new_path(spark, "zip")
    records.write_zip(base.cards(spark, d).select(F.concat_ws(",", "county_id", "card_key").alias("value")), path, "lines.csv")
    return records.unzip_lines(spark, f"{path}/*.zip").agg(F.count("*").alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


@R.add("select county_id, contest_id, count(*) as ncards, sum(len(cands))::bigint as nvotes from xv group by all")
def sink_county_data(spark: SparkSession, d: str) -> DataFrame:
    """Each county's contests as CSV files in a folder of its own, read again."""
    data = base.cvr_votes(spark, d).groupBy("county_id", "contest_id").agg(F.count("*").alias("ncards"), F.sum(F.size("cands")).alias("nvotes"))
    path = new_path(spark, "counties")
    records.write_counties(data, path)
    return spark.read.schema("contest_id int, ncards bigint, nvotes bigint, county_id int").option("header", True).csv(path).select("county_id", "contest_id", "ncards", "nvotes")
