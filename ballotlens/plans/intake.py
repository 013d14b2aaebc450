"""Queries that read and write the file layouts, over lines made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlens.operators.nested import flatten_sessions
from ballotlens.plans import base
from ballotlens.plans.base import Registry
from ballotlens.plans.data_problems import _STATES
from ballotlens.sources import text_tables as T
from ballotlens.sources import vendor
from ballotlens.tables import table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
_MARKS = "list_sum(list_transform(map_values(votes), lambda v: len(v)))::bigint"


@R.add(f"select id, location, card_index, prn, phantom, style_id, pool_id, cardinality(votes)::bigint as n_contests, {_MARKS} as n_marks from cards")
def scan_card_csv(spark: SparkSession, d: str) -> DataFrame:
    """The card manifest written as lines and read again."""
    rows = T.read_cards(T.write_cards(base.cards(spark, d)))
    return rows.select("id", "location", "card_index", "prn", "phantom", "style_id", "pool_id", F.size("votes").cast("bigint").alias("n_contests"), F.aggregate(F.map_values("votes"), F.lit(0).cast("bigint"), lambda a, v: a + F.size(v)).alias("n_marks"))


@R.add("select id, style_id, e.key as contest_id, array_to_string(e.value, ' ') as cands from (select *, unnest(map_entries(votes)) as e from cvrs)")
def scan_cvr_export_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = T.read_cvrs(T.write_cvrs(base.cvrs(spark, d)))
    return rows.select("id", "style_id", F.explode("votes").alias("contest_id", "c")).select("id", "style_id", "contest_id", F.array_join(F.col("c").cast("array<string>"), " ").alias("cands"))


@R.add("""select pool_id, contest_id, ncards, novote, total_cards, nvotes from (select pool_id, contest_id, count(*) as ncards, count(*) filter (len(cands) = 0) as novote, sum(len(cands))::bigint as nvotes from cv where pool_id is not null group by all)
 join (select pool_id, count(*) as total_cards from cards where pool_id is not null group by all) using (pool_id)""")
def scan_pools_csv(spark: SparkSession, d: str) -> DataFrame:
    """Pool subtotals written as lines, with the pool's name on its first line only, and read again."""
    v = base.card_votes(spark, d).where("pool_id is not null")
    per = v.groupBy("pool_id", "contest_id").agg(F.count("*").alias("ncards"), F.count_if(F.size("cands") == 0).alias("novote"))
    tally = v.select("pool_id", "contest_id", F.explode("cands").alias("c")).groupBy("pool_id", "contest_id", "c").agg(F.count("*").alias("n")).groupBy("pool_id", "contest_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("string"), "n"))).alias("tally"))
    cards = base.cards(spark, d).where("pool_id is not null").groupBy("pool_id").agg(F.count("*").alias("total_cards"))
    zero = F.lit(0).cast("bigint")
    pools = per.join(tally, ["pool_id", "contest_id"], "left").join(cards, "pool_id").select("pool_id", F.concat(F.lit("pool"), "pool_id").alias("pool_name"), F.lit(True).alias("has_exact"), "total_cards", "contest_id", F.lit(1).alias("vote_for"), "ncards", "novote", zero.alias("undervotes"), zero.alias("overvotes"), zero.alias("nphantoms"), F.lit(False).alias("is_irv"), F.coalesce("tally", F.create_map().cast("map<string,bigint>")).alias("tally"))
    back = T.read_pools(T.write_pools(pools))
    return back.select("pool_id", "contest_id", "ncards", "novote", "total_cards", F.coalesce(F.aggregate(F.map_values("tally"), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)).alias("nvotes"))


@R.add("""select county_id, contest_id, ncards, novote, nvotes, total_cards, styles from (select county_id, contest_id, count(*) as ncards, count(*) filter (len(cands) = 0) as novote, sum(len(cands))::bigint as nvotes from cv group by all)
 join (select county_id, count(*) as total_cards, array_to_string(list_sort(list(distinct style_id)), ' ') as styles from cards group by all) using (county_id)""")
def scan_county_pools(spark: SparkSession, d: str) -> DataFrame:
    """Subtotals of counties written as lines, the county's name, cards and styles on its first line only and its id on no other, and read again."""
    v = base.card_votes(spark, d).where("county_id is not null")
    per = v.groupBy("county_id", "contest_id").agg(F.count("*").alias("ncards"), F.count_if(F.size("cands") == 0).alias("novote"))
    tally = v.select("county_id", "contest_id", F.explode("cands").alias("c")).groupBy("county_id", "contest_id", "c").agg(F.count("*").alias("n")).groupBy("county_id", "contest_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("string"), "n"))).alias("tally"))
    cards = base.cards(spark, d).groupBy("county_id").agg(F.count("*").alias("total_cards"), F.array_join(F.sort_array(F.collect_set("style_id")), " ").alias("styles"))
    zero = F.lit(0).cast("bigint")
    pools = per.join(tally, ["county_id", "contest_id"], "left").join(cards, "county_id").select(F.col("county_id").alias("pool_id"), F.concat(F.lit("County "), "county_id").alias("county"), "total_cards", "styles", "contest_id", F.lit(1).alias("vote_for"), "ncards", "novote", zero.alias("undervotes"), zero.alias("overvotes"), zero.alias("nphantoms"), F.lit(False).alias("is_irv"), F.coalesce("tally", F.create_map().cast("map<string,bigint>")).alias("tally"))
    back = T.read_county_pools(T.write_pools(pools, ("county", "total_cards", "styles"), repeat_id=False))
    return back.select(F.col("pool_id").alias("county_id"), "contest_id", "ncards", "novote", F.coalesce(F.aggregate(F.map_values("tally"), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)).alias("nvotes"), "total_cards", F.array_join("styles", " ").alias("styles"))


@R.add("select 'cards' as layout, count(*) as n_read, 2::bigint as n_unread from cards union all select 'ranked', count(*), 1 from xv join contests using (contest_id) where num_ranks > 0")
def scan_unread(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of a layout were read, and how many could not be; a few that do not fit stand between the others."""
    bad = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    cards = T.write_cards(base.cards(spark, d)).unionAll(bad("", "id, location, index", "a-1, , x, ff, , 1, , ,", "a-2"))
    ranked = base.contests(spark, d).where("num_ranks > 0").select("contest_id")
    v = base.cvr_votes(spark, d).join(ranked, "contest_id", "left_semi").select(F.concat_ws(",", "contest_id", "cvr_key", F.array_join(F.col("cands").cast("array<string>"), ",")).alias("value"))
    v = v.unionAll(bad("1", "Contest,3,1,7,winner,7", "3,x_1,7"))
    out = None
    for name, lines, reader in (("cards", cards, T.read_cards), ("ranked", v, T.read_ranked)):
        part = reader(lines).agg(F.count("*").alias("n_read")).join(F.broadcast(T.unread(lines, name).agg(F.count("*").alias("n_unread")))).select(F.lit(name).alias("layout"), "n_read", "n_unread")  # one row each
        out = part if out is None else out.unionAll(part)
    return out


@R.add()
def scan_vendor_json(spark: SparkSession, d: str) -> DataFrame:
    """Votes of the sessions: marks that are votes, by rank, each candidate once."""
    marks = flatten_sessions(table(spark, d, "cvr_sessions"), ("mark",))["mark"].drop("row_key", "parent_key").distinct()
    return vendor.session_votes(marks).select("session_id", "card_no", "contest_id", F.array_join(F.col("cands").cast("array<string>"), " ").alias("cands"))


@R.add()
def vendor_session_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids that cast-vote records take from their sessions, also where the record's number is hidden."""
    s = flatten_sessions(table(spark, d, "cvr_sessions"), ("session",))["session"]
    return s.select("session_id", vendor.session_id(F.col("tabulator_id"), F.col("batch_id"), F.col("record_id"), F.col("image_mask")).alias("cvr_id")).distinct()


@R.add()
def json_contest_summary(spark: SparkSession, d: str) -> DataFrame:
    """Cards, undervotes and overvotes per contest, as the scanner counted them."""
    rows = flatten_sessions(table(spark, d, "cvr_sessions"), ("contest",))["contest"].drop("row_key", "parent_key", "ballot_style_id").distinct().select("session_id", "card_no", "contest_id", "undervotes", "overvotes").distinct()
    return rows.groupBy("contest_id").agg(F.count("*").alias("ncards"), F.sum("undervotes").alias("undervotes"), F.sum("overvotes").alias("overvotes"))


# these start from the sessions' JSON, not from the common tables
ORACLE["scan_vendor_json"] = f"""with {_STATES}, v as (select distinct session_id, card_no, trim(contest->>'Id')::int as contest_id, trim(mark->>'CandidateId')::int as cand, coalesce(try_cast(trim(mark->>'Rank') as int), 0) as rank, mark_no
   from marks where lower(trim(mark->>'IsVote')) in (select w from truths) and mark->>'CandidateId' is not null),
 o as (select session_id, card_no, contest_id, cand, min(rank::bigint * 100000 + mark_no) as place from v group by all)
 select session_id, card_no::int as card_no, contest_id, array_to_string(list(cand order by place), ' ') as cands from o group by all"""
ORACLE["json_contest_summary"] = f"""with {_STATES}, v as (select distinct session_id, card_no, trim(contest->>'Id')::int as contest_id, contest->>'Undervotes' as u, contest->>'Overvotes' as o from contests)
 select contest_id, count(*) as ncards, sum(try_cast(u as int))::bigint as undervotes, sum(try_cast(o as int))::bigint as overvotes from v group by all"""
ORACLE["vendor_session_ids"] = r"""with s as (select distinct session_id, trim(payload::json->>'TabulatorId') as t, payload::json->>'BatchId' as b, payload::json->>'RecordId' as r, payload::json->>'ImageMask' as m, payload::json->'Original' as o, payload::json->'Modified' as mo from cvr_sessions)
 select distinct session_id, concat_ws('-', t, b, case when r = 'X' then case when regexp_matches(m, 'Images.*\*\.\*') then regexp_extract(m, '^.*Images.(.*)\*\.\*', 1) else regexp_extract(m, '^[^/\\]*[/\\](.*)\*\.\*', 1) end else r end) as cvr_id from s where json_type(o) = 'OBJECT' or json_type(mo) = 'OBJECT'"""
