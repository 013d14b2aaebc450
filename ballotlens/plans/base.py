"""The tables that the election queries start from, in Spark and in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlens.functions.votes import explode_votes
from ballotlens.operators import outcome, tabulate
from ballotlens.scratch import written
from ballotlens.tables import table

#: What one run of a query has written for its own further use; None outside a query.
_shared: ContextVar[dict | None] = ContextVar("shared", default=None)


def hex_number(c):
    """A hexadecimal number below 2^63, in any spelling."""
    return F.conv(F.regexp_replace(F.lower(F.trim(c)), "^0x", ""), 16, 10).cast("bigint")


def card_rows(spark: SparkSession, d: str) -> int:
    """Rows of card_manifest, as its files' footers say."""
    return table(spark, d, "card_manifest").count()


def _one(rows: DataFrame, key: str, columns: list[str], maps: list[str]) -> DataFrame:
    """One whole row of each key: of copies that differ, the one whose columns come first (nulls last), not fields of several."""
    order = F.struct(*[x for c in columns for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))])
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns, *maps), order).alias("r")).select(key, "r.*")


def cards(spark: SparkSession, d: str) -> DataFrame:
    """card_manifest with each card once: typed prn and phantom, location (the id where it is null)."""
    raw = table(spark, d, "card_manifest").withColumn("prn", hex_number("prn"))
    one = _one(raw, "card_key", ["county_id", "id", "bin_location", "card_index", "phantom", "style_id", "pool_id", "prn"], ["votes"])
    return one.select("card_key", "county_id", "id", F.coalesce("bin_location", "id").alias("location"), "card_index", "prn", F.coalesce(F.col("phantom") == "yes", F.lit(False)).alias("phantom"), "style_id", "pool_id", "votes")


def cvrs(spark: SparkSession, d: str) -> DataFrame:
    """cvr_export with each record once."""
    one = _one(table(spark, d, "cvr_export"), "cvr_key", ["county_id", "id", "counting_group", "ballot_style_id", "precinct_portion_id"], ["votes"])
    return one.withColumnsRenamed({"ballot_style_id": "style_id", "precinct_portion_id": "precinct"})


def contests(spark: SparkSession, d: str) -> DataFrame:
    """contest_manifest with each contest once; num_ranks > 0 marks ranked contests."""
    return table(spark, d, "contest_manifest").groupBy("contest_id").agg(F.min("county_id").alias("county_id"), F.min("vote_for").alias("vote_for"), F.max("num_of_ranks").alias("num_ranks"), F.min("description").alias("description"))


def card_votes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each contest on each card; what ``assertions`` has written within the same query is read again."""
    held = (_shared.get() or {}).get(d)
    if held is not None:
        return held
    return explode_votes(cards(spark, d), "card_key", "county_id", "prn", "phantom", "style_id", "pool_id")


def cvr_votes(spark: SparkSession, d: str) -> DataFrame:
    return explode_votes(cvrs(spark, d), "cvr_key", "county_id", "id", "counting_group", "style_id", "precinct").withColumn("phantom", F.lit(False))


def plain(votes: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Votes of listed contests that are not ranked, with vote_for."""
    return votes.join(contests(spark, d).where("num_ranks = 0").select("contest_id", "vote_for"), "contest_id")


def card_tab(spark: SparkSession, d: str) -> DataFrame:
    return tabulate.candidate_votes(plain(card_votes(spark, d), spark, d).where("not phantom"))


def totals(spark: SparkSession, d: str) -> DataFrame:
    """contest_id, nc (cards with the contest), ncast (without phantoms) and npop (cards whose style may hold it)."""
    votes = card_votes(spark, d)
    own = votes.groupBy("contest_id").agg(F.count("*").alias("nc"), F.count_if(~F.col("phantom")).alias("ncast"))
    styles = votes.select("style_id", "contest_id").distinct()
    return own.join(tabulate.population(cards(spark, d), styles), "contest_id")


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return outcome.winners(card_tab(spark, d), contests(spark, d).select("contest_id", F.col("vote_for").alias("nwinners")))


def assertions(spark: SparkSession, d: str) -> DataFrame:
    """Plurality assertions with their margins. They need the cards' votes several times over, so within a query these are
    cleaned of copies and exploded once and written; nothing is kept beyond the query."""
    shared = _shared.get()
    if shared is not None and d not in shared:
        shared[d] = written(card_votes(spark, d), "card-votes")
    return outcome.with_margins(outcome.plurality_assertions(ranked(spark, d)), totals(spark, d))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Card votes beside what a hand reading would find (mvr null: the card lacks the contest): a fixed pattern of errors by card_key."""
    k = F.col("card_key")
    mvr = F.when(k % 211 == 0, None).when(k % 97 == 0, F.array().cast("array<int>")).when(k % 89 == 5, F.transform("cands", lambda c: c + 1)).otherwise(F.col("cands"))
    return card_votes(spark, d).withColumn("mvr", mvr)


SQL = """
cards as (select card_key, any_value(county_id) as county_id, any_value(id) as id, coalesce(any_value(bin_location), any_value(id)) as location, any_value(card_index) as card_index,
  min(('0x' || regexp_replace(lower(trim(prn)), '^0x', ''))::ubigint)::bigint as prn, coalesce(any_value(phantom) = 'yes', false) as phantom, any_value(style_id) as style_id, any_value(pool_id) as pool_id, any_value(votes) as votes
  from card_manifest group by card_key),
cvrs as (select cvr_key, any_value(county_id) as county_id, any_value(id) as id, any_value(counting_group) as counting_group, any_value(ballot_style_id) as style_id, any_value(precinct_portion_id) as precinct, any_value(votes) as votes from cvr_export group by cvr_key),
contests as (select contest_id, min(county_id) as county_id, min(vote_for) as vote_for, max(num_of_ranks) as num_ranks, min(description) as description from contest_manifest group by contest_id),
cv as (select card_key, county_id, prn, phantom, style_id, pool_id, e.key as contest_id, coalesce(e.value, []) as cands from (select *, unnest(map_entries(votes)) as e from cards)),
xv as (select cvr_key, county_id, id, counting_group, style_id, precinct, e.key as contest_id, coalesce(e.value, []) as cands from (select *, unnest(map_entries(votes)) as e from cvrs)),
tab as (select contest_id, cand, count(*) as nvotes from (select contest_id, unnest(cands) as cand from cv join contests using (contest_id) where num_ranks = 0 and not phantom) group by all),
style_contests as (select distinct style_id, contest_id from cv),
totals as (select contest_id, nc, ncast, npop from (select contest_id, count(*) as nc, count(*) filter (not phantom) as ncast from cv group by all)
  join (select contest_id, count(*) as npop from cards join style_contests using (style_id) group by all) using (contest_id)),
ranked as (select contest_id, cand, nvotes, nvotes / sum(nvotes) over (partition by contest_id) as share, place, place <= vote_for as is_winner
  from (select *, row_number() over (partition by contest_id order by nvotes desc, cand desc) as place from tab) join contests using (contest_id)),
asn as (select w.contest_id, w.cand as winner, x.cand as loser, w.nvotes as winner_votes, x.nvotes as loser_votes, nc, npop, (w.nvotes - x.nvotes) / nc as reported_margin, (w.nvotes - x.nvotes) / npop as diluted_margin,
    (w.nvotes - x.nvotes) / w.nvotes as recount_margin, 1 / (2 - (w.nvotes - x.nvotes) / npop) as noerror
  from ranked w join ranked x on w.contest_id = x.contest_id and w.is_winner and not x.is_winner join totals t on t.contest_id = w.contest_id),
pairs as (select *, case when card_key % 211 = 0 then null when card_key % 97 = 0 then []::int[] when card_key % 89 = 5 then list_transform(cands, lambda c: c + 1) else cands end as mvr from cv)
"""


class Registry:
    """Queries and the SQL that gives the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None, recursive: bool = False):
        def wrap(f):
            @functools.wraps(f)
            def run(spark: SparkSession, d: str) -> DataFrame:
                token = _shared.set({})
                try:
                    return f(spark, d)
                finally:
                    _shared.reset(token)

            self.queries[f.__name__] = run
            if sql:
                more = "," if sql.lstrip().startswith(",") else ""
                self.oracle[f.__name__] = f"with {'recursive' if recursive else ''} {SQL}{more}{sql.lstrip().removeprefix(',')}"
            return f

        return wrap
