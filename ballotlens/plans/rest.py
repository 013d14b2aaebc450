"""Further queries: joins by id, allocations, simulated elections, whole cases, sinks and rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballotlens.functions import assorters as A
from ballotlens.functions import betting
from ballotlens.operators import county, outcome, risk, rounds, simulate, tabulate
from ballotlens.plans import audits, base
from ballotlens.plans.audits import _CLCA, _POLL, _POOLS, _ROUND2, ALPHA, KEYS, MAX_LOSS, SEED
from ballotlens.plans.ballots import _B, _irv_ballots, big, compared, compared_counts, r9
from ballotlens.plans.base import Registry
from ballotlens.scratch import new_path, written
from ballotlens.sources import records
from ballotlens.sources import text_tables as T

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.add("select card_key, p.style_id as pool_style from cards join (select pool_id, min(style_id) as style_id from cards where pool_id is not null group by all) p using (pool_id)")
def mvr_to_card(spark: SparkSession, d: str) -> DataFrame:
    """Cards read by hand get the style of their pool."""
    cards = base.cards(spark, d).where("pool_id is not null")
    return cards.join(cards.groupBy("pool_id").agg(F.min("style_id").alias("pool_style")), "pool_id").select("card_key", "pool_style")


@R.add("select contest_id, any_value(vote_for) as vote_for, sum(len(cands))::bigint as nvotes, (count(*) * any_value(vote_for) - sum(len(cands)))::bigint as undervotes from xv join contests using (contest_id) group by contest_id")
def tabulate_votefor(spark: SparkSession, d: str) -> DataFrame:
    v = base.cvr_votes(spark, d).join(base.contests(spark, d).select("contest_id", "vote_for"), "contest_id")
    return v.groupBy("contest_id", "vote_for").agg(F.sum(F.size("cands")).alias("nvotes"), (F.count("*") * F.first("vote_for") - F.sum(F.size("cands"))).alias("undervotes"))


@R.add(""", w as (select contest_id, pool_id, count(*) as weight from cv where pool_id is not null group by all), s as (select *, 100 * weight // sum(weight) over (partition by contest_id)::bigint as low, (100 * weight) % sum(weight) over (partition by contest_id)::bigint as rest from w)
 select contest_id, pool_id, (low + (row_number() over (partition by contest_id order by rest desc, pool_id) <= 100 - sum(low) over (partition by contest_id))::int)::bigint as share from s""")
def distribute_to_pools(spark: SparkSession, d: str) -> DataFrame:
    """A hundred more cards of each contest split over its pools."""
    w = base.card_votes(spark, d).where("pool_id is not null").groupBy("contest_id", "pool_id").agg(F.count("*").alias("weight"))
    need = w.select("contest_id").distinct().withColumn("need", F.lit(100).cast("bigint"))
    return county.distribute(w, need, ["contest_id"], "pool_id")


@R.add("select county_id, count(distinct card_key) as n_mvrs from pairs where mvr is not null group by all")
def county_mvr_count(spark: SparkSession, d: str) -> DataFrame:
    return base.pairs(spark, d).where("mvr is not null").select("county_id", "card_key").distinct().groupBy("county_id").agg(F.count("*").alias("n_mvrs"))


@R.add("select contest_id, winner, loser, tau, round(t * noerror, 9) as value, round(rate + case when tau = 'p1o' then (nc - ncast) / npop else 0 end, 9) as rate from asn join (select contest_id, ncast from totals) using (contest_id), (select unnest(['p2o', 'p1o', 'p1u', 'p2u']) as tau, unnest([0, 0.5, 1.5, 2]) as t, unnest([0.0001, 0.001, 0.001, 0.0001])::double as rate)")
def apriori_rates(spark: SparkSession, d: str) -> DataFrame:
    """Values of the errors of each assertion with assumed rates; phantoms come on top of the one-vote overstatements."""
    rates = {"p2o": 0.0001, "p1o": 0.001, "p1u": 0.001, "p2u": 0.0001}
    rows = F.array(*[F.struct(F.lit(n).alias("tau"), F.lit(A.TAUS[n]).alias("t"), F.lit(r).alias("rate")) for n, r in rates.items()])
    t = base.totals(spark, d).select("contest_id", ((F.col("nc") - F.col("ncast")) / F.col("npop")).alias("phantoms"))
    j = base.assertions(spark, d).join(t, "contest_id").select(*KEYS, "noerror", "phantoms", F.inline(rows))
    return j.select(*KEYS, "tau", r9(F.col("t") * F.col("noerror"), "value"), r9(F.col("rate") + F.when(F.col("tau") == "p1o", F.col("phantoms")).otherwise(0.0), "rate"))


@R.add(_POLL + " select contest_id, winner, loser, prn, round(mu * (1 + 0.5 * (1 - mu)), 9) as eta from m")
def lam_to_eta(spark: SparkSession, d: str) -> DataFrame:
    """The estimate of the mean that a bet of one half stands for."""
    run = risk.running(audits._poll_sample(spark, d), KEYS, "prn", "x", audits._bucket(spark, d))
    mu = betting.mean_under_null(F.col("npop"), F.col("total"), F.col("j"))
    return run.select(*KEYS, "prn", r9(betting.lambda_to_eta(F.lit(0.5), mu, 1.0), "eta"))


@R.add("select card_key, count(*) as n_possible from cards join style_contests using (style_id) group by all")
def join_style(spark: SparkSession, d: str) -> DataFrame:
    """The number of contests that each card's style may hold; styles are counted before the join."""
    n = base.card_votes(spark, d).select("style_id", "contest_id").distinct().groupBy("style_id").agg(F.count("*").alias("n_possible"))
    return base.cards(spark, d).join(n, "style_id").select("card_key", "n_possible")


@R.add(_POOLS + " select card_key, c.contest_id, winner, loser, round(pool_avg, 9) as pool_avg from cv c join pa on pa.pool_id = c.pool_id and pa.contest_id = c.contest_id")
def join_pool_avg(spark: SparkSession, d: str) -> DataFrame:
    v = base.card_votes(spark, d).where("pool_id is not null").select("card_key", "pool_id", "contest_id")
    return v.join(audits._averages(spark, d), ["pool_id", "contest_id"]).select("card_key", "contest_id", "winner", "loser", r9(F.col("pool_avg"), "pool_avg"))


@R.add("select contest_id, winner, loser, count(*) as n from cv join asn using (contest_id) group by all")
def join_card_assertion(spark: SparkSession, d: str) -> DataFrame:
    """How many cards meet each assertion; cards are counted per contest before they meet them."""
    n = base.card_votes(spark, d).groupBy("contest_id").agg(F.count("*").alias("n"))
    return base.assertions(spark, d).join(n, "contest_id").select(*KEYS, "n")


@R.add(_ROUND2 + " select contest_id, w1.n as before, w2.n as now from wanted w1 left join wanted2 w2 using (contest_id)")
def join_prev_round(spark: SparkSession, d: str) -> DataFrame:
    """Wanted sizes of a round beside those of the round before."""
    t = base.totals(spark, d)
    now = t.select("contest_id", F.least(F.col("nc"), 2 * (20 + F.col("contest_id") % 7)).cast("bigint").alias("now"))
    return audits._wanted(spark, d).withColumnRenamed("n", "before").join(now, "contest_id", "left")


@R.add(_CLCA.format(x="(1 - (ca - ma)) * noerror") + " select contest_id, winner, loser, prn, j, round(x, 9) as value from smp")
def samplers(spark: SparkSession, d: str) -> DataFrame:
    """The comparison values that each assertion's audit sees, in order."""
    run = risk.running(audits._clca_sample(spark, d), KEYS, "prn", "value", audits._bucket(spark, d))
    return run.select(*KEYS, "prn", big("j"), r9(F.col("value"), "value"))


@R.add(_POLL + """, q as (select *, case when abs(mu) < 1e-12 or abs(mu - 1) < 1e-12 then 1 else 1 + 0.5 * (x - mu) end as f, max((mu > 1 + 1e-12)::int) over w as above, max((mu < -1e-12)::int) over w as below from m window w as (partition by contest_id, winner, loser order by prn rows between unbounded preceding and current row))
 select contest_id, winner, loser, prn, round(case when above = 1 then 1 when below = 1 then 0 else least(1, exp(-sum(ln(f)) over (partition by contest_id, winner, loser order by prn rows between unbounded preceding and current row))) end, 6) as p from q""")
def pvalue_sequence(spark: SparkSession, d: str) -> DataFrame:
    """The p-value after each sample of a polling audit with a bet of one half."""
    bucket = audits._bucket(spark, d)
    run = risk.running(audits._poll_sample(spark, d), KEYS, "prn", "x", bucket)
    return risk.martingale(run, KEYS, "prn", "x", F.lit(0.5), "npop", 1.0, audits.EDGE, bucket).select(*KEYS, "prn", F.round("p", 6).alias("p"))


@R.add(_B + ", c as (select contest_id, winner, loser, count(*) as n, count(*) filter (ca - ma <> 0) as errors from b group by all) select contest_id, winner, loser, errors, round(errors / n, 9) as rate from c")
def error_rates(spark: SparkSession, d: str) -> DataFrame:
    c = compared_counts(spark, d).groupBy(*KEYS).agg(F.sum("k").alias("n"), F.sum(F.when(F.abs("over") > 1e-9, F.col("k")).otherwise(0)).alias("errors"))
    return c.select(*KEYS, "errors", r9(F.col("errors") / F.col("n"), "rate"))


# --- simulated elections ---------------------------------------------------------------------------


@R.add(audits._SIMULATED.format(key="style_id, ", where="true"))
def simulate_batches(spark: SparkSession, d: str) -> DataFrame:
    """Simulated votes of all cards by style, in all contests."""
    return audits.simulated(spark, d, base.card_votes(spark, d), ("style_id", "contest_id"))


@R.add(audits._SIMULATED.format(key="pool_id, ", where="pool_id is not null"))
def one_pool_cvrs(spark: SparkSession, d: str) -> DataFrame:
    """Records made for every pool from its subtotals, tabulated again."""
    return audits.simulate_pool(spark, d)


# --- cases -----------------------------------------------------------------------------------------


@R.add("select county_id, style_id, max(greatest(n, ceil(v / f)))::bigint as ncards from (select county_id, style_id, contest_id, count(*) as n, sum(len(cands)) as v, max(vote_for) as f from xv join contests using (contest_id) group by xv.county_id, style_id, contest_id) group by all".replace("select county_id, style_id, contest_id, count(*)", "select xv.county_id as county_id, style_id, contest_id, count(*)"))
def county_pool_build(spark: SparkSession, d: str) -> DataFrame:
    return county.county_pools(base.cvr_votes(spark, d), base.contests(spark, d))


@R.add("select county_id, count(*) as ncards, min(card_index) as first_index, max(card_index) as last_index from cards group by all")
def concat_county_cards(spark: SparkSession, d: str) -> DataFrame:
    return base.cards(spark, d).groupBy("county_id").agg(F.count("*").alias("ncards"), F.min("card_index").alias("first_index"), F.max("card_index").alias("last_index"))


# --- lines, sinks and rounds -----------------------------------------------------------------------


@R.add("select contest_id, cvr_key::int as ballot_id, array_to_string(cands, '>') as prefs from xv join contests using (contest_id) where num_ranks > 0")
def scan_raire_ballots(spark: SparkSession, d: str) -> DataFrame:
    """Ranked ballots written as lines and read again."""
    ranked = base.contests(spark, d).where("num_ranks > 0").select("contest_id")
    v = base.cvr_votes(spark, d).join(ranked, "contest_id", "left_semi")
    lines = v.select(F.concat_ws(",", "contest_id", "cvr_key", F.array_join(F.col("cands").cast("array<string>"), ",")).alias("value"))
    return T.read_ranked(lines).select("contest_id", "ballot_id", F.array_join(F.col("prefs").cast("array<string>"), ">").alias("prefs"))


@R.add("select count(*) as n, count(distinct style_id) as n_styles from cards")
def sink_cards(spark: SparkSession, d: str) -> DataFrame:
    """The manifest committed once to a record and read again."""
    folder = new_path(spark, "record")
    records.commit(base.cards(spark, d), folder, "cards")
    return records.read_record(spark, folder, "cards").agg(F.count("*").alias("n"), F.countDistinct("style_id").alias("n_styles"))


@R.add("select 'contests' as name, count(*) as n from contests union all select 'cards', count(*) from cards union all select 'assertions', count(*) from asn")
def sink_election_record(spark: SparkSession, d: str) -> DataFrame:
    """Tables of an election record, committed in order."""
    folder = new_path(spark, "record")
    out = None
    for name, df in (("cards", base.cards(spark, d)), ("contests", base.contests(spark, d)), ("assertions", base.assertions(spark, d))):
        records.commit(df, folder, name)
        part = records.read_record(spark, folder, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionAll(part)
    return out


@R.add("select count(*) as n, min(prn) as first, max(prn) as last from cards where prn is not null")
def sink_audit_record(spark: SparkSession, d: str) -> DataFrame:
    """The manifest sorted by random number, committed as ranges of it, so that a prefix reads few files."""
    folder = new_path(spark, "record")
    cards = base.cards(spark, d).where("prn is not null")
    records.commit(cards.repartitionByRange(8, "prn").sortWithinPartitions("prn"), folder, "sorted_cards")
    return records.read_record(spark, folder, "sorted_cards").agg(F.count("*").alias("n"), F.min("prn").alias("first"), F.max("prn").alias("last"))


@R.add()
def run_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of a comparison audit of all contests (also the round sinks)."""
    a = written(base.assertions(spark, d), "assertions")
    return rounds.run_rounds(lambda drawn: compared(spark, d, drawn, a).select(*KEYS, "prn", "value", "npop", "noerror"), audits._card_styles(spark, d), a.where("winner_votes > loser_votes"), ALPHA, MAX_LOSS)


@R.add("select contest_id, array_to_string(cands, '>') as prefs, count(*) as nballots from xv join contests using (contest_id) where num_ranks > 0 group by all")
def irv_consolidate(spark: SparkSession, d: str) -> DataFrame:
    """Equal rankings as one row with their count."""
    return _irv_ballots(spark, d).select("contest_id", F.array_join("prefs", ">").alias("prefs"), "nballots")


@R.add()
def sink_round(spark: SparkSession, d: str) -> DataFrame:
    """The tables that each round of an audit commits, read back: rows of each."""
    folder = new_path(spark, "record")
    a = written(base.assertions(spark, d), "assertions")
    done = rounds.run_rounds(lambda drawn: compared(spark, d, drawn, a).select(*KEYS, "prn", "value", "npop", "noerror"), audits._card_styles(spark, d), a.where("winner_votes > loser_votes"), ALPHA, MAX_LOSS, most_rounds=2, folder=folder)
    last = done.agg(F.max("round")).first()[0] or 0
    out = None
    for name in rounds.ROUND_TABLES if last else ():
        part = records.read_record(spark, folder, name).groupBy("round").agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "round", "n_rows")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], "name string, round int, n_rows bigint")
