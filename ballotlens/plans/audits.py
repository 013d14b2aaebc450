"""Queries of audits: random numbers, samples, risk, pooled audits, verification and county pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballotlens.functions import assorters as A
from ballotlens.functions import betting
from ballotlens.functions.prn import prn, prn_sql
from ballotlens.operators import draws, outcome, pools, prefix, risk, simulate, tabulate
from ballotlens.plans import base
from ballotlens.plans.ballots import _B, _DHONDT, MIN_FRACTION, SEATS, _against, _seats, big, compared, compared_counts, r9
from ballotlens.plans.base import Registry
from ballotlens.scratch import new_path, written
from ballotlens.sources import records
from ballotlens.tables import table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
SEED, ALPHA, MAX_LOSS, ETA_D = 20311104, 0.05, 0.9, 100
KEYS = ["contest_id", "winner", "loser"]
r6 = lambda c, a: F.round(c, 6).alias(a)

_WANTED = ", wanted as (select contest_id, least(nc, 20 + contest_id % 7)::bigint as n from totals)"
_CC = ", cc as (select distinct c.prn, s.contest_id from cards c join style_contests s using (style_id) where c.prn is not null)"
#: How close a null mean is to a bound that it is taken to be on: sums of many values are not exact.
EDGE = 1e-12


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    """The sizes of a first round that is drawn: some cards of each contest."""
    return _first_sizes(base.totals(spark, d))


def _first_sizes(totals: DataFrame) -> DataFrame:
    return totals.select("contest_id", F.least(F.col("nc"), 20 + F.col("contest_id") % 7).cast("bigint").alias("n"))


def _card_contests(spark: SparkSession, d: str) -> DataFrame:
    """prn and each contest that the card's style may hold."""
    styles = base.card_votes(spark, d).select("style_id", "contest_id").distinct()
    return base.cards(spark, d).where("prn is not null").select("prn", "style_id").join(styles, "style_id").select("prn", "contest_id")


def _card_styles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same without the product: prn and style of the cards, and the contests that each style may hold."""
    return base.cards(spark, d).where("prn is not null").select("prn", "style_id"), written(base.card_votes(spark, d).select("style_id", "contest_id").distinct(), "styles")


# --- random numbers and samples --------------------------------------------------------------------


@R.add(f"select card_key, {prn_sql(SEED, 'card_index')} as prn from cards")
def prn_assign(spark: SparkSession, d: str) -> DataFrame:
    return base.cards(spark, d).select("card_key", prn(SEED, F.col("card_index")).alias("prn"))


@R.add(f"select county_id, card_key, row_number() over (partition by county_id order by p, card_key) as place from (select county_id, card_key, {prn_sql(SEED, 'card_index')} as p from cards)")
def prn_sort_internal(spark: SparkSession, d: str) -> DataFrame:
    """Each county's cards in the order of their numbers; ranges of the number are sorted, not counties."""
    cards = base.cards(spark, d).select("county_id", "card_key", prn(SEED, F.col("card_index")).alias("p"))
    return prefix.place(cards, ["county_id"], ["p", "card_key"], prefix.number_bucket("p", base.card_rows(spark, d))).select("county_id", "card_key", "place")


@R.add(f"select card_key, row_number() over (order by p, card_key) as place from (select card_key, {prn_sql(SEED, 'card_index')} as p from cards)")
def prn_sort_external(spark: SparkSession, d: str) -> DataFrame:
    """All cards in one order, over all counties."""
    cards = base.cards(spark, d).select("card_key", prn(SEED, F.col("card_index")).alias("p"), F.lit(0).alias("k"))
    return prefix.place(cards, ["k"], ["p", "card_key"], prefix.number_bucket("p", base.card_rows(spark, d))).select("card_key", "place")


_NEED = ", need as (select contest_id, nc - ncast as n from totals where nc > ncast), pk as (select contest_id, unnest(range(1, n + 1)) as k from need)"


@R.add(_NEED + " select k as phantom_no, array_to_string(list_sort(list(distinct contest_id)), ' ') as contests from pk group by all")
def make_phantoms(spark: SparkSession, d: str) -> DataFrame:
    need = base.totals(spark, d).select("contest_id", (F.col("nc") - F.col("ncast")).alias("n"))
    return draws.make_phantoms(need).select(big("phantom_no"), F.array_join("contests", " ").alias("contests"))


_SAMPLE = _WANTED + _CC + ", ranked_cc as (select prn, contest_id, row_number() over (partition by contest_id order by prn) as rn from cc), drawn as (select distinct prn from ranked_cc join wanted using (contest_id) where rn <= n)"


@R.add(_SAMPLE + " select prn from drawn")
def consistent_sampling(spark: SparkSession, d: str) -> DataFrame:
    return draws.consistent_sample(_card_contests(spark, d), _wanted(spark, d))


@R.add(_SAMPLE + " select prn from drawn")
def consistent_sampling_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The same sample from a committed manifest in the order of its numbers, of which only a prefix is read."""
    folder = new_path(spark, "record")
    cards = base.cards(spark, d).where("prn is not null").select("prn", "style_id")
    records.commit(cards.repartitionByRange(8, "prn").sortWithinPartitions("prn"), folder, "sorted_cards")
    styles = written(base.card_votes(spark, d).select("style_id", "contest_id").distinct(), "styles")
    cc = records.read_record(spark, folder, "sorted_cards").join(styles, "style_id").select("prn", "contest_id")
    return draws.consistent_sample_prefix(cc, _wanted(spark, d), cc.groupBy("contest_id").agg(F.count("*").alias("cards")))


@R.add(_SAMPLE + " select prn from drawn order by prn limit 50")
def risk_measuring_cap(spark: SparkSession, d: str) -> DataFrame:
    """The sample cut to the 50 smallest numbers that an auditor may read."""
    return draws.consistent_sample(_card_contests(spark, d), _wanted(spark, d), 50)


@R.add(_SAMPLE + """, placed as (select prn, row_number() over (order by prn) as place from drawn),
 seen as (select contest_id, prn, place, sum((place is null)::int) over (partition by contest_id order by prn) as skips from cc join wanted using (contest_id) left join placed using (prn) where prn <= (select max(prn) from drawn))
 select contest_id, count(*) as have, max(place) as upto from seen where skips = 0 group by all""")
def sample_reach(spark: SparkSession, d: str) -> DataFrame:
    cc, wanted = _card_contests(spark, d), _wanted(spark, d)
    return draws.sample_reach(cc.distinct(), draws.consistent_sample(cc, wanted), wanted).select("contest_id", "have", big("upto"))


@R.add("select county_id, card_key, rn as place from (select county_id, card_key, row_number() over (partition by county_id order by prn) as rn from cards where prn is not null) where rn <= 10 + county_id % 5")
def uniform_sampling(spark: SparkSession, d: str) -> DataFrame:
    cards = base.cards(spark, d).where("prn is not null").select("county_id", "card_key", "prn")
    wanted = cards.select("county_id").distinct().withColumn("n", 10 + F.col("county_id") % 5)
    return draws.uniform_sample(cards, wanted).select("county_id", "card_key", F.col("rank").cast("bigint").alias("place"))


@R.add(_WANTED + _CC + """, ok as (select contest_id, n, row_number() over (order by n desc, contest_id) as r from wanted join totals using (contest_id) where n <= 0.5 * nc and n <= 24),
 rk as (select prn, contest_id, row_number() over (partition by contest_id order by prn) as rn from cc), drawn as (select prn, max(r) as r from rk join ok using (contest_id) where rn <= n group by all),
 steps as (select r, sum(count(*)) over (order by r desc) as upto from drawn group by r)
 select contest_id, n from ok where r > (select coalesce(max(r), 0) from steps where upto > 120) and exists (select 1 from steps where upto <= 120)""")
def sample_limits(spark: SparkSession, d: str) -> DataFrame:
    t = base.totals(spark, d)
    return draws.sample_with_limits(_card_contests(spark, d), _wanted(spark, d), t, 0.5, 24, 120)


@R.add(_WANTED + " select contest_id, n from (select *, row_number() over (order by n desc, contest_id) as r from wanted) where r > 3")
def remove_max_contests(spark: SparkSession, d: str) -> DataFrame:
    return draws.drop_largest(_wanted(spark, d), 3)


_STRATA = ", strata as (select county_id, count(*) as population, least(count(*), 10 + county_id % 5) as nmvrs from cards group by county_id having county_id % 4 <> 3)"


@R.add(_STRATA + """, cs as (select distinct description, county_id from contests where county_id is not null),
 per as (select description, coalesce(nmvrs / population, 1) as rate, population from cs left join strata using (county_id))
 select p.description, round(min_rate, 9) as min_rate, sum(coalesce(round_even(min_rate * population, 0), 0))::bigint as n from per p join (select description, min(rate) as min_rate from per group by all) using (description) group by all""")
def strata_min_rate(spark: SparkSession, d: str) -> DataFrame:
    """Contests of one name are one contest of all counties that have it: its least sampling rate, and the sample that gives."""
    strata = base.cards(spark, d).groupBy("county_id").agg(F.count("*").alias("population")).where("county_id % 4 <> 3").withColumn("nmvrs", F.least(F.col("population"), 10 + F.col("county_id") % 5))
    cs = base.contests(spark, d).where("county_id is not null").select(F.col("description").alias("contest_id"), "county_id").distinct()
    return draws.strata_rates(strata, cs).select(F.col("contest_id").alias("description"), r9(F.col("min_rate"), "min_rate"), "n")


@R.add("select card_key from (select card_key, row_number() over (order by prn, card_key) as r from cards where prn is not null) where r > 10 and r <= 30")
def subset_iterator(spark: SparkSession, d: str) -> DataFrame:
    return base.cards(spark, d).where("prn is not null").orderBy("prn", "card_key").offset(10).limit(20).select("card_key")


# --- joins -----------------------------------------------------------------------------------------


@R.add(_SAMPLE + " select p.prn, p.contest_id, len(cands)::bigint as cvr_marks, len(mvr)::bigint as mvr_marks from pairs p join drawn using (prn)")
def join_mvr_card(spark: SparkSession, d: str) -> DataFrame:
    """Sampled cards beside what the hand reading found."""
    drawn = draws.consistent_sample(_card_contests(spark, d), _wanted(spark, d))
    p = base.pairs(spark, d).join(drawn, "prn", "left_semi")
    return p.select("prn", "contest_id", F.size("cands").cast("bigint").alias("cvr_marks"), F.when(F.col("mvr").isNotNull(), F.size("mvr")).cast("bigint").alias("mvr_marks"))


@R.add(_SAMPLE + " select card_key, prn from cards semi join drawn using (prn)")
def join_sample_prns(spark: SparkSession, d: str) -> DataFrame:
    drawn = draws.consistent_sample(_card_contests(spark, d), _wanted(spark, d))
    return base.cards(spark, d).join(drawn, "prn", "left_semi").select("card_key", "prn")


_ROUND2 = _SAMPLE + ", wanted2 as (select contest_id, least(nc, 2 * (20 + contest_id % 7)) as n from totals), drawn2 as (select distinct prn from ranked_cc join wanted2 using (contest_id) where rn <= n)"


def _round2(spark: SparkSession, d: str) -> DataFrame:
    wanted = base.totals(spark, d).select("contest_id", F.least(F.col("nc"), 2 * (20 + F.col("contest_id") % 7)).cast("bigint").alias("n"))
    return draws.consistent_sample(_card_contests(spark, d), wanted)


@R.add(_ROUND2 + " select prn from drawn2 anti join drawn using (prn)")
def join_new_vs_previous(spark: SparkSession, d: str) -> DataFrame:
    """Cards of a second round that the first did not draw."""
    return _round2(spark, d).join(consistent_sampling(spark, d), "prn", "left_anti")


@R.add("select c.contest_id, coalesce(a.n, 0)::bigint as cvr_votes, coalesce(b.n, 0)::bigint as card_votes from (select contest_id from contests) c left join (select contest_id, sum(len(cands)) as n from xv group by all) a using (contest_id) left join (select contest_id, sum(nvotes) as n from tab group by all) b using (contest_id) where coalesce(a.n, 0) <> coalesce(b.n, 0)")
def join_outer_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Contests whose votes differ between two tabulations; no votes and no row are the same."""
    known = base.contests(spark, d).select("contest_id")
    a = base.cvr_votes(spark, d).join(known, "contest_id", "left_semi").groupBy("contest_id").agg(F.sum(F.size("cands")).alias("a"))
    b = base.card_tab(spark, d).groupBy("contest_id").agg(F.sum("nvotes").alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.join(b, "contest_id", "full_outer").where(zero("a") != zero("b")).select("contest_id", zero("a").alias("cvr_votes"), zero("b").alias("card_votes"))


@R.add("select map_keys_text as contests, n_cards, n_cvrs from (select array_to_string(list_sort(map_keys(votes)), ' ') as map_keys_text, count(*) as n_cards from cards group by all) join (select array_to_string(list_sort(map_keys(votes)), ' ') as map_keys_text, count(*) as n_cvrs from cvrs group by all) using (map_keys_text)")
def join_contest_set(spark: SparkSession, d: str) -> DataFrame:
    text = lambda df, n: tabulate.derive_styles(df).select(F.array_join("contests", " ").alias("contests"), F.col("ncards").alias(n))
    return text(base.cards(spark, d), "n_cards").join(text(base.cvrs(spark, d), "n_cvrs"), "contests")


@R.add("select contest_id from contests anti join (select distinct contest_id from cv) using (contest_id)")
def setop_except(spark: SparkSession, d: str) -> DataFrame:
    return base.contests(spark, d).select("contest_id").subtract(base.card_votes(spark, d).select("contest_id"))


@R.add("select contest_id, num_ranks from contests where vote_for = 1 and contest_id in (select contest_id from cv)")
def pre_filter_inprogress(spark: SparkSession, d: str) -> DataFrame:
    """Contests of single votes that are on some card."""
    return base.contests(spark, d).where("vote_for = 1").join(base.card_votes(spark, d).select("contest_id").distinct(), "contest_id", "left_semi").select("contest_id", "num_ranks")


# --- risk ------------------------------------------------------------------------------------------

_POLL = """, smp as (select contest_id, winner, loser, npop, diluted_margin, prn, x, row_number() over w - 1 as j, coalesce(sum(x) over (partition by contest_id, winner, loser order by prn rows between unbounded preceding and 1 preceding), 0) as total
   from (select c.contest_id, a.winner, a.loser, a.npop, a.diluted_margin, c.prn, (list_contains(cands, winner)::int - list_contains(cands, loser)::int + 1) * 0.5 as x
     from cv c join asn a using (contest_id) where c.prn is not null and not c.phantom) window w as (partition by contest_id, winner, loser order by prn)),
 m as (select *, (npop * 0.5 - total) / (npop - j) as mu from smp)"""


def _poll_sample(spark: SparkSession, d: str) -> DataFrame:
    """All cards of each contest by random number, with the polling assorter of each assertion."""
    a = base.assertions(spark, d).select(*KEYS, "npop", "diluted_margin", "noerror")
    v = base.card_votes(spark, d).where("prn is not null and not phantom").select("contest_id", "prn", "cands")
    return v.join(a, "contest_id").withColumn("x", A.plurality(F.col("cands"), F.col("winner"), F.col("loser"))).withColumn("eta0", A.margin_to_mean(F.col("diluted_margin")))


def _bucket(spark: SparkSession, d: str):
    """Ranges of the random number, if the manifest is so large that a contest's cards should not be sorted in one task."""
    return prefix.number_bucket("prn", base.card_rows(spark, d))


def _decide(lam: str, upper: str = "1") -> str:
    return f""", l as (select *, {lam} as lam from m), f as (select *, case when abs(mu) < 1e-12 or abs(mu - {upper}) < 1e-12 then 1 else 1 + lam * (x - mu) end as factor from l),
 g as (select *, sum(case when factor > 0 then ln(factor) else 0 end) over w as log_t, max((factor <= 0)::int) over w as ruined, max((mu < -{EDGE})::int) over w as below, max((mu > {upper} + {EDGE})::int) over w as above from f window w as (partition by contest_id, winner, loser order by prn rows between unbounded preceding and current row)),
 p as (select *, case when above = 1 then 1 when below = 1 then 0 when ruined = 1 then 1 else least(1, exp(-log_t)) end as p from g),
 dec as (select contest_id, winner, loser, count(*) as samples, min(j + 1) filter (p < {ALPHA}) as stop, min(p) as min_p, max_by(p, j) as last_p, min_by(p, j) filter (p < {ALPHA}) as stop_p, max((mu > {upper} + {EDGE})::int) as above, max((mu < -{EDGE})::int) as below from p group by all)
 select contest_id, winner, loser, samples, coalesce(stop, samples) as used, round(coalesce(stop_p, last_p), 6) as p_value, round(min_p, 6) as min_p,
  case when below = 1 then 'sum_rejects_null' when stop is not null then 'rejects_null' when above = 1 then 'accept_null' else 'limit_reached' end as status from dec"""


def _decided(run: DataFrame, upper=1.0) -> DataFrame:
    out = risk.decisions(run, KEYS, ALPHA, upper, EDGE)
    return out.select(*KEYS, "samples", big("used"), r6(F.col("p_value"), "p_value"), r6(F.col("min_p"), "min_p"), "status")


_ETA = f"least(greatest(mu + ((diluted_margin + 1) / 2 - 0.5) / 2 / sqrt({ETA_D} + j), ({ETA_D} * (diluted_margin + 1) / 2 + total) / ({ETA_D} + j)), 1 - {betting.EPSILON})"


@R.add(_POLL + _decide(f"({_ETA} / nullif(mu, 0) - 1) / nullif(1 - mu, 0)"))
def alpha_mart(spark: SparkSession, d: str) -> DataFrame:
    return _decided(risk.alpha_mart(_poll_sample(spark, d), KEYS, "prn", "x", "npop", 1.0, "eta0", ETA_D, EDGE, _bucket(spark, d)))


@R.add(_POLL + _decide("0.5"))
def fixed_bet(spark: SparkSession, d: str) -> DataFrame:
    base_ = risk.running(_poll_sample(spark, d), KEYS, "prn", "x", _bucket(spark, d))
    return _decided(risk.martingale(base_, KEYS, "prn", "x", F.lit(0.5), "npop", 1.0, EDGE, _bucket(spark, d)))


@R.add(_POLL + " select contest_id, winner, loser, prn, j, round(total, 6) as total, round(mu, 9) as mu from m")
def pop_mean_H0(spark: SparkSession, d: str) -> DataFrame:
    """The null mean before each sample, and the running sum that it rests on."""
    run = risk.running(_poll_sample(spark, d), KEYS, "prn", "x", _bucket(spark, d))
    return run.select(*KEYS, "prn", big("j"), r6(F.col("total"), "total"), r9(betting.mean_under_null(F.col("npop"), F.col("total"), F.col("j")), "mu"))


@R.add(_POLL + f" select contest_id, winner, loser, prn, round(({_ETA} / nullif(mu, 0) - 1) / nullif(1 - mu, 0), 6) as lam from m where mu > 0 and mu < 1")
def eta_to_lam(spark: SparkSession, d: str) -> DataFrame:
    """The bet that the shrunk estimate of the mean stands for, where the null mean leaves one (it lies between 0 and 1)."""
    run = risk.running(_poll_sample(spark, d), KEYS, "prn", "x", _bucket(spark, d)).withColumn("mu", betting.mean_under_null(F.col("npop"), F.col("total"), F.col("j"))).where("mu > 0 and mu < 1")
    eta = betting.shrink_trunc(F.col("eta0"), ETA_D, F.col("j"), F.col("total"), F.col("mu"), 1.0)
    return run.select(*KEYS, "prn", r6(betting.eta_to_lambda(eta, F.col("mu"), 1.0), "lam"))


@R.add(_POLL + " select contest_id, winner, loser, prn, round(avg(x) over w, 9) as mean, round(var_pop(x) over w, 9) as variance from smp window w as (partition by contest_id, winner, loser order by prn rows between unbounded preceding and current row)")
def tracker(spark: SparkSession, d: str) -> DataFrame:
    """Mean and variance of the samples so far, from running sums of values and squares."""
    x = F.col("x").cast("double")
    run = prefix.before(_poll_sample(spark, d), KEYS, ["prn"], _bucket(spark, d), {"j": F.lit(1).cast("bigint"), "s": x, "q": x * x})
    n, mean = F.col("j") + 1, (F.col("s") + x) / (F.col("j") + 1)
    return run.select(*KEYS, "prn", r9(mean, "mean"), r9((F.col("q") + x * x) / n - mean * mean, "variance"))


_CLCA = _B + """,
 smp as (select contest_id, winner, loser, npop, noerror, prn, {x} as x, row_number() over w - 1 as j, coalesce(sum({x}) over (partition by contest_id, winner, loser order by prn rows between unbounded preceding and 1 preceding), 0) as total from b where prn is not null window w as (partition by contest_id, winner, loser order by prn)),
 m as (select *, (npop * 0.5 - total) / (npop - j) as mu from smp)"""


def _clca_sample(spark: SparkSession, d: str) -> DataFrame:
    """All cards of each contest by random number, with the comparison value of each assertion."""
    return compared(spark, d).where("prn is not null").select(*KEYS, "prn", "pool_id", "phantom", "mvr", "value", "npop", "noerror")


@R.add(_CLCA.format(x="noerror") + _decide(f"{MAX_LOSS} / nullif(mu, 0)", "2 * noerror"))
def clca_no_error(spark: SparkSession, d: str) -> DataFrame:
    """The comparison audit as it would go without any error."""
    s = _clca_sample(spark, d).withColumn("x", F.col("noerror"))
    return _decided(risk.error_free(s, KEYS, "prn", "x", "npop", 2 * F.col("noerror"), MAX_LOSS, EDGE, _bucket(spark, d)), 2 * F.col("noerror"))


@R.add(_CLCA.format(x="(1 - (ca - ma)) * noerror") + _decide("0.8", "2 * noerror"))
def betting_mart(spark: SparkSession, d: str) -> DataFrame:
    """The comparison audit with a fixed bet over the values that were measured."""
    run = risk.running(_clca_sample(spark, d).withColumn("x", F.col("value")), KEYS, "prn", "x", _bucket(spark, d))
    return _decided(risk.martingale(run, KEYS, "prn", "x", F.lit(0.8), "npop", 2 * F.col("noerror"), EDGE, _bucket(spark, d)), 2 * F.col("noerror"))


@R.add()
def adaptive_betting(spark: SparkSession, d: str) -> DataFrame:
    """The comparison audit with bets from the measured rates of errors, over all cards of each contest by random number."""
    return risk.adaptive(_clca_sample(spark, d), KEYS, "prn", "value", "npop", "noerror", ALPHA, MAX_LOSS, _bucket(spark, d))


@R.add()
def adaptive_oneaudit(spark: SparkSession, d: str) -> DataFrame:
    """The pooled comparison audit: pooled cards are compared with their pool's average, whose values enter the bet with their rates."""
    averages = written(_averages(spark, d), "averages")
    mvr = F.when(F.col("phantom"), 0.0).otherwise(A.plurality(F.col("mvr"), F.col("winner"), F.col("loser")))
    sample = pools.pooled_comparison(_clca_sample(spark, d), averages, mvr).withColumn("pooled", F.col("pool_id").isNotNull())
    rates = pools.pool_values(averages, base.assertions(spark, d)).where("rate > 0").groupBy(*KEYS, F.round("value", 12).alias("value")).agg(F.sum("rate").alias("rate"))
    return risk.adaptive(sample, KEYS, "prn", "value", "npop", "noerror", ALPHA, MAX_LOSS, _bucket(spark, d), rates, "pooled")


@R.add(_B + """, c as (select contest_id, winner, loser, count(*) as n, count(*) filter (ca - ma = 0.5) as o1, count(*) filter (ca - ma = 1) as o2, count(*) filter (ca - ma = -0.5) as u1, count(*) filter (ca - ma = -1) as u2 from b group by all)
 select contest_id, winner, loser, round(least(1, pow(1 - diluted_margin / (2 * 1.03905), n) * pow(1 - 1 / (2 * 1.03905), -o1) * pow(1 - 1 / 1.03905, -o2) * pow(1 + 1 / (2 * 1.03905), -u1) * pow(1 + 1 / 1.03905, -u2)), 6) as risk from c join asn using (contest_id, winner, loser) where diluted_margin > 0""")
def kaplan_markov(spark: SparkSession, d: str) -> DataFrame:
    o = F.round("over", 6)
    c = compared_counts(spark, d).groupBy(*KEYS).agg(F.sum("k").alias("n"), *[F.sum(F.when(o == v, F.col("k")).otherwise(0)).alias(k) for k, v in (("o1", 0.5), ("o2", 1.0), ("u1", -0.5), ("u2", -1.0))])
    c = c.join(base.assertions(spark, d).select(*KEYS, "diluted_margin"), KEYS).where("diluted_margin > 0")
    return c.select(*KEYS, r6(betting.kaplan_markov(*[F.col(x) for x in ("n", "o1", "o2", "u1", "u2")], 1.03905, F.col("diluted_margin")), "risk"))


@R.add(f""", k as (select contest_id, winner, loser, npop, noerror, unnest(range(1, npop + 1)) as j from asn), mu as (select *, case when j < npop then (npop * 0.5 - noerror * j) / (npop - j) else 0 end as mu from k),
 t as (select *, sum(case when mu > 0 then ln(1 + {MAX_LOSS} / mu * (noerror - mu)) else 0 end) over (partition by contest_id, winner, loser order by j) as log_t from mu)
 select contest_id, winner, loser, any_value(npop) as npop, round(any_value(noerror), 9) as noerror, coalesce(min(j) filter (mu <= 0 or log_t >= -ln({ALPHA})), 0)::int as estimate from t group by all""")
def est_sample_size(spark: SparkSession, d: str) -> DataFrame:
    """Samples that each assertion needs if no error is found."""
    a = base.assertions(spark, d).select(*KEYS, "npop", "noerror")
    return risk.needed_samples(a, ALPHA, MAX_LOSS).select(*KEYS, "npop", r9(F.col("noerror"), "noerror"), "estimate")


@R.add("select contest_id, winner, loser, round(2 - 2 * 1.8 / (2 * exp(-ln(0.05) / npop) - 2 + 1.8), 9) as margin from asn")
def est_margin_from_samples(spark: SparkSession, d: str) -> DataFrame:
    """The margin that as many error-free samples as there are cards would confirm."""
    return base.assertions(spark, d).select(*KEYS, r9(betting.margin_from_samples(F.lit(1.8), ALPHA, F.col("npop")), "margin"))


@R.add("select contest_id, winner, loser, ceil(-ln(0.05) / ((1 - 0.001) * ln(1 + 1.8 * (noerror - 0.5)) + 0.001 * ln(1 + 1.8 * (0.5 * noerror - 0.5))))::bigint as n from asn where (1 - 0.001) * ln(1 + 1.8 * (noerror - 0.5)) + 0.001 * ln(1 + 1.8 * (0.5 * noerror - 0.5)) > 0")
def sample_size_with_errors(spark: SparkSession, d: str) -> DataFrame:
    """Samples needed if one card in a thousand overstates by one vote; assertions that can gain nothing then have no number."""
    gain = (1 - 0.001) * F.log(1 + 1.8 * (F.col("noerror") - 0.5)) + 0.001 * F.log(1 + 1.8 * (0.5 * F.col("noerror") - 0.5))
    n = betting.samples_with_errors(ALPHA, F.lit(1.8), F.col("noerror"), F.lit(1 - 0.001), [(F.lit(0.001), 0.5 * F.col("noerror"))])
    return base.assertions(spark, d).where(gain > 0).select(*KEYS, n.cast("bigint").alias("n"))


_LEFT = f""", drawn_n as (select contest_id, winner, loser, npop, noerror, least(nc, 20 + contest_id % 7)::bigint as n from asn), k as (select *, unnest(range(1, least(n + 1, npop - 1) + 1)) as j from drawn_n),
 left_risk as (select contest_id, winner, loser, exp(-sum(ln(1 + {risk.STANDARD_BET} * (noerror - (npop * 0.5 - noerror * j) / (npop - j))))) as risk from k group by all)"""


@R.add(_LEFT + " select contest_id, winner, loser, round(risk, 6) as risk from left_risk")
def est_risk(spark: SparkSession, d: str) -> DataFrame:
    """The risk that is left after an error-free sample of a first round under the usual constant bet: the product over one factor more than samples."""
    a = base.assertions(spark, d).where("npop > 1").select(*KEYS, "npop", "noerror").join(_wanted(spark, d), "contest_id")
    return risk.risk_left(a).select(*KEYS, r6(F.col("risk"), "risk"))


@R.add(_POLL + _decide("0.5").replace("select contest_id, winner, loser, samples", ", fin as (select contest_id, winner, loser, samples", 1) + ") select contest_id, bool_and(status = 'rejects_null') as done, count(*) as assertions, min(status) as worst from fin group by all")
def contest_status(spark: SparkSession, d: str) -> DataFrame:
    """A contest is done if all its assertions are."""
    return fixed_bet(spark, d).groupBy("contest_id").agg(F.bool_and(F.col("status") == "rejects_null").alias("done"), F.count("*").alias("assertions"), F.min("status").alias("worst"))


@R.add(_SAMPLE + """, used as (select contest_id, (n // 2) as used from wanted), o as (select prn, contest_id, row_number() over (partition by contest_id order by prn) - 1 as k from cc semi join drawn using (prn))
 select prn, bool_or(k < used) as used from o join used using (contest_id) group by all""")
def mvrs_used(spark: SparkSession, d: str) -> DataFrame:
    """A sampled card was used if, for some contest, it is among the samples the contest used (here half of those wanted).

    A contest's samples are drawn by prn, so that their places among the drawn cards are those among all of its cards.
    """
    cards = written(base.cards(spark, d).select("prn", "style_id", F.map_keys("votes").alias("contests")), "cards")
    held = written(cards.select("style_id", F.explode("contests").alias("contest_id")).groupBy("style_id", "contest_id").agg(F.count("*").alias("k")), "held")
    known = held.groupBy("contest_id").agg(F.sum("k").alias("nc"), F.count("style_id").alias("styles")).where("styles > 0")
    wanted = written(_first_sizes(known), "wanted")
    classes, contests = draws.card_classes(cards.where("prn is not null"), held.select("style_id", "contest_id"))
    o = draws.first_in_classes(classes, written(contests, "contests"), wanted)
    return o.groupBy("prn").agg(F.bool_or(F.expr("rank <= n div 2")).alias("used"))


# --- simulation ------------------------------------------------------------------------------------


@R.add()
def estimate_round(spark: SparkSession, d: str) -> DataFrame:
    """Cards each contest needs, by its hardest assertion: of twenty polling trials the 50th and 80th percentile, and of the one comparison trial its size."""
    hard = written(outcome.hardest(base.assertions(spark, d).where("winner_votes > loser_votes")), "hardest")
    per = risk.simulate_polling(hard, 20, ALPHA).groupBy("contest_id").agg(F.collect_list("needed").alias("v"))  # one value a trial
    q = lambda p: tabulate.quantile_integer(F.col("v"), p).cast("bigint").alias(f"q{p}")
    polling = per.select("contest_id", F.lit("polling").alias("audit"), q(50), q(80))
    comparison = risk.comparison_trial(hard, _ordered_cards(spark, d), ALPHA, MAX_LOSS, _bucket(spark, d))
    return polling.unionByName(comparison.select("contest_id", F.lit("comparison").alias("audit"), F.col("needed").alias("q50"), F.col("needed").alias("q80")))


def _ordered_cards(spark: SparkSession, d: str) -> DataFrame:
    return base.card_votes(spark, d).where("prn is not null").select("contest_id", "prn", "phantom")


@R.add()
def clca_trial(spark: SparkSession, d: str) -> DataFrame:
    """Cards each contest's hardest assertion needs in a comparison audit whose only errors are phantoms; then, as a second
    round would ask after half of them, those still needed (together as many)."""
    hard = written(outcome.hardest(base.assertions(spark, d).where("winner_votes > loser_votes")), "hardest")
    cards = _ordered_cards(spark, d)
    first = written(risk.comparison_trial(hard, cards, ALPHA, MAX_LOSS, _bucket(spark, d)), "trial")
    half = first.select(*KEYS, F.expr("needed div 2").alias("k"))
    seen = prefix.place(cards, ["contest_id"], ["prn"], _bucket(spark, d)).join(half, "contest_id").where("place <= k").join(hard.select(*KEYS, "npop", "noerror"), KEYS)
    audit = risk.adaptive(seen.withColumn("value", F.when(F.col("phantom"), F.col("noerror") / 2).otherwise(F.col("noerror"))), KEYS, "prn", "value", "npop", "noerror", ALPHA, MAX_LOSS)
    state = seen.groupBy(*KEYS).agg(F.count("*").alias("samples"), F.sum(F.when(F.col("phantom"), F.col("noerror") / 2).otherwise(F.col("noerror"))).alias("total"), F.count_if("phantom").cast("int").alias("e"), F.max("noerror").alias("ne"))
    errors = F.when(F.col("e") > 0, F.create_map(F.round(F.col("ne") / 2, 12), F.col("e"))).otherwise(F.create_map().cast("map<double,int>"))
    previous = state.join(audit, KEYS).select(*KEYS, "samples", "total", "p_value", errors.alias("errors"))
    again = risk.comparison_trial(hard, cards, ALPHA, MAX_LOSS, _bucket(spark, d), previous)
    return first.join(again.select(*KEYS, F.col("needed").alias("still_needed"), F.col("status").alias("later_status")), KEYS).join(half, KEYS).select(*KEYS, "needed", "status", F.col("k").alias("had"), "still_needed", "later_status")


@R.add()
def one_shot_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every assertion over all cards in one go: polling over a shuffled electorate, and comparison with phantoms as the only errors."""
    a = written(base.assertions(spark, d).where("winner_votes > loser_votes"), "assertions")
    polling = risk.simulate_polling(a, 1, ALPHA).select(*KEYS, F.lit("polling").alias("audit"), "needed")
    return polling.unionByName(risk.comparison_trial(a, _ordered_cards(spark, d), ALPHA, MAX_LOSS, _bucket(spark, d)).select(*KEYS, F.lit("comparison").alias("audit"), "needed"))


@R.add()
def closest_trial(spark: SparkSession, d: str) -> DataFrame:
    """Of ten trials of each contest's hardest assertion, the one nearest to 100 cards."""
    trials = risk.simulate_polling(outcome.hardest(base.assertions(spark, d).where("winner_votes > loser_votes")), 10, ALPHA)
    return trials.groupBy(*KEYS).agg(F.min_by("trial", F.struct(F.abs(F.col("needed") - 100), "trial")).alias("trial"), F.min(F.abs(F.col("needed") - 100)).alias("gap"))


_SIMULATED = """select {key}contest_id, choice, count(*) as nvotes from (
 select {key}contest_id, unnest(case when num_ranks > 0 then case when len(cands) > 0 then [array_to_string(cands, '>')] else [] end else list_transform(list_distinct(cands), lambda c: c::varchar) end) as choice from cv join contests using (contest_id) where {where}) group by all"""


def simulated(spark: SparkSession, d: str, v: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Votes made for cards of any contest from their totals, tabulated again: marks of candidates, or whole rankings."""
    v = v.join(base.contests(spark, d).select("contest_id", "num_ranks"), "contest_id")
    text = F.col("cands").cast("array<string>")
    ranking = F.when(F.size("cands") > 0, F.array(F.array_join(text, ">"))).otherwise(F.array().cast("array<string>"))
    marks = v.select(*keys, F.explode(F.when(F.col("num_ranks") > 0, ranking).otherwise(F.array_distinct(text))).alias("cand"))
    counts = marks.groupBy(*keys, "cand").agg(F.count("*").alias("nvotes"))
    made = simulate.simulate_pool(v.select(*keys, "card_key"), counts, SEED, keys, base.card_rows(spark, d))
    return made.where("cand is not null").groupBy(*keys, F.col("cand").alias("choice")).agg(F.count("*").alias("nvotes"))


@R.add(_SIMULATED.format(key="pool_id, ", where="pool_id is not null"))
def simulate_pool(spark: SparkSession, d: str) -> DataFrame:
    """Simulated votes of all pooled cards in all contests, of several votes and ranked ones too."""
    return simulated(spark, d, base.card_votes(spark, d).where("pool_id is not null"), ("pool_id", "contest_id"))


@R.add()
def fuzz_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of each contest, ranked ones too, whose marks were changed by fuzzing one card in a hundred."""
    v = base.card_votes(spark, d).join(base.contests(spark, d).select("contest_id", (F.col("num_ranks") > 0).alias("ranked")), "contest_id").select("card_key", "contest_id", "cands", "ranked")
    known = v.select("contest_id", F.explode("cands").alias("cand")).distinct()
    out = simulate.fuzz(v, known, 0.01, SEED)
    return out.groupBy("contest_id", "ranked").agg(F.count("*").alias("n"), F.count_if(F.col("fuzzed") != F.col("cands")).alias("changed"))


_SPEC = ", spec as (select contest_id, (200 + contest_id % 50)::bigint as ncards, ((200 + contest_id % 50) * (contest_id % 30) // 100)::bigint as under, (contest_id % 3)::bigint as phantoms from contests), sv as (select *, ncards - under - phantoms as valid from spec), sw as (select *, (valid * 102 + 199) // 200 as w from sv)"


@R.add(_SPEC + " select contest_id, cand, n as nvotes from (select contest_id, unnest([1, 2]) as cand, unnest([w, valid - w])::bigint as n from sw) where n > 0 union all select contest_id, 0, phantoms from sw where phantoms > 0 union all select contest_id, -1, under from sw where under > 0")
def synthetic_elections(spark: SparkSession, d: str) -> DataFrame:
    """Made-up contests with a margin of two per cent, undervotes and phantoms (0), tabulated again (-1: undervotes)."""
    n = F.col("ncards") - F.col("nundervotes") - F.col("nphantoms")
    spec = base.contests(spark, d).select("contest_id", (200 + F.col("contest_id") % 50).cast("bigint").alias("ncards"), (F.col("contest_id") % 3).cast("bigint").alias("nphantoms"), F.expr("(200 + contest_id % 50) * (contest_id % 30) div 100").alias("nundervotes"))
    spec = spec.withColumn("w", F.floor((n * 102 + 199) / 200).cast("bigint")).withColumn("candidates", F.array(F.struct(F.lit(1).alias("cand"), F.col("w").alias("nvotes")), F.struct(F.lit(2).alias("cand"), (n - F.col("w")).alias("nvotes"))))
    cand = F.when(F.col("phantom"), 0).when(F.size("cands") == 0, -1).otherwise(F.get("cands", F.lit(0)))
    return simulate.make_election(spec, SEED).groupBy("contest_id", cand.alias("cand")).agg(F.count("*").alias("nvotes"))


@R.add("select contest_id, pool_id, total_cards, nvotes, undervotes, total_cards - (nvotes + undervotes) // vote_for as missing from (select contest_id, pool_id, sum(len(cands))::bigint as nvotes, sum(greatest(vote_for - len(cands), 0))::bigint as undervotes, any_value(vote_for) as vote_for from cv join contests using (contest_id) where pool_id is not null group by all) join (select pool_id, count(*) as total_cards from cards group by all) using (pool_id)")
def vunder(spark: SparkSession, d: str) -> DataFrame:
    """Votes, undervotes and, of a pool's cards, how many lack the contest: all cards less (votes + undervotes) / vote_for."""
    v = base.card_votes(spark, d).where("pool_id is not null").join(base.contests(spark, d).select("contest_id", "vote_for"), "contest_id")
    g = v.groupBy("contest_id", "pool_id").agg(F.sum(F.size("cands")).alias("nvotes"), F.sum(F.greatest(F.col("vote_for") - F.size("cands"), F.lit(0))).alias("undervotes"), F.max("vote_for").alias("f"))
    cards = base.cards(spark, d).where("pool_id is not null").groupBy("pool_id").agg(F.count("*").alias("total_cards"))
    return g.join(cards, "pool_id").select("contest_id", "pool_id", "total_cards", "nvotes", "undervotes", F.expr("total_cards - (nvotes + undervotes) div f").alias("missing"))


# --- pooled audits ---------------------------------------------------------------------------------

_POOLS = """, pa as (select a.contest_id, a.winner, a.loser, pool_id, count(*) as ncards, sum(list_contains(cands, winner)::int) as w, sum(list_contains(cands, loser)::int) as l, ((sum(list_contains(cands, winner)::int) - sum(list_contains(cands, loser)::int)) / count(*) + 1) / 2 as pool_avg
   from cv join asn a using (contest_id) where pool_id is not null group by all)"""


def _averages(spark: SparkSession, d: str) -> DataFrame:
    return pools.pool_averages(base.card_votes(spark, d).where("pool_id is not null"), base.assertions(spark, d))


@R.add(_POOLS + " select pool_id, contest_id, winner, loser, ncards, round(pool_avg, 9) as pool_avg from pa")
def oa_wrap(spark: SparkSession, d: str) -> DataFrame:
    return _averages(spark, d).select(*pools.POOL, "ncards", r9(F.col("pool_avg"), "pool_avg"))


_VALUES = _POOLS + """, pv as (select pool_id, contest_id, winner, loser, kind, (case kind when 'loser' then 1 when 'other' then 1.5 else 2 end - pool_avg) * noerror as value, (case kind when 'loser' then l when 'other' then ncards - w - l else w end) / npop as rate
   from pa join asn using (contest_id, winner, loser), (select unnest(['loser', 'other', 'winner']) as kind))"""


@R.add(_VALUES + " select pool_id, contest_id, winner, loser, kind, round(value, 9) as value from pv")
def taus_oa(spark: SparkSession, d: str) -> DataFrame:
    return pools.pool_values(_averages(spark, d), base.assertions(spark, d)).select(*pools.POOL, "kind", r9(F.col("value"), "value"))


@R.add(_VALUES + " select pool_id, contest_id, winner, loser, kind, round(rate, 9) as rate from pv")
def pool_rates(spark: SparkSession, d: str) -> DataFrame:
    return pools.pool_values(_averages(spark, d), base.assertions(spark, d)).select(*pools.POOL, "kind", r9(F.col("rate"), "rate"))


@R.add(_VALUES + " select contest_id, winner, loser, round(value, 8) as value, round(sum(rate), 9) as rate from pv where rate > 0 group by contest_id, winner, loser, round(value, 8)")
def oa_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of equal values, summed over pools."""
    v = pools.pool_values(_averages(spark, d), base.assertions(spark, d)).where("rate > 0")
    return v.groupBy(*KEYS, F.round("value", 8).alias("value")).agg(r9(F.sum("rate"), "rate"))


@R.add(_B + _POOLS + " select b.contest_id, b.winner, b.loser, round(avg(case when b.pool_id is null then (1 - (ca - ma)) * noerror else (1 - (pool_avg - ma)) * noerror end), 9) as mean, count(*) as n from b left join pa using (pool_id, contest_id, winner, loser) group by all")
def bassort_oneaudit(spark: SparkSession, d: str) -> DataFrame:
    """Comparison values where pooled cards are compared with their pool's average; pairs are counted by kind before they meet the assertions."""
    p = base.pairs(spark, d).groupBy("pool_id", "contest_id", "phantom", "cands", "mvr").agg(F.count("*").alias("k"))
    mvr = F.when(F.col("phantom"), 0.0).otherwise(A.plurality(F.col("mvr"), F.col("winner"), F.col("loser")))
    out = pools.pooled_comparison(_against(p, spark, d), _averages(spark, d), mvr)
    return out.groupBy(*KEYS).agg(r9(F.sum(F.col("value") * F.col("k")) / F.sum("k"), "mean"), F.sum("k").alias("n"))


@R.add(_POOLS + ", x as (select c.contest_id, a.winner, a.loser, case when c.pool_id is null then (list_contains(cands, a.winner)::int - list_contains(cands, a.loser)::int + 1) * 0.5 else pool_avg end as v from cv c join asn a using (contest_id) left join pa p on p.pool_id = c.pool_id and p.contest_id = c.contest_id and p.winner = a.winner and p.loser = a.loser) select contest_id, winner, loser, round(avg(v), 9) as mean from x group by all")
def oa_assort_avg(spark: SparkSession, d: str) -> DataFrame:
    """The mean assorter value where a pooled card counts its pool's average."""
    v = base.card_votes(spark, d).withColumn("cands", F.when(F.col("pool_id").isNull(), F.col("cands"))).groupBy("pool_id", "contest_id", "cands").agg(F.count("*").alias("k"))
    v = v.join(base.assertions(spark, d).select(*KEYS), "contest_id").join(_averages(spark, d).select(*pools.POOL, "pool_avg"), pools.POOL, "left")
    value = F.when(F.col("pool_id").isNull(), A.plurality(F.col("cands"), F.col("winner"), F.col("loser"))).otherwise(F.col("pool_avg"))
    return v.groupBy(*KEYS).agg(r9(F.sum(value * F.col("k")) / F.sum("k"), "mean"))


@R.add(_POOLS + " select contest_id, winner, loser, round(sum(ncards * pool_avg) / sum(ncards), 9) as mean from pa group by all")
def oa_pool_avg(spark: SparkSession, d: str) -> DataFrame:
    return _averages(spark, d).groupBy(*KEYS).agg(r9(F.sum(F.col("ncards") * F.col("pool_avg")) / F.sum("ncards"), "mean"))


# --- verification ----------------------------------------------------------------------------------


@R.add("select 'id' as field, county_id::varchar || '/' || id as value, count(*) as n from cards group by all having count(*) > 1 union all select 'location', location, count(*) from cards group by all having count(*) > 1 union all select 'index', county_id::varchar || '/' || card_index, count(*) from cards group by all having count(*) > 1")
def v_unique(spark: SparkSession, d: str) -> DataFrame:
    """Ids, locations and indexes that more than one card has; one pass over the exploded fields."""
    pair = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    fields = F.array(pair("id", F.concat("county_id", F.lit("/"), "id")), pair("location", F.col("location")), pair("index", F.concat("county_id", F.lit("/"), "card_index")))
    return base.cards(spark, d).select(F.inline(fields)).groupBy("field", "value").agg(F.count("*").alias("n")).where("n > 1")


@R.add("select county_id, card_key from (select county_id, card_key, prn, lag(prn) over (partition by county_id order by card_index, card_key) as before from cards where prn is not null) where before >= prn")
def v_prn_order(spark: SparkSession, d: str) -> DataFrame:
    """Cards whose number is not above that of the card before them in the manifest."""
    cards = base.cards(spark, d).where("prn is not null").select("county_id", "card_key", "prn", "card_index")
    return prefix.previous(cards, ["county_id"], ["card_index", "card_key"], prefix.index_bucket("card_index", base.card_rows(spark, d)), "prn").where("before >= prn").select("county_id", "card_key")


@R.add(f"select card_key, coalesce(prn = {prn_sql(SEED, 'card_index')}, false) as correct from cards")
def v_prn_correct(spark: SparkSession, d: str) -> DataFrame:
    return base.cards(spark, d).select("card_key", F.coalesce(F.col("prn") == prn(SEED, F.col("card_index")), F.lit(False)).alias("correct"))


@R.add("select county_id, card_key from (select county_id, card_key, card_index, row_number() over (partition by county_id order by card_index, card_key) - 1 as want from cards where card_key % 101 <> 0) where card_index <> want")
def v_index_sequential(spark: SparkSession, d: str) -> DataFrame:
    """Cards whose index is not their place, in a manifest from which one card in a hundred and one was lost: all that come after."""
    cards = base.cards(spark, d).where("card_key % 101 <> 0").select("county_id", "card_key", "card_index")
    return prefix.place(cards, ["county_id"], ["card_index", "card_key"], prefix.index_bucket("card_index", base.card_rows(spark, d))).where("card_index <> place - 1").select("county_id", "card_key")


@R.add("select card_key, style_id from cards anti join (select style_id from style_contests where style_id % 7 <> 0) using (style_id)")
def v_style_exists(spark: SparkSession, d: str) -> DataFrame:
    """Cards whose style is not in the list of styles, from which those with a number divisible by seven were lost."""
    styles = base.card_votes(spark, d).where("style_id % 7 <> 0").select("style_id").distinct()
    return base.cards(spark, d).join(styles, "style_id", "left_anti").select("card_key", "style_id")


@R.add("select contest_id, nc, npop, (nc - ncast)::bigint as phantoms, npop >= nc and nc >= ncast as in_order from totals")
def v_npop(spark: SparkSession, d: str) -> DataFrame:
    return base.totals(spark, d).select("contest_id", "nc", "npop", (F.col("nc") - F.col("ncast")).alias("phantoms"), ((F.col("npop") >= F.col("nc")) & (F.col("nc") >= F.col("ncast"))).alias("in_order"))


@R.add("select contest_id, cand, coalesce(t.nvotes, 0)::bigint as reported, coalesce(x.nvotes, 0)::bigint as counted from tab t full join (select contest_id, cand, count(*) as nvotes from (select contest_id, unnest(cands) as cand from xv join contests using (contest_id) where num_ranks = 0) group by all) x using (contest_id, cand) where coalesce(t.nvotes, 0) <> coalesce(x.nvotes, 0)")
def v_clca_votes(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose votes differ between the cards and the export."""
    x = tabulate.candidate_votes(base.plain(base.cvr_votes(spark, d), spark, d)).withColumnRenamed("nvotes", "x")
    both = base.card_tab(spark, d).join(x, ["contest_id", "cand"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.where(zero("nvotes") != zero("x")).select("contest_id", "cand", zero("nvotes").alias("reported"), zero("x").alias("counted"))


@R.add("select contest_id, cand, sum(n)::bigint as nvotes from (select contest_id, cand, count(*) as n from (select contest_id, pool_id, unnest(cands) as cand from cv where not phantom) where pool_id is null group by all union all select contest_id, cand, count(*) from (select contest_id, pool_id, unnest(cands) as cand from cv where not phantom) where pool_id is not null group by all) group by all")
def v_oa_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes of cards outside pools plus the pools' subtotals."""
    v = base.card_votes(spark, d).where("not phantom")
    parts = tabulate.candidate_votes(v.where("pool_id is null")).unionByName(tabulate.candidate_votes(v.where("pool_id is not null"), ("pool_id",)).drop("pool_id"))
    return parts.groupBy("contest_id", "cand").agg(F.sum("nvotes").alias("nvotes"))


_CLAIMED = ", claimed as (select contest_id, winner, loser, reported_margin + case when winner % 5 = 0 then 0.01 else 0 end as margin from asn)"


@R.add(_CLAIMED + " select contest_id, winner, loser from (select contest_id, winner, loser, margin, avg((list_contains(cands, winner)::int - list_contains(cands, loser)::int + 1) * 0.5) as mean from (select contest_id, case when phantom then [] else cands end as cands from cv) join claimed using (contest_id) group by all) where abs(2 * mean - 1 - margin) > 1e-5")
def v_assort_avg(spark: SparkSession, d: str) -> DataFrame:
    """Assertions whose margin is not what the mean of the assorter says; those of a winner divisible by five claim one per cent too much."""
    from ballotlens.plans.ballots import assort_avg

    claimed = F.col("expected") + F.when(F.col("winner") % 5 == 0, 0.005).otherwise(0.0)
    return assort_avg(spark, d).where(2 * F.abs(F.col("mean") - claimed) > 1e-5).select(*KEYS)


@R.add(_POOLS + _CLAIMED + """, x as (select c.contest_id, a.winner, a.loser, case when c.pool_id is not null then pool_avg when c.phantom then 0.5 else (list_contains(cands, a.winner)::int - list_contains(cands, a.loser)::int + 1) * 0.5 end as v from cv c join asn a using (contest_id) left join pa p on p.pool_id = c.pool_id and p.contest_id = c.contest_id and p.winner = a.winner and p.loser = a.loser)
 select contest_id, winner, loser from (select contest_id, winner, loser, avg(v) as mean from x group by all) join claimed using (contest_id, winner, loser) where abs(2 * mean - 1 - margin) > 1e-5""")
def v_oa_avg(spark: SparkSession, d: str) -> DataFrame:
    """The same where pooled cards count their pool's average: phantoms in pools, whose marks the averages hold, show beside false claims."""
    v = base.card_votes(spark, d).join(base.assertions(spark, d).select(*KEYS, "reported_margin"), "contest_id").join(_averages(spark, d).select(*pools.POOL, "pool_avg"), pools.POOL, "left")
    value = F.when(F.col("pool_id").isNotNull(), F.col("pool_avg")).when(F.col("phantom"), 0.5).otherwise(A.plurality(F.col("cands"), F.col("winner"), F.col("loser")))
    mean = v.groupBy(*KEYS, "reported_margin").agg(F.avg(value).alias("mean"))
    claimed = F.col("reported_margin") + F.when(F.col("winner") % 5 == 0, 0.01).otherwise(0.0)
    return mean.where(F.abs(2 * F.col("mean") - 1 - claimed) > 1e-5).select(*KEYS)


@R.add(_POOLS + """, said as (select *, pool_avg + case when pool_id % 4 = 0 then 0.02 else 0 end as claim from pa)
 select pool_id, contest_id, winner, loser from (select c.pool_id, c.contest_id, s.winner, s.loser, claim, avg((list_contains(cands, s.winner)::int - list_contains(cands, s.loser)::int + 1) * 0.5) as mean from cv c join said s on s.pool_id = c.pool_id and s.contest_id = c.contest_id group by all) where abs(mean - claim) > 1e-5""")
def v_oa_pools(spark: SparkSession, d: str) -> DataFrame:
    """Pools whose stated average is not the mean of their cards; those of pools divisible by four state too much."""
    said = _averages(spark, d).withColumn("claim", F.col("pool_avg") + F.when(F.col("pool_id") % 4 == 0, 0.02).otherwise(0.0)).select(*pools.POOL, "claim")
    v = base.card_votes(spark, d).where("pool_id is not null").select("pool_id", "contest_id", "cands").join(said, ["pool_id", "contest_id"])
    mean = v.groupBy(*pools.POOL, "claim").agg(F.avg(A.plurality(F.col("cands"), F.col("winner"), F.col("loser"))).alias("mean"))
    return mean.where(F.abs(F.col("mean") - F.col("claim")) > 1e-5).select(*pools.POOL)


_READ = """, own as (select style_id, list_sort(list(contest_id)) as possible from style_contests group by all),
 mv as (select c.card_key, c.id, c.prn, c.card_index, case when card_key % 193 = 0 then c.id || 'x' else c.id end as mvr_id, case when card_key % 197 = 0 then c.prn + 1 else c.prn end as mvr_prn, case when card_key % 199 = 0 then card_index + 1 else card_index end as mvr_index,
   list_concat(list_filter(map_keys(votes), lambda k: card_key % 211 <> 0 or k <> list_min(map_keys(votes))), case when card_key % 223 = 0 then [999999] else [] end) as has, coalesce(possible, []) as possible, map_keys(votes) as own_contests from cards c left join own using (style_id))"""


@R.add(_READ + """ select card_key, fault from (select card_key, unnest(list_filter([case when mvr_id <> id then 'id' end, case when mvr_prn <> prn then 'prn' end, case when mvr_index <> card_index then 'index' end,
  case when len(list_filter(has, lambda k: not list_contains(possible, k))) > 0 then 'contest not possible' end, case when len(list_filter(own_contests, lambda k: not list_contains(has, k))) > 0 then 'contest missing' end], lambda f: f is not null)) as fault from mv)""")
def v_mvr_pairs(spark: SparkSession, d: str) -> DataFrame:
    """What does not fit between cards and hand readings, of which some have another id, number or index, lack a contest of an
    exact style, or hold one that the card's style does not have."""
    own = base.card_votes(spark, d).groupBy("style_id").agg(F.collect_set("contest_id").alias("possible"))
    k, keys = F.col("card_key"), F.map_keys("votes")
    m = base.cards(spark, d).join(own, "style_id", "left").withColumn("possible", F.coalesce("possible", F.array().cast("array<int>")))
    has = F.concat(F.when(k % 211 == 0, F.array_remove(keys, F.array_min(keys))).otherwise(keys), F.when(k % 223 == 0, F.array(F.lit(999999))).otherwise(F.array().cast("array<int>")))
    m = m.withColumn("has", F.coalesce(has, keys)).withColumn("mvr_id", F.when(k % 193 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id"))).withColumn("mvr_prn", F.when(k % 197 == 0, F.col("prn") + 1).otherwise(F.col("prn"))).withColumn("mvr_index", F.when(k % 199 == 0, F.col("card_index") + 1).otherwise(F.col("card_index")))
    fault = lambda c, n: F.when(c, F.lit(n))
    found = F.array(fault(F.col("mvr_id") != F.col("id"), "id"), fault(F.col("mvr_prn") != F.col("prn"), "prn"), fault(F.col("mvr_index") != F.col("card_index"), "index"), fault(F.size(F.array_except("has", "possible")) > 0, "contest not possible"), fault(F.size(F.array_except(keys, F.col("has"))) > 0, "contest missing"))
    return m.select("card_key", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("fault"))


@R.add(_ROUND2 + " select prn, prn in (select prn from drawn2) as kept from drawn")
def v_round_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Whether each card of the first round is in the second, too."""
    again = _round2(spark, d).withColumn("k", F.lit(True))
    return consistent_sampling(spark, d).join(again, "prn", "left").select("prn", F.col("k").isNotNull().alias("kept"))


@R.add("select 'description' as what, description as value, count(*) as n from contests group by all having count(*) > 1 union all select 'candidate name', contest_id || '/' || description, count(distinct candidate_id) from candidate_manifest where deleted_at is null group by all, contest_id, description having count(distinct candidate_id) > 1".replace("group by all, contest_id, description", "group by contest_id, description"))
def v_contest_unique(spark: SparkSession, d: str) -> DataFrame:
    """Names that more than one contest has, and names that more than one candidate of a contest has."""
    a = base.contests(spark, d).groupBy(F.col("description").alias("value")).agg(F.count("*").alias("n")).select(F.lit("description").alias("what"), "value", "n")
    k = table(spark, d, "candidate_manifest", "contest_id", "candidate_id", "description", "deleted_at").where("deleted_at is null")
    b = k.groupBy("contest_id", "description").agg(F.countDistinct("candidate_id").alias("n")).select(F.lit("candidate name").alias("what"), F.concat("contest_id", F.lit("/"), "description").alias("value"), "n")
    return a.unionByName(b).where("n > 1")


@R.add(", said as (select contest_id, cand from ranked where is_winner union all select contest_id, 999999 from contests where contest_id % 11 = 0) select contest_id, case when count(*) filter (r.cand is null) > 0 then 'unknown winner' else 'too many winners' end as fault from said s left join ranked r using (contest_id, cand) join (select contest_id as cid, vote_for from contests) c on c.cid = s.contest_id group by contest_id having count(*) filter (r.cand is null) > 0 or count(*) > max(c.vote_for)")
def v_winners(spark: SparkSession, d: str) -> DataFrame:
    """Contests whose stated winners are no candidates of it or too many; those divisible by eleven state one that is not known."""
    ranked = base.ranked(spark, d)
    said = ranked.where("is_winner").select("contest_id", "cand").unionAll(base.contests(spark, d).where("contest_id % 11 = 0").select("contest_id", F.lit(999999).alias("cand")))
    known = ranked.select("contest_id", "cand", F.lit(True).alias("known"))
    per = said.join(known, ["contest_id", "cand"], "left").groupBy("contest_id").agg(F.count_if(F.col("known").isNull()).alias("unknown"), F.count("*").alias("n")).join(base.contests(spark, d).select("contest_id", "vote_for"), "contest_id")
    return per.where("unknown > 0 or n > vote_for").select("contest_id", F.when(F.col("unknown") > 0, "unknown winner").otherwise("too many winners").alias("fault"))


MIN_RECOUNT, MIN_MARGIN, MIN_SIZE = 0.005, 0.0, 25


@R.add(f""", names as (select description, count(*) as c from contests group by all), w as (select contest_id, count(*) filter (is_winner) as n_winners, count(*) filter (not is_winner) as n_losers, count(*) as n_cands, min(nvotes) filter (is_winner) as lowest, max(nvotes) filter (not is_winner) as highest from ranked group by all),
 m as (select contest_id, min(winner_votes - loser_votes) as votes, min(recount_margin) as recount, min(diluted_margin) as margin from asn group by all)
 select contest_id, case when c > 1 or n_winners > least(n_cands, vote_for) then 'ContestMisformed' when n_winners = 0 then 'NoWinners' when n_losers = 0 then 'NoLosers' when lowest = highest then 'MinMargin' when nc - ncast >= votes then 'TooManyPhantoms' when recount <= {MIN_RECOUNT} or margin <= {MIN_MARGIN} then 'MinMargin' when nc <= {MIN_SIZE} then 'MinSize' else 'InProgress' end as status
 from contests join totals using (contest_id) left join names using (description) left join w using (contest_id) left join m using (contest_id) where num_ranks = 0 and n_cands is not null""")
def pre_audit_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a contest may be audited, and if not, the first reason: misformed (its name is not the only one of its kind, or too many
    winners), no winners, no losers, a tie, as many phantoms as the margin, a margin too small over the recount or the population, too few cards."""
    c = base.contests(spark, d).where("num_ranks = 0")
    names = base.contests(spark, d).groupBy("description").agg(F.count("*").alias("c"))
    won = F.col("is_winner")
    w = base.ranked(spark, d).groupBy("contest_id").agg(F.count_if(won).alias("n_winners"), F.count_if(~won).alias("n_losers"), F.count("*").alias("n_cands"), F.min(F.when(won, F.col("nvotes"))).alias("lowest"), F.max(F.when(~won, F.col("nvotes"))).alias("highest"))
    m = base.assertions(spark, d).groupBy("contest_id").agg(F.min(F.col("winner_votes") - F.col("loser_votes")).alias("votes"), F.min("recount_margin").alias("recount"), F.min("diluted_margin").alias("margin"))
    j = c.join(base.totals(spark, d), "contest_id").join(names, "description", "left").join(w, "contest_id").join(m, "contest_id", "left")
    status = F.when((F.col("c") > 1) | (F.col("n_winners") > F.least("n_cands", "vote_for")), "ContestMisformed").when(F.col("n_winners") == 0, "NoWinners").when(F.col("n_losers") == 0, "NoLosers").when(F.col("lowest") == F.col("highest"), "MinMargin")
    status = status.when(F.col("nc") - F.col("ncast") >= F.col("votes"), "TooManyPhantoms").when((F.col("recount") <= MIN_RECOUNT) | (F.col("margin") <= MIN_MARGIN), "MinMargin").when(F.col("nc") <= MIN_SIZE, "MinSize").otherwise("InProgress")
    return j.select("contest_id", status.alias("status"))


# --- county pipelines ------------------------------------------------------------------------------


@R.add(""", v as (select description, county_id, sum(coalesce(n, 0))::bigint as v, sum(nc)::bigint as nc from contests join totals using (contest_id) left join (select contest_id, sum(len(cands)) as n from xv group by all) using (contest_id) where description is not null and county_id is not null group by all)
 select description, county_id, v, floor(v / sum(v) over (partition by description) * sum(nc) over (partition by description) + 0.5)::bigint as share from v where v > 0""")
def county_distribute_nc(spark: SparkSession, d: str) -> DataFrame:
    """The bound of cards of all contests of one name, split over the counties that have it by their votes, rounded half up."""
    votes = base.cvr_votes(spark, d).groupBy("contest_id").agg(F.sum(F.size("cands")).alias("n"))
    c = base.contests(spark, d).where("description is not null and county_id is not null").join(base.totals(spark, d).select("contest_id", "nc"), "contest_id").join(votes, "contest_id", "left")
    v = c.groupBy("description", "county_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("v"), F.sum("nc").alias("nc")).where("v > 0")
    w = Window.partitionBy("description")  # a row for each county
    return v.select("description", "county_id", "v", F.floor(F.col("v") / F.sum("v").over(w) * F.sum("nc").over(w) + 0.5).alias("share"))


@R.add("select county_id, contest_id, style_id, n, round(n / sum(n) over (partition by county_id, contest_id), 9) as pct from (select county_id, contest_id, style_id, count(*) as n from cv group by all)")
def style_scale(spark: SparkSession, d: str) -> DataFrame:
    n = base.card_votes(spark, d).groupBy("county_id", "contest_id", "style_id").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("county_id", "contest_id")), 9))


@R.add("select county_id, count(*) as n_missing, min(contest_id) as first_missing from contests anti join (select distinct county_id, contest_id from cv) using (county_id, contest_id) group by all")
def missing_pool(spark: SparkSession, d: str) -> DataFrame:
    """Contests of a county that no style of its cards holds."""
    seen = base.card_votes(spark, d).select("county_id", "contest_id").distinct()
    return base.contests(spark, d).join(seen, ["county_id", "contest_id"], "left_anti").groupBy("county_id").agg(F.count("*").alias("n_missing"), F.min("contest_id").alias("first_missing"))


@R.add("select county_id, style_id, count(distinct cvr_key) as ncards, sum(len(cands))::bigint as nvotes from xv group by grouping sets ((county_id, style_id), (county_id), ())")
def county_cvr_pools(spark: SparkSession, d: str) -> DataFrame:
    """Cards and votes per county and style, per county and in all, in one pass."""
    per = base.cvr_votes(spark, d).groupBy("county_id", "style_id", "cvr_key").agg(F.sum(F.size("cands")).alias("v"))
    return per.groupingSets([["county_id", "style_id"], ["county_id"], []], "county_id", "style_id").agg(F.count("*").alias("ncards"), F.sum("v").alias("nvotes")).select("county_id", "style_id", "ncards", "nvotes")


@R.add("""select contest_id, greatest(nc, coalesce(mc, 0), ncast)::bigint as nc, exact_id as canon_id, round(least(1, nmvrs / population), 9) as rate from totals join contests using (contest_id) left join (select contest_id, max(ceil(v / vote_for)) as mc from (select contest_id, sum(len(cands)) as v, max(vote_for) as vote_for from xv join contests using (contest_id) group by all) group by all) using (contest_id)
 left join (select canonical_name as description, min(canon_id) as exact_id from canonical_names where name_kind = 'contest' group by all) using (description) left join (select county_id, count(*) as population, 10 + county_id % 5 as nmvrs from cards group by county_id) using (county_id)""")
def county_contest_build(spark: SparkSession, d: str) -> DataFrame:
    """Each contest with its bound (its cards, or the least that hold the exported votes), the canonical contest of its name, and its county's sampling rate."""
    v = base.cvr_votes(spark, d).join(base.contests(spark, d).select("contest_id", "vote_for"), "contest_id").groupBy("contest_id").agg(F.sum(F.size("cands")).alias("v"), F.max("vote_for").alias("f"))
    names = table(spark, d, "canonical_names").where("name_kind = 'contest'").groupBy(F.col("canonical_name").alias("description")).agg(F.min("canon_id").alias("canon_id"))
    strata = base.cards(spark, d).groupBy("county_id").agg(F.count("*").alias("population")).withColumn("nmvrs", 10 + F.col("county_id") % 5)
    t = base.totals(spark, d).join(base.contests(spark, d).select("contest_id", "county_id", "description"), "contest_id").join(v, "contest_id", "left").join(names, "description", "left").join(strata, "county_id", "left")
    return t.select("contest_id", F.greatest(F.col("nc"), F.coalesce(F.ceil(F.col("v") / F.col("f")), F.lit(0)), F.col("ncast")).cast("bigint").alias("nc"), "canon_id", r9(F.least(F.lit(1.0), F.col("nmvrs") / F.col("population")), "rate"))


def _sessions(kind: str) -> str:
    return f"select {kind} as pool, count(*) as ncards from cvrs group by all"


@R.add(_sessions("county_id::varchar || ':' || regexp_replace(id, '-[^-]*$', '')"))
def sf_session(spark: SparkSession, d: str) -> DataFrame:
    """Cards by scanning session."""
    return base.cvrs(spark, d).groupBy(F.concat("county_id", F.lit(":"), F.regexp_replace("id", "-[^-]*$", "")).alias("pool")).agg(F.count("*").alias("ncards"))


@R.add(_sessions("coalesce(precinct::varchar, '') || ':' || array_to_string(list_sort(map_keys(votes)), ' ')"))
def sf_precinct_style(spark: SparkSession, d: str) -> DataFrame:
    """Cards by precinct and set of contests."""
    key = F.concat(F.coalesce(F.col("precinct").cast("string"), F.lit("")), F.lit(":"), F.array_join(F.sort_array(F.map_keys("votes")), " "))
    return base.cvrs(spark, d).groupBy(key.alias("pool")).agg(F.count("*").alias("ncards"))


@R.add("select contest_id, cand, count(*) as ncards from (select contest_id, cand, unnest(range(1, nvotes + 1)) from tab) group by all")
def belgium_case(spark: SparkSession, d: str) -> DataFrame:
    """One card for each vote of a party list, counted again."""
    made = base.card_tab(spark, d).select("contest_id", "cand", F.explode(F.sequence(F.lit(1), F.col("nvotes"))).alias("k"))
    return made.groupBy("contest_id", "cand").agg(F.count("*").alias("ncards"))


@R.add(""", parts as (select county_id, count(*) as n_contests from contests group by all), r as (select distinct county_id, round_idx, wanted, len(sample_prns) as n_stored from audit_rounds), have as (select county_id, count(prn) as n_cards from cards group by all)
 select round_idx, count(*) as n_components, sum(coalesce(n_contests, 0))::bigint as n_contests, sum(wanted)::bigint as wanted, sum(coalesce(n_stored, 0))::bigint as n_mvrs, bool_and(coalesce(wanted, 0) <= coalesce(n_cards, 0)) as done from r left join parts using (county_id) left join have using (county_id) group by all""")
def composite_record(spark: SparkSession, d: str) -> DataFrame:
    """One record of all counties' records: contests and rounds together; a round is done if each county has cards for it; sums of counts."""
    rounds_ = table(spark, d, "audit_rounds").select("county_id", "round_idx", "wanted", F.size("sample_prns").alias("s")).distinct()
    parts = base.contests(spark, d).groupBy("county_id").agg(F.count("*").alias("n_contests"))
    have = base.cards(spark, d).groupBy("county_id").agg(F.count("prn").alias("n_cards"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = rounds_.join(parts, "county_id", "left").join(have, "county_id", "left")
    return j.groupBy("round_idx").agg(F.count("*").alias("n_components"), F.sum(zero("n_contests")).alias("n_contests"), F.sum("wanted").alias("wanted"), F.sum(F.greatest(zero("s"), F.lit(0))).alias("n_mvrs"), F.bool_and(zero("wanted") <= zero("n_cards")).alias("done"))


# --- seats under risk ------------------------------------------------------------------------------


@R.add(_DHONDT + " select cand % 10 as party, sum(seats)::bigint as seats from seats group by all")
def all_seats(spark: SparkSession, d: str) -> DataFrame:
    """Seats per party over all contests (parties: candidate ids modulo 10)."""
    return _seats(spark, d).groupBy((F.col("cand") % 10).alias("party")).agg(F.sum("seats").alias("seats"))


_GAPS = _DHONDT + """, gaps as (select a.contest_id, a.cand as winner, b.cand as loser, va.nvotes / a.last_won - vb.nvotes / b.first_lost as gap, t.nc from seats a join seats b on a.contest_id = b.contest_id and a.cand <> b.cand and a.last_won is not null and b.first_lost is not null
   join tab va on va.contest_id = a.contest_id and va.cand = a.cand join tab vb on vb.contest_id = b.contest_id and vb.cand = b.cand join totals t on t.contest_id = a.contest_id)"""


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    v = base.card_tab(spark, d)
    a = outcome.dhondt_assertions(_seats(spark, d))
    side = lambda n: v.select("contest_id", F.col("cand").alias(n), F.col("nvotes").alias("v_" + n))
    j = a.join(side("winner"), ["contest_id", "winner"]).join(side("loser"), ["contest_id", "loser"]).join(base.totals(spark, d).select("contest_id", "nc"), "contest_id")
    return j.withColumn("gap", F.col("v_winner") / F.col("last") - F.col("v_loser") / F.col("first"))


@R.add(_GAPS + " select contest_id, winner, loser, round(gap, 9) as gap, round(gap / nc, 9) as relative from gaps")
def score_range(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between the last seat won and the first lost."""
    return _gaps(spark, d).select(*KEYS, r9(F.col("gap"), "gap"), r9(F.col("gap") / F.col("nc"), "relative"))


_NOERR = """, sized as (select g.*, a.last_won as last, b.first_lost as first, t.npop, least(t.nc, 20 + g.contest_id % 7)::bigint as n from gaps g join seats a on a.contest_id = g.contest_id and a.cand = g.winner join seats b on b.contest_id = g.contest_id and b.cand = g.loser join totals t on t.contest_id = g.contest_id),
 ne as (select *, 1 / (2 - (gap * first / npop) / ((first / last + 1) / 2)) as noerror from sized), ks as (select *, unnest(range(1, least(n + 1, npop - 1) + 1)) as j from ne),
 at_risk as (select contest_id, winner, loser, exp(-sum(ln(1 + {bet} * (noerror - (npop * 0.5 - noerror * j) / (npop - j))))) as risk from ks group by all)""".format(bet=risk.STANDARD_BET)


@R.add(_GAPS + _NOERR + " select contest_id, winner, loser, round(risk, 6) as risk, risk > 0.05 as fails from at_risk")
def seat_risks(spark: SparkSession, d: str) -> DataFrame:
    """The risk left at each seat assertion after a first round without errors, and whether it is too large."""
    a = _gaps(spark, d).join(base.totals(spark, d).select("contest_id", "npop"), "contest_id").join(_wanted(spark, d), "contest_id")
    margin = F.col("gap") * F.col("first") / F.col("npop")
    a = a.withColumn("noerror", A.noerror(margin, A.dhondt_upper(F.col("last"), F.col("first")))).select(*KEYS, "npop", "noerror", "n")
    return risk.risk_left(a).select(*KEYS, r6(F.col("risk"), "risk"), (F.col("risk") > 0.05).alias("fails"))


def _unsafe(spark: SparkSession, d: str) -> DataFrame:
    sizes = base.totals(spark, d).select("contest_id", "npop").join(_wanted(spark, d), "contest_id")
    return written(risk.seat_failures(base.card_tab(spark, d), sizes, SEATS, MIN_FRACTION), "seats")


@R.add()
def seat_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Seats each party may have after a first round without errors: one less if any of its seats is not safe, one more if it may win one."""
    s = _unsafe(spark, d)
    f = s.select("contest_id", "cand", "reported", F.explode_outer("failures").alias("f"))
    own = f.groupBy("contest_id", "cand", "reported").agg(F.max((F.col("f.winner") == F.col("cand")).cast("int")).alias("l"), F.max((F.col("f.loser") == F.col("cand")).cast("int")).alias("w"), F.count("f").alias("failures"))
    return own.select("contest_id", "cand", (F.col("reported") - F.coalesce("l", F.lit(0))).alias("low"), "reported", (F.col("reported") + F.coalesce("w", F.lit(0))).alias("high"), "failures")


@R.add()
def all_seat_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The same summed over all contests, by party (candidate ids modulo 10)."""
    r = seat_ranges(spark, d)
    return r.groupBy((F.col("cand") % 10).alias("party")).agg(*[F.sum(c).alias(c) for c in ("low", "reported", "high")])


@R.add()
def coalition_seats(spark: SparkSession, d: str) -> DataFrame:
    """Seats of a coalition (even candidate ids), and how many it may lose to or gain from parties outside it."""
    s = _unsafe(spark, d)
    inside = lambda c: F.col(c) % 2 == 0
    own = s.groupBy("contest_id").agg(F.sum(F.when(inside("cand"), F.col("reported")).otherwise(0)).alias("reported"), F.first("failures").alias("f"))
    n = lambda test: F.size(F.filter("f", test)).cast("bigint")
    return own.select("contest_id", "reported", n(lambda x: (x["winner"] % 2 == 0) & (x["loser"] % 2 == 1)).alias("lost"), n(lambda x: (x["winner"] % 2 == 1) & (x["loser"] % 2 == 0)).alias("gained"))


# --- other bets ------------------------------------------------------------------------------------

_AGRAPA = "case when j = 0 then 0.5 else greatest(0, least(((total / j) - mu) / nullif(((sq / j) - (total / j) * (total / j)) + ((total / j) - mu) * ((total / j) - mu), 0), (0.5 + (0.9 - 0.5) * (1 - 1 / (1 + 1 * sqrt(j)))) / mu)) end"


@R.add(_POLL.replace("as total\n", "as total, coalesce(sum(x * x) over (partition by contest_id, winner, loser order by prn rows between unbounded preceding and 1 preceding), 0) as sq\n", 1) + f" select contest_id, winner, loser, prn, round({_AGRAPA}, 6) as lam from m where mu > 0 and mu < 1")
def agrapa_bet(spark: SparkSession, d: str) -> DataFrame:
    """The approximate growth-rate bet before each sample of a polling audit."""
    x = F.col("x").cast("double")
    run = prefix.before(_poll_sample(spark, d), KEYS, ["prn"], _bucket(spark, d), {"j": F.lit(1).cast("bigint"), "total": x, "q": x * x}).withColumn("mu", betting.mean_under_null(F.col("npop"), F.col("total"), F.col("j"))).where("mu > 0 and mu < 1")
    mean = F.try_divide(F.col("total"), F.col("j"))
    return run.select(*KEYS, "prn", r6(betting.agrapa(F.col("j"), mean, F.try_divide(F.col("q"), F.col("j")) - mean * mean, F.col("mu"), 0.5, 0.5, 0.9, 1.0), "lam"))


_OPTIMAL = "(((1 - 2 * noerror * (1 - 0.0001)) / (2 - 4 * noerror) + 2 * noerror * (1 - 0.0001) - 0.5) / nullif(mu, 0) - 1) / nullif(2 * noerror - mu, 0)"


@R.add(_CLCA.format(x="(1 - (ca - ma)) * noerror") + f" select contest_id, winner, loser, prn, round({_OPTIMAL}, 4) as lam from m where mu > 0.000001 and mu < 1 and noerror > 0.500001 and 2 * noerror - mu > 0.001")
def optimal_comparison_bet(spark: SparkSession, d: str) -> DataFrame:
    """The bet that is optimal if two-vote overstatements, one card in ten thousand, are the only errors, before each sample."""
    run = risk.running(_clca_sample(spark, d), KEYS, "prn", "value", _bucket(spark, d)).withColumn("mu", betting.mean_under_null(F.col("npop"), F.col("total"), F.col("j"))).where("mu > 0.000001 and mu < 1 and noerror > 0.500001 and 2 * noerror - mu > 0.001")
    return run.select(*KEYS, "prn", F.round(betting.optimal_comparison(2 * F.col("noerror"), 0.0001, F.col("mu")), 4).alias("lam"))


_FUZZ = ", fuzz as (select unnest([" + ", ".join(f"{{'k': {k}, 'tau': '{n}', 'rate': {r}::double}}" for k, rates in betting.FUZZ_RATES.items() for n, r in rates.items()) + "], recursive := true)), kc as (select contest_id, least(greatest(count(*), 2), 10) as k from tab group by all)"


@R.add(_FUZZ + " select contest_id, winner, loser, tau, round(0.01 * rate, 9) as rate, round(noerror * case tau when 'win-los' then 0 when 'win-oth' then 0.5 when 'oth-los' then 0.5 when 'los-oth' then 1.5 when 'oth-win' then 1.5 else 2 end, 9) as value from asn join kc using (contest_id) join fuzz using (k)")
def fuzz_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates and values of the errors that fuzzing one card in a hundred makes in each assertion, by how many candidates the contest has."""
    k = base.card_tab(spark, d).groupBy("contest_id").agg(F.least(F.greatest(F.count("*"), F.lit(2)), F.lit(10)).cast("int").alias("k"))
    rates = F.create_map(*[x for n, per in betting.FUZZ_RATES.items() for x in (F.lit(n), F.array(*[F.struct(F.lit(t).alias("tau"), F.lit(r).alias("rate")) for t, r in per.items()]))])
    rows = base.assertions(spark, d).select(*KEYS, "noerror").join(k, "contest_id").select(*KEYS, "noerror", F.inline(rates[F.col("k")]))
    tau = F.lit(0.0)
    for name in ("win-los", "win-oth", "oth-los", "los-oth", "oth-win", "los-win"):
        tau = F.when(F.col("tau") == name, A.general_tau(name, F.lit(1.0))).otherwise(tau)
    return rows.select(*KEYS, "tau", r9(0.01 * F.col("rate"), "rate"), r9(F.col("noerror") * tau, "value"))
