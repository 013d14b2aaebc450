"""Risk measures over sampled ballots: running sums where the bet depends on them only, folds over
the errors alone where it needs their order."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotlens.functions import betting
from ballotlens.operators import outcome, prefix


def running(samples: DataFrame, keys: list[str], order: str, value: str, bucket: Column | None = None) -> DataFrame:
    """samples with j (how many came before), total (their sum) for each row in order. bucket: see ``prefix.before``."""
    return prefix.before(samples, keys, [order], bucket, {"j": F.lit(1).cast("bigint"), "total": F.col(value).cast("double")})


def martingale(samples: DataFrame, keys: list[str], order: str, value: str, bet: Column, n: str, upper: Column | float, edge: float = 0.0, bucket: Column | None = None) -> DataFrame:
    """samples with mu, lam, log_t and p, the p-value after each sample.

    samples must have j and total (see ``running``); bet may use them and mu. A factor of 0 or less, or a null
    mean outside [0, upper], fixes what follows: mu < 0 gives p = 0, mu > upper p = 1, a factor of 0 p = 1.
    A mean within edge of 0 or upper is on the bound: sums of many values are not exact.
    """
    out = samples.withColumn("mu", betting.mean_under_null(F.col(n), F.col("total"), F.col("j"))).withColumn("lam", bet)
    factor = F.when((F.abs("mu") < 1e-12) | (F.abs(F.col("mu") - upper) < 1e-12), 1.0).otherwise(1 + F.col("lam") * (F.col(value) - F.col("mu")))
    # 1 for a lost bet, 2 for a mean below 0, 4 above the upper bound; the gravest so far rules
    state = F.when(F.col("mu") > upper + edge, 3).when(F.col("mu") < -edge, 2).when(F.col("factor") <= 0, 1).otherwise(0)
    out = out.withColumn("factor", factor).withColumn("gain", F.when(F.col("factor") > 0, F.log("factor")).otherwise(0.0)).withColumn("state", state)
    out = prefix.before(out, keys, [order], bucket, {"log_before": F.col("gain")}, {"state_before": F.col("state")})
    grave = F.greatest(F.col("state"), F.coalesce("state_before", F.lit(0)))
    out = out.withColumn("log_t", F.col("log_before") + F.col("gain"))
    p = F.when(grave == 3, 1.0).when(grave == 2, 0.0).when(grave == 1, 1.0).otherwise(F.least(F.lit(1.0), F.exp(-F.col("log_t"))))
    return out.withColumn("p", p).drop("factor", "gain", "state", "log_before", "state_before")


def decisions(run: DataFrame, keys: list[str], alpha: float, upper: Column | float, edge: float = 0.0) -> DataFrame:
    """Per key: samples (all), used (up to the first p below alpha, else all), p_value at that sample, min_p and status."""
    stop = F.min(F.when(F.col("p") < alpha, F.col("j") + 1))
    out = run.groupBy(*keys).agg(F.count("*").alias("samples"), stop.alias("stop"), F.min("p").alias("min_p"), F.max_by("p", "j").alias("last_p"), F.min_by("p", F.when(F.col("p") < alpha, F.col("j"))).alias("stop_p"), F.max((F.col("mu") > upper + edge).cast("int")).alias("above"), F.max((F.col("mu") < -edge).cast("int")).alias("below"))
    status = F.when(F.col("below") == 1, "sum_rejects_null").when(F.col("stop").isNotNull(), "rejects_null").when(F.col("above") == 1, "accept_null").otherwise("limit_reached")
    return out.select(*keys, "samples", F.coalesce("stop", "samples").alias("used"), F.coalesce("stop_p", "last_p").alias("p_value"), "min_p", status.alias("status"))


def alpha_mart(samples: DataFrame, keys: list[str], order: str, value: str, n: str, upper: float, eta0: str, d: int = 100, edge: float = 0.0, bucket: Column | None = None) -> DataFrame:
    """The polling martingale: the bet follows the shrunk and truncated estimate of the mean."""
    base = running(samples, keys, order, value, bucket)
    eta = betting.shrink_trunc(F.col(eta0), d, F.col("j"), F.col("total"), F.col("mu"), upper)
    return martingale(base, keys, order, value, betting.eta_to_lambda(eta, F.col("mu"), upper), n, upper, edge, bucket)


def error_free(samples: DataFrame, keys: list[str], order: str, value: str, n: str, upper: Column | float, max_loss: float = 0.9, edge: float = 0.0, bucket: Column | None = None) -> DataFrame:
    """The comparison martingale for samples without errors: the bet is max_loss / mu."""
    return martingale(running(samples, keys, order, value, bucket), keys, order, value, F.try_divide(F.lit(max_loss), F.col("mu")), n, upper, edge, bucket)


def adaptive(samples: DataFrame, keys: list[str], order: str, value: str, n: str, noerror: str, alpha: float, max_loss: float = 0.9, bucket: Column | None = None, pooled: DataFrame | None = None, is_pooled: str | None = None, previous: DataFrame | None = None) -> DataFrame:
    """Per key: used, p_value and status of the adaptive comparison audit.

    Samples are numbered by prefix sums, and only those whose value is not noerror reach the fold, as places and values in
    one row a key: a contest of any size is as large there as its errors. pooled: keys, value and rate of the values
    of pooled cards (a pooled audit); is_pooled: the column that tells which samples are pooled cards, whose values are no
    errors. previous: keys, samples, total, p_value and errors (map from value to count) of the round before, after which the samples come.
    """
    numbered = prefix.before(samples, keys, [order], bucket, {"j": F.lit(1).cast("bigint")})
    other = F.abs(F.col(value) - F.col(noerror)) > 1e-8 + 1e-5 * F.col(noerror)
    mark = F.struct("j", F.col(value).alias("value"), (~F.col(is_pooled) if is_pooled else F.lit(True)).alias("error"))
    one = numbered.groupBy(*keys).agg(F.count("*").alias("samples"), F.max(n).alias("n"), F.max(noerror).alias("noerror"), F.array_sort(F.collect_list(F.when(other, mark))).alias("marks"))
    if pooled is not None:
        one = one.join(pooled.groupBy(*keys).agg(F.collect_list(F.struct("value", "rate")).alias("pooled")), keys, "left")  # at most three values a pool
    if previous is not None:
        one = one.join(previous.select(*keys, F.struct("samples", "total", "p_value", "errors").alias("previous")), keys, "left")
    schema = T.StructType([*[samples.schema[k] for k in keys], T.StructField("used", T.LongType()), T.StructField("p_value", T.DoubleType()), T.StructField("status", T.StringType())])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rates = r.get("pooled")
                rates = None if not rates else (np.array([x["value"] for x in rates]), np.array([x["rate"] for x in rates]))
                bet = betting.AdaptiveBet(int(r["n"]), r["noerror"], 2 * r["noerror"], alpha, max_loss, pooled=rates)
                before = r.get("previous")
                if before:
                    bet.resume(before["samples"], before["total"], before["p_value"], dict(before["errors"] or []))
                skipped = bet.j
                used, p, status = betting.adaptive_runs(bet, r["samples"], [m["j"] for m in r["marks"]], [m["value"] for m in r["marks"]], [m["error"] for m in r["marks"]])
                rows.append([*[r[k] for k in keys], used - skipped, p, status])
            names = [f.name for f in schema]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in schema]))

    return one.mapInArrow(run, schema)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def needed_samples(assertions: DataFrame, alpha: float, max_loss: float = 0.9) -> DataFrame:
    """assertions with estimate: samples without errors until the risk limit (0: never). In batches, no shuffle."""
    schema = T.StructType([*assertions.schema.fields, T.StructField("estimate", T.IntegerType())])

    def run(batches):
        for pdf in batches:
            pdf["estimate"] = [betting.sample_size(ne, int(n), alpha, max_loss) for ne, n in zip(pdf["noerror"], pdf["npop"])]
            yield pdf

    return assertions.mapInPandas(run, schema)


#: The usual constant bet. Fixed value.
STANDARD_BET = 2 / 1.03905


def left_after(noerr: float, npop: int, n: int, bet: float = STANDARD_BET) -> float:
    """The p-value after n + 1 samples without errors under a constant bet; the null mean counts the sample at hand."""
    log_t = 0.0
    for begin in range(1, min(n + 1, npop - 1) + 1, 1 << 20):
        j = np.arange(begin, min(n + 1, npop - 1, begin + (1 << 20) - 1) + 1)
        factor = 1 + bet * (noerr - (npop * 0.5 - noerr * j) / (npop - j))
        if (factor <= 0).any():
            return 1.0
        log_t += float(np.log(factor).sum())
    return float(np.exp(-log_t)) if log_t > -700 else np.inf


def risk_left(assertions: DataFrame, bet: float = STANDARD_BET) -> DataFrame:
    """assertions (with npop, noerror and n) with risk: see ``left_after``."""
    schema = T.StructType([*assertions.schema.fields, T.StructField("risk", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            pdf["risk"] = [left_after(ne, int(npop), int(n), bet) for ne, npop, n in zip(pdf["noerror"], pdf["npop"], pdf["n"])]
            yield pdf

    return assertions.mapInPandas(run, schema)


def seat_failures(parties: DataFrame, sizes: DataFrame, seats: int, min_fraction: float, limit: float = 0.05) -> DataFrame:
    """contest_id, cand, reported, and failures, an array of (winner, last, loser, first) of the seats of that contest that are not safe.

    parties: contest_id, cand, nvotes; sizes: contest_id, npop and n (samples). See ``outcome.seat_failures``. A contest's parties are one group.
    """
    schema = "contest_id int, cand int, reported int, failures array<struct<winner: int, last: int, loser: int, first: int>>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        npop, n = int(pdf["npop"].iloc[0]), int(pdf["n"].iloc[0])
        votes = {int(c): int(v) for c, v in zip(pdf["cand"], pdf["nvotes"])}
        reported, failures = outcome.seat_failures(votes, seats, npop, min_fraction, lambda ne: left_after(ne, npop, n), limit)
        rows = [dict(zip(("winner", "last", "loser", "first"), f)) for f in failures]
        return pd.DataFrame({"contest_id": pdf["contest_id"].iloc[0], "cand": list(reported), "reported": list(reported.values()), "failures": [rows] * len(reported)})

    return parties.join(sizes, "contest_id").groupBy("contest_id").applyInPandas(run, schema)


def polling_trial(rng: np.random.Generator, winner_votes: int, loser_votes: int, npop: int, alpha: float, used: int = 0, total: float = 0.0, p_last: float = 1.0) -> int:
    """New cards until a polling audit of a shuffled electorate rejects (all that are left if never).

    Cards are drawn in growing chunks, each as counts of a hypergeometric draw that is then shuffled, so that memory and
    time follow the answer, not the electorate. used, total, p_last: of the round before, whose cards are not drawn again.
    """
    left = np.array([winner_votes, loser_votes, max(0, npop - winner_votes - loser_votes)], np.int64)
    n = int(left.sum())
    if used:  # cards already seen: as many winners more than losers as the sum says, the rest in proportion
        extra = int(round(2 * total - used))
        rest = np.minimum(left, np.array([max(extra, 0), max(-extra, 0), 0]))
        rest = rest + rng.multivariate_hypergeometric(left - rest, max(0, min(used, n) - int(rest.sum())), method="marginals")
        left = left - rest
    j, s, log_t, chunk = used, total, -np.log(p_last), 512
    eta0 = 0.5 + (winner_votes - loser_votes) / (2 * max(n, 1))
    while left.sum():
        take = int(min(chunk, left.sum()))
        counts = rng.multivariate_hypergeometric(left, take, method="marginals")
        left = left - counts
        x = np.repeat([1.0, 0.0, 0.5], counts)
        rng.shuffle(x)
        at = j + np.arange(take)
        sums = s + np.concatenate(([0.0], np.cumsum(x)[:-1]))
        mu = (n * 0.5 - sums) / (n - at)
        eta = np.minimum(np.maximum(mu + (eta0 - 0.5) / 2 / np.sqrt(100 + at), (100 * eta0 + sums) / (100 + at)), 1 - betting.EPSILON)
        with np.errstate(all="ignore"):
            logs = log_t + np.cumsum(np.log(np.maximum(1 + (eta / mu - 1) / (1 - mu) * (x - mu), 1e-300)))
        hit = np.flatnonzero((logs > -np.log(alpha)) | (mu < 0))
        if len(hit):
            return int(at[hit[0]]) + 1 - used
        j, s, log_t, chunk = j + take, float(sums[-1] + x[-1]), float(logs[-1]), min(2 * chunk, 1 << 20)
    return n - used


def simulate_polling(assertions: DataFrame, trials: int, alpha: float, seed: int = 1) -> DataFrame:
    """contest_id, winner, loser, trial and needed: cards until a polling audit of a shuffled electorate rejects (npop if never). See ``polling_trial``."""
    grid = assertions.select("contest_id", "winner", "loser", "winner_votes", "loser_votes", "npop").withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))

    def run(batches):
        for pdf in batches:
            pdf["needed"] = [polling_trial(np.random.default_rng([seed, r.contest_id, r.winner, r.loser, r.trial]), r.winner_votes, r.loser_votes, r.npop, alpha) for r in pdf.itertuples(index=False)]
            yield pdf[["contest_id", "winner", "loser", "trial", "needed"]]

    return grid.repartition(assertions.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "contest_id int, winner int, loser int, trial int, needed bigint")


def comparison_trial(assertions: DataFrame, cards: DataFrame, alpha: float, max_loss: float = 0.9, bucket: Column | None = None, previous: DataFrame | None = None) -> DataFrame:
    """contest_id, winner, loser, needed and status: new cards until a comparison audit rejects if no card but a phantom shows an error.

    assertions: contest_id, winner, loser, npop, noerror. cards: contest_id, prn and phantom of the cards in the order of
    the draw. A phantom counts as a one-vote overstatement. previous: see ``adaptive``; the cards it used, the first of the
    order, are skipped, and the trial starts at its last p-value and errors.
    """
    keys = ["contest_id", "winner", "loser"]
    numbered = prefix.before(cards, ["contest_id"], ["prn"], bucket, {"at": F.lit(1).cast("bigint")})
    rows = numbered.groupBy("contest_id").agg(F.count("*").alias("cards"), F.array_sort(F.collect_list(F.when(F.col("phantom"), F.col("at")))).alias("phantoms"))  # phantoms are few
    one = assertions.select(*keys, "npop", "noerror").join(rows, "contest_id")
    one = one.join(previous.select(*keys, F.struct("samples", "total", "p_value", "errors").alias("previous")), keys, "left") if previous is not None else one.withColumn("previous", F.lit(None).cast("struct<samples: bigint, total: double, p_value: double, errors: map<double,int>>"))
    schema = T._parse_datatype_string("contest_id int, winner int, loser int, needed bigint, status string")

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                bet, before = betting.AdaptiveBet(int(r["npop"]), r["noerror"], 2 * r["noerror"], alpha, max_loss), r["previous"]
                if before:
                    bet.resume(before["samples"], before["total"], before["p_value"], dict(before["errors"] or []))
                skip = bet.j
                at = [a - skip for a in r["phantoms"] if a >= skip]
                used, _, status = betting.adaptive_runs(bet, r["cards"] - skip, at, [r["noerror"] / 2] * len(at))
                rows.append([*[r[k] for k in keys], used - skip, status])
            names = [f.name for f in schema]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in schema]))

    return one.mapInArrow(run, schema)
