"""Audit rounds: estimate, draw, compare, decide, until every contest is done; each round is committed to the record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlens.operators import draws, risk
from ballotlens.scratch import new_path, written
from ballotlens.sources.records import commit_round, read_record

KEYS = ["contest_id", "winner", "loser"]


#: Tables of a round, in the order in which they are committed. Fixed values.
ROUND_TABLES = ("config", "estimates", "sample", "mvrs", "results", "state")


def run_rounds(compared: DataFrame | Callable[[DataFrame], DataFrame], card_contests: DataFrame | tuple[DataFrame, DataFrame], assertions: DataFrame, alpha: float, max_loss: float = 0.9, most_rounds: int = 7, growth: float = 1.8, folder: str | None = None, say: Callable[[str], None] | None = None) -> DataFrame:
    """round, contest_id, wanted, samples, done and status of each contest in each round it took part in.

    compared: KEYS, prn, value, npop and noerror of every card and assertion, or a function that gives these for drawn
    prns, so that cards not drawn are never compared. A round wants, for each open contest, the cards its hardest assertion needs without errors, times growth
    for each round before it, at most all its cards; earlier cards are always drawn again, as the order is by prn.
    card_contests: prn and contest_id, or prn and style_id of the cards beside style_id and contest_id of the styles; cards are
    kept by class (see ``draws.card_classes``), not beside each of their contests.
    folder: where the record's round tables go (by default the scratch folder): of each round its config, estimates,
    sample, mvrs (what was compared), results and state, each written once.
    """
    spark = assertions.sparkSession
    folder = folder or new_path(spark, "record")
    if isinstance(card_contests, DataFrame):
        own = card_contests.select("contest_id").distinct().select(F.col("contest_id").alias("style_id"), "contest_id")
        card_contests = (card_contests.select("prn", F.col("contest_id").alias("style_id")), own)
    classes, contests = draws.card_classes(*card_contests)
    contests = written(contests, "class-contests")
    classes = written(classes, "classes")
    sizes = written(contests.join(classes.groupBy("class").agg(F.count("*").alias("k")), "class").groupBy("contest_id").agg(F.sum("k").alias("cards")), "sizes")
    need = risk.needed_samples(assertions.select(*KEYS, "npop", "noerror"), alpha, max_loss).groupBy("contest_id").agg(F.max(F.when(F.col("estimate") == 0, F.col("npop")).otherwise(F.col("estimate"))).alias("need"))
    still = written(need.join(sizes, "contest_id"), "open")
    out = None
    for r in range(1, most_rounds + 1):
        if not still.limit(1).count():
            break
        wanted = written(still.select("contest_id", F.least(F.ceil(F.col("need") * growth ** (r - 1)), F.col("cards")).cast("bigint").alias("n")), "wanted")
        commit_round(spark.createDataFrame([(alpha, max_loss, growth, most_rounds)], "alpha double, max_loss double, growth double, most_rounds int"), folder, "config", r)
        commit_round(wanted, folder, "estimates", r)
        drawn = draws.consistent_sample_in_classes(classes, contests, wanted, sizes)
        commit_round(drawn, folder, "sample", r)
        sample = read_record(spark, folder, f"sample/round={r}").select("prn")
        seen = compared(sample) if callable(compared) else compared.join(sample, "prn", "left_semi")
        commit_round(seen.join(wanted.select("contest_id"), "contest_id", "left_semi"), folder, "mvrs", r)
        seen = read_record(spark, folder, f"mvrs/round={r}")
        results = risk.adaptive(seen.select(*KEYS, "prn", "value", "npop", "noerror"), KEYS, "prn", "value", "npop", "noerror", alpha, max_loss)
        commit_round(results, folder, "results", r)
        results = read_record(spark, folder, f"results/round={r}")
        good = F.col("status").isin("rejects_null", "sum_rejects_null")
        done = results.groupBy("contest_id").agg(F.bool_and(good).alias("done"), F.min("status").alias("status"), F.max("used").alias("samples"))
        part = written(wanted.join(done, "contest_id").select(F.lit(r).alias("round"), "contest_id", F.col("n").alias("wanted"), "samples", "done", "status"), "round")
        commit_round(part.drop("round"), folder, "state", r)
        out = part if out is None else out.unionAll(part)
        full = part.join(sizes, "contest_id").where("done or wanted >= cards").select("contest_id")
        still = written(still.join(full, "contest_id", "left_anti"), "open")
        if say:
            say(f"round {r}: {part.count()} contests, {still.count()} still open")
    if out is None:
        return spark.createDataFrame([], "round int, contest_id int, wanted bigint, samples int, done boolean, status string")
    return out
