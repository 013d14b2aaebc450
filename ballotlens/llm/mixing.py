"""Mixing sources to target shares of all tokens, by iterative proportional fitting.

Token totals of the cells (source, language, topic) are raked to the marginals of all three: the sources' target
shares, and target shares of languages and topics (by default the corpus's own). The fitted weight of a
cell is how often each of its texts is used on average. Whole uses are given to every text, the
fractional use by a sample with the calibrated probabilities: texts in the order of hash / probability
until the source has its tokens. The order is cut by sums over hash buckets, so that no source is sorted in one task.

Languages and topics with less than MIN_SHARE of the tokens are raked together as one, so that there are at most
sources x (1 / MIN_SHARE + 1)^2 cells, however many values the corpus has. The vocabulary file must be at the same
path on every executor, or be sent along with ``SparkContext.addFile`` (see ``vocabulary``).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotlens.llm.words import kept
from ballotlens.scratch import written

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: The split of a text before byte pairs are merged, as the public vocabulary's readers define it. Fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 1024
CELL = ["source", "lang", "topic"]
#: Languages and topics with a smaller share of all tokens are one class, OTHER, of their own.
MIN_SHARE, OTHER = 0.01, "*other*"


def vocabulary(path: str) -> str:
    """The file itself, or, where it does not exist on this machine, the one of its name that was sent along with addFile."""
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


def encoder(path: str):
    """The byte-level tokenizer of a .tiktoken vocabulary file, made once in a process."""
    import tiktoken

    def make():
        with open(vocabulary(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    return kept("encoder_" + path, make)


def count_tokens(documents: DataFrame, columns: list[str], path: str) -> DataFrame:
    """The columns, text_key (a 128-bit hash of the text) and n_tokens of each document; null texts have none."""
    schema = documents.select(*columns).schema.add("text_key", T.StringType()).add("n_tokens", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).encode_ordinary
        for batch in batches:
            n = [len(count(t)) if t else 0 for t in batch.column(len(columns) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns) + 1], pa.array(n, pa.int64())], names=[f.name for f in schema])

    return documents.select(*columns, F.md5("text").alias("text_key"), "text").mapInArrow(run, schema)


def rake(tokens: np.ndarray, cells: list[tuple], caps: np.ndarray, marginals: list[dict], total: float, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Uses of each cell such that tokens * uses meets the marginals, each use at most its cap; and the gap that is left:
    the largest of |got - wanted| over all groups, as a share of total.

    marginals: for each part of the cells' keys, the share of total that each value should have (None for
    values that are left free). The first is met last, and exactly where the caps allow. Where no cap binds, a cell's
    uses are a product of one factor for each of its values, the least change of the corpus that meets the marginals.
    """
    uses = np.minimum(np.ones(len(tokens)), caps)
    groups = []
    for d, shares in enumerate(marginals):
        for value, share in shares.items():
            at = np.array([i for i, c in enumerate(cells) if c[d] == value], int)
            if len(at) and share is not None:
                groups.append((at, share * total))
    first = len([1 for v, s in marginals[0].items() if s is not None and any(c[0] == v for c in cells)])
    order = groups[first:] + groups[:first]
    for _ in range(rounds):
        before = uses.copy()
        for at, want in order:
            for _ in range(20):  # what capped cells cannot give, the others of the group give
                got = float(tokens[at] @ uses[at])
                if got <= 0 or abs(got - want) <= 1e-9 * max(want, 1):
                    break
                free = at if want < got else at[uses[at] < caps[at]]
                held = got - float(tokens[free] @ uses[free])
                if not len(free) or got == held:
                    break
                uses[free] = np.minimum(uses[free] * max(0.0, (want - held) / (got - held)), caps[free])
        if np.max(np.abs(uses - before), initial=0) < 1e-10:
            break
    return uses, max((abs(float(tokens[at] @ uses[at]) - want) for at, want in groups), default=0.0) / max(total, 1e-300)


def _large(texts: DataFrame, column: str) -> dict[str, float]:
    """The values of a column with at least MIN_SHARE of the tokens, at most 1 / MIN_SHARE of them, with their shares; and OTHER with the rest."""
    by = texts.groupBy(column).agg(F.sum("n_tokens").alias("n"))
    total = float(by.agg(F.sum("n")).first()[0] or 0)
    got = {r[column]: r.n / total for r in by.where(F.col("n") >= MIN_SHARE * total).collect()} if total else {}
    rest = 1 - sum(got.values())
    return got | ({OTHER: rest} if rest > 1e-12 else {})


def mix(documents: DataFrame, targets: DataFrame, topic: Column, path: str | None = None, total_tokens: float | None = None, lang_shares: dict | None = None, topic_shares: dict | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The plan and the goals of a mix.

    Plan: doc_id, source, lang, topic, lang_class, topic_class, n_tokens, copies and uses (the calibrated weight) of every
    text that is used. Goals: part (source, lang or topic), value, target_share and fitted_share (what the fit gives).
    targets: source, target_share and max_repeats. Shares are scaled to a sum of 1 over the sources that have
    tokens. total_tokens: the size of the mix; by default the most for which every source can give its share
    within its repeats. lang_shares, topic_shares: marginals of classes; by default their shares of the tokens of all
    sources with a target, as they are before mixing. Equal texts count as one text, of the row with the least doc_id, so
    that no text is used more than max_repeats times. Sources without a target, null and empty texts are not used. A null
    source is the source "", a null language "und".
    """
    spark = documents.sparkSession
    path = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    want = {r.source: (r.share, r.cap) for r in targets.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect() if r.share and r.cap}  # one row a source: what is asked for
    plan_schema, goal_schema = "doc_id bigint, source string, lang string, topic string, lang_class string, topic_class string, n_tokens bigint, copies int, uses double", "part string, value string, target_share double, fitted_share double"
    slim = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(topic, F.lit("none")).alias("topic"), "text").where(F.col("source").isin(*want))
    first = F.min_by(F.struct("doc_id", *CELL), "doc_id")
    counted = count_tokens(slim, ["doc_id", *CELL], path).where("n_tokens > 0")
    texts = written(counted.groupBy("text_key").agg(first.alias("d"), F.max("n_tokens").alias("n_tokens")).select("d.*", "text_key", "n_tokens"), "texts")
    langs, topics = _large(texts, "lang"), _large(texts, "topic")
    class_of = lambda c, known: F.when(F.col(c).isin(*known), F.col(c)).otherwise(F.lit(OTHER)).alias(f"{c}_class")
    texts = texts.select("*", class_of("lang", langs), class_of("topic", topics))
    keys = ["source", "lang_class", "topic_class"]
    rows = sorted(texts.groupBy(*keys).agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: tuple(r)[:3])  # bounded, see above
    if not rows:
        return spark.createDataFrame([], plan_schema), spark.createDataFrame([], goal_schema)
    cells, tokens, caps = [tuple(r)[:3] for r in rows], np.array([float(r.n) for r in rows]), np.array([float(want[r.source][1]) for r in rows])
    by_source = {s: float(sum(t for t, c in zip(tokens, cells) if c[0] == s)) for s in {c[0] for c in cells}}
    scale = sum(want[s][0] for s in by_source)
    share = {s: want[s][0] / scale for s in sorted(by_source)}
    most = min(want[s][1] * by_source[s] / share[s] for s in by_source)
    total = min(total_tokens or most, most)
    marginals = [share, lang_shares or langs, topic_shares or topics]
    uses, _ = rake(tokens, cells, caps, marginals, total)
    fitted_share = lambda d, v: float(sum(t * u for t, u, c in zip(tokens, uses, cells) if c[d] == v)) / total
    goals = [(part, v, float(x) if x is not None else None, fitted_share(d, v)) for d, part in enumerate(CELL) for v, x in marginals[d].items()]
    fitted = spark.createDataFrame([(*c, float(u)) for c, u in zip(cells, uses)], "source string, lang_class string, topic_class string, uses double")
    goal = spark.createDataFrame([(s, share[s] * total) for s in by_source], "source string, goal double")
    weighed = texts.join(F.broadcast(fitted), keys).withColumn("whole", F.floor("uses").cast("int")).withColumn("part", F.col("uses") - F.floor("uses"))  # a row a cell
    luck = (F.pmod(F.xxhash64("text_key", F.lit(seed)), F.lit(2**40)) + 0.5) / float(2**40)
    weighed = weighed.withColumn("key", F.when(F.col("part") > 1e-9, luck / F.col("part"))).withColumn("bucket", F.least(F.floor(F.col("key") * (BUCKETS // 2)), F.lit(BUCKETS)).cast("int"))
    weighed = written(weighed, "weighed")
    given = weighed.groupBy("source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("given"))
    room = goal.join(given, "source").select("source", (F.col("goal") - F.col("given")).alias("room"))
    sums = weighed.where("bucket is not null").groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    run = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))  # at most BUCKETS + 1 rows a source
    sums = sums.withColumn("upto", run).join(room, "source").select("source", "bucket", (F.col("upto") - F.col("n")).alias("below"), "upto", "room")
    marked = weighed.join(F.broadcast(sums), ["source", "bucket"], "left")  # at most BUCKETS + 1 rows a source with a target
    inside = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key", "text_key"))
    cut = marked.where("below < room and upto > room").withColumn("s", F.col("below") + inside)  # one bucket a source
    # the text across the goal is taken if that brings the source nearer to it
    cut = cut.withColumn("more", (F.col("s") - F.col("n_tokens") / 2.0 <= F.col("room")).cast("int"))
    rest = marked.where("not coalesce(below < room and upto > room, false)").withColumn("more", F.coalesce((F.col("upto") <= F.col("room") + 0.5).cast("int"), F.lit(0)))
    columns = ["doc_id", *CELL, "lang_class", "topic_class", "n_tokens", "whole", "more", "uses"]
    out = cut.select(*columns).unionAll(rest.select(*columns)).withColumn("copies", F.col("whole") + F.col("more"))
    plan = out.where("copies > 0").select("doc_id", *CELL, "lang_class", "topic_class", "n_tokens", "copies", "uses")
    return plan, spark.createDataFrame(goals, goal_schema)


def mix_sources(documents: DataFrame, targets: DataFrame, topic: Column, **options) -> DataFrame:
    """The plan of ``mix``: doc_id, source, lang, topic, n_tokens, copies and uses."""
    return mix(documents, targets, topic, **options)[0].drop("lang_class", "topic_class")


def shares(plan: DataFrame, goals: DataFrame) -> DataFrame:
    """Per part (source, lang, topic) and value: target_share, fitted_share, tokens, actual_share, n_texts and most_copies;
    values that gave nothing have 0. plan, goals: see ``mix``."""
    used = F.array(*[F.struct(F.lit(p).alias("part"), F.col(c).alias("value")) for p, c in (("source", "source"), ("lang", "lang_class"), ("topic", "topic_class"))])
    rows = plan.select(F.inline(used), "n_tokens", "copies")
    got = rows.groupBy("part", "value").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_texts"), F.max("copies").alias("most_copies"))
    all_tokens = plan.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("all_tokens"))
    out = goals.join(got, ["part", "value"], "left").join(F.broadcast(all_tokens))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("part", "value", "target_share", "fitted_share", zero("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), zero("n_texts"), zero("most_copies"))
