"""Running sums over ordered groups of any size.

A window over a whole group sorts the group in one task. Where rows can be put into ranges of their order (buckets), the
buckets' sums are run over instead, a few rows each, and only what lies inside a bucket is sorted: a group with a third of
all rows is spread over as many tasks as it has buckets. Without buckets (small tables) a plain window does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket should hold at most, on average.
PER_BUCKET = 2_000_000


def number_bucket(number: str, rows: int, bits: int = 63) -> Column | None:
    """Ranges of a uniformly spread number below 2^bits, such as a pseudo-random number; None if one range is enough."""
    need = max(0, (max(1, -(-rows // PER_BUCKET)) - 1).bit_length())
    return None if not need else F.shiftright(F.col(number), bits - need)


def index_bucket(index: str, rows: int) -> Column | None:
    """Ranges of a dense index."""
    return None if rows <= PER_BUCKET else F.floor(F.col(index) / PER_BUCKET)


def _bucketed(df: DataFrame, keys: list[str], bucket: Column) -> tuple[DataFrame, list[str]]:
    part = [*keys, "__bucket"]
    # one exchange, which both the buckets' sums and the rows themselves use
    return df.withColumn("__bucket", bucket).repartition(*part), part


def before(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, sums: dict[str, Column], highs: dict[str, Column] | None = None) -> DataFrame:
    """df with, for each row, the sums (0 if none) and the maxima (null if none) over the rows of its keys before it in order.

    order must be unique within keys; bucket must not fall as order rises, and its rows must be of one size or so. Keys
    must not be null where there is a bucket.
    """
    highs = highs or {}
    names = {c: f"__{c}" for c in (*sums, *highs)}
    df = df.select("*", *[e.alias(names[c]) for c, e in (sums | highs).items()])

    def running(rows: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", *[F.coalesce(F.sum(names[c]).over(w), F.lit(0)).alias(c) for c in sums], *[F.max(names[c]).over(w).alias(c) for c in highs])

    if bucket is None:
        return running(df, keys).drop(*names.values())
    rows, part = _bucketed(df, keys, bucket)
    total = rows.groupBy(*part).agg(*[F.sum(names[c]).alias(f"{names[c]}_b") for c in sums], *[F.max(names[c]).alias(f"{names[c]}_b") for c in highs])
    w = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    total = total.select(*part, *[F.coalesce(F.sum(f"{names[c]}_b").over(w), F.lit(0)).alias(f"{names[c]}_o") for c in sums], *[F.max(f"{names[c]}_b").over(w).alias(f"{names[c]}_o") for c in highs])
    out = running(rows, part).join(total, part)
    add = [(F.col(c) + F.col(f"{names[c]}_o")).alias(c) for c in sums] + [F.greatest(c, f"{names[c]}_o").alias(c) for c in highs]
    return out.select(*[c for c in df.columns if c not in names.values()], *add)


def place(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, name: str = "place") -> DataFrame:
    """df with the place of each row among those of its keys, from 1."""
    return before(df, keys, order, bucket, {name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) + 1)


def previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None, value: str, name: str = "before") -> DataFrame:
    """df with the value of the row before each (null for the first of its keys). See ``before`` for order and bucket."""
    if bucket is None:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    rows, part = _bucketed(df, keys, bucket)
    last = rows.groupBy(*part).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("last"))
    last = last.select(*part, F.lag("last").over(Window.partitionBy(*keys).orderBy("__bucket")).alias("__last"))  # one row a bucket
    w = Window.partitionBy(*part).orderBy(*order)
    out = rows.withColumn(name, F.lag(value).over(w)).withColumn("__first", F.row_number().over(w) == 1).join(last, part)
    return out.withColumn(name, F.when(F.col("__first"), F.col("__last.v")).otherwise(F.col(name))).drop("__bucket", "__first", "__last")
