"""References to records that do not exist, were deleted or come later.

References are pre-aggregated per key and period. Keys with a large share of all references (at most
1 / share of them) are checked against a broadcast of their own spells of validity; all other keys by
a shuffled anti join. Only groups that no single spell covers are looked at row by row, so a hot key
is never shuffled with its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlens.scratch import written

#: A key with more than this share of all references is heavy; there are fewer than 1 / HEAVY_SHARE.
HEAVY_SHARE = 0.001
#: A side is broadcast only if it was counted and has at most this many rows (of under 100 bytes).
BROADCAST_ROWS = 100_000
KEY = ["reference_name", "missing_key"]


@dataclass(frozen=True)
class Reference:
    """name: how it is reported. rows: record_id, missing_key (may be null) and at, the record's time.
    parent: missing_key, loaded_at and deleted_at, the spells of validity [loaded_at, deleted_at)."""

    name: str
    rows: DataFrame
    parent: DataFrame


def _fits(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _fits(df) else df


def _covers(begin: Column, end: Column) -> Column:
    return (F.col("p.loaded_at") <= begin) & (F.col("p.deleted_at").isNull() | (end < F.col("p.deleted_at")))


def find_orphans(references: list[Reference], heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """One row for each orphan reference: reference_name, record_id, missing_key, at, orphan_kind.

    A reference is an orphan if its key has no spell of validity at the record's time: ``missing`` if the
    parent never has the key, else ``late`` if its first loaded_at is after that time, else ``deleted``.
    Null keys are no references. A null time: such a reference is an orphan only if its key is missing,
    as nothing else can be said. A spell with a null loaded_at is valid from the beginning. Repeated
    rows give one orphan. Empty parents make every reference missing.
    """
    rows = spells = None
    for r in references:
        a = r.rows.where(F.col("missing_key").isNotNull()).select(F.lit(r.name).alias("reference_name"), F.col("record_id").cast("bigint"), F.col("missing_key").cast("bigint"), F.col("at").cast("timestamp_ntz").alias("at"))
        b = r.parent.where(F.col("missing_key").isNotNull()).select(F.lit(r.name).alias("reference_name"), F.col("missing_key").cast("bigint"), F.coalesce(F.col("loaded_at").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("loaded_at"), F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"))
        rows = a if rows is None else rows.unionAll(a)
        spells = b if spells is None else spells.unionAll(b)
    rows = written(rows.withColumn("period", F.to_date("at")), "references")
    spells = spells.distinct()
    groups = written(rows.groupBy(*KEY, "period").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at")), "reference-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    heavy = groups.groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") > heavy_share * total).select(*KEY, F.lit(True).alias("heavy"))  # under 1 / heavy_share rows
    groups = groups.join(F.broadcast(heavy), KEY, "left")
    heavy_spells = spells.join(F.broadcast(heavy), KEY, "left_semi")

    def split(df: DataFrame, uncovered) -> DataFrame:
        """What no spell covers: heavy keys by broadcast, the others by a shuffled anti join."""
        hot = uncovered(df.where("heavy"), _maybe_broadcast(heavy_spells))
        return hot.unionAll(uncovered(df.where("heavy is null"), spells))

    def by_group(df: DataFrame, side: DataFrame) -> DataFrame:
        on = (F.col("g.reference_name") == F.col("p.reference_name")) & (F.col("g.missing_key") == F.col("p.missing_key"))
        return df.alias("g").join(side.alias("p"), on & _covers(F.col("g.first_at"), F.col("g.last_at")), "left_anti").select("g.*")

    first = spells.groupBy(*KEY).agg(F.min("loaded_at").alias("first_loaded"))
    open_groups = written(split(groups, by_group).join(first, KEY, "left").select(*KEY, "period", "first_loaded", "heavy"), "open-groups")
    on = [F.col("r.reference_name") == F.col("o.reference_name"), F.col("r.missing_key") == F.col("o.missing_key"), F.col("r.period").eqNullSafe(F.col("o.period"))]
    beside = lambda part, groups: part.alias("r").join(groups.alias("o"), on).select("r.reference_name", "r.record_id", "r.missing_key", "r.at", "o.first_loaded", "o.heavy")
    if _fits(open_groups):
        hit = beside(rows, F.broadcast(open_groups))
    else:
        # no row of a heavy key is shuffled: its groups are broadcast in slices, each against all rows
        hot = open_groups.where("heavy")
        slices = -(-hot.count() // BROADCAST_ROWS)
        hit = beside(rows.join(F.broadcast(heavy.select(*KEY)), KEY, "left_anti"), open_groups.where("heavy is null"))
        for i in range(slices):
            part = hot.where(F.pmod(F.xxhash64(*KEY, "period"), F.lit(slices)) == i)
            hit = hit.unionAll(beside(rows, F.broadcast(part) if slices == 1 else _maybe_broadcast(part)))

    def by_row(df: DataFrame, side: DataFrame) -> DataFrame:
        on = (F.col("g.reference_name") == F.col("p.reference_name")) & (F.col("g.missing_key") == F.col("p.missing_key"))
        return df.alias("g").join(side.alias("p"), on & _covers(F.col("g.at"), F.col("g.at")), "left_anti").select("g.*")

    kind = F.when(F.col("first_loaded").isNull(), "missing").when(F.col("first_loaded") > F.col("at"), "late").when(F.col("at").isNotNull(), "deleted")
    found = split(hit, by_row).withColumn("orphan_kind", kind).where("orphan_kind is not null")
    return found.select("reference_name", "record_id", "missing_key", "at", "orphan_kind").distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references per referring table, kind and day."""
    return orphans.groupBy("reference_name", "orphan_kind", F.to_date("at").alias("period")).agg(F.count("*").alias("n_orphans"), F.countDistinct("missing_key").alias("n_keys"))
