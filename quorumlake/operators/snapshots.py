"""What changed between consecutive full snapshots: EXCEPT ALL both ways, then a full join of the residues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.operators.skew import salted_join
from quorumlake.session import cut

#: Tables of instants up to so many rows (16 bytes each) are sent to every executor.
MOST_SNAPSHOTS = 100_000


def with_instants(rows: DataFrame, instants: DataFrame, on: str, spread: Column) -> DataFrame:
    """rows joined with `instants` (a row per snapshot) by the snapshot column `on`.

    A snapshot holds a large share of all rows, so they are never shuffled by it as it is: up to
    MOST_SNAPSHOTS instants travel to the rows; more are joined with heavy snapshots salted by `spread`.
    """
    instants = cut(instants)
    if instants.count() <= MOST_SNAPSHOTS:
        return rows.join(F.broadcast(instants), on)
    return salted_join(rows, instants, [on], spread)


def last_loaded(df: DataFrame, key: Column, snapshot: Column, loaded: Column, content: dict[str, Column]) -> DataFrame:
    """One row (record_key, snapshot, digest) per key and snapshot: the row loaded last.

    The digest is SHA-256 over the canonical content, so later exchanges move 64 characters a record
    however wide it is. Of rows loaded at the same instant (null is the earliest) the largest digest
    counts. Rows with a null key or snapshot are no records and are left out.
    """
    digest = F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in content.items()])), 256)
    rows = df.select(key.alias("record_key"), snapshot.alias("snapshot"), loaded.alias("_loaded"), digest.alias("digest"))
    return (
        rows.dropna(subset=["record_key", "snapshot"])
        .groupBy("record_key", "snapshot")
        .agg(F.max(F.struct("_loaded", "digest")).alias("_last"))
        .select("record_key", "snapshot", F.col("_last.digest").alias("digest"))
    )


def snapshot_changes(records: DataFrame) -> DataFrame:
    """(snapshot, record_key, change_kind) between each snapshot and the one before it.

    `records` is what `last_loaded` returns. Each record counts +1 in its own snapshot and -1 in the
    next one; the signed count of identical records is EXCEPT ALL in both directions at once (one
    aggregate that combines before it shuffles), and only its residues meet in the full join by key
    that labels additions, removals and changes. The first snapshot has no predecessor and reports
    nothing; empty tables give an empty result.
    """
    records = cut(records)
    # one row per delivery; the only window without a key, over as many rows as there are snapshots
    by_time = Window.orderBy("snapshot")
    deliveries = records.select("snapshot").distinct()
    deliveries = deliveries.withColumn("_next", F.lead("snapshot").over(by_time)).withColumn("_first", F.row_number().over(by_time) == 1)
    placed = with_instants(records, deliveries, "snapshot", F.col("record_key"))
    sides = F.array_compact(
        F.array(
            F.when(~F.col("_first"), F.struct(F.col("snapshot").alias("s"), F.lit(1).alias("sign"))),
            F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("s"), F.lit(-1).alias("sign"))),
        )
    )
    signed = placed.select(F.explode(sides).alias("_s"), "record_key", "digest")
    residue = (
        signed.groupBy(F.col("_s.s").alias("snapshot"), "record_key", "digest").agg(F.sum("_s.sign").alias("_n")).filter("_n <> 0")
    )
    fresh = residue.filter("_n > 0").select("snapshot", "record_key", F.lit(True).alias("_new"))
    gone = residue.filter("_n < 0").select("snapshot", "record_key", F.lit(True).alias("_old"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return fresh.join(gone, ["snapshot", "record_key"], "full").select("snapshot", "record_key", kind.alias("change_kind"))


def keyed_diff(old: DataFrame, new: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Change-history rows between two builds of a table: (record_key, attribute, old_value, new_value).

    Every new key gives one `entity_created` row; every attribute that differs (null-safe, by its own
    type) gives one row with both values as text. Keys that are gone give nothing. Both sides have one
    row per key. Equal builds give no rows; against an empty old build every key is created.
    """
    left = new.select(F.col(key).alias("_k"), F.struct(*attributes).alias("_n"))
    right = old.select(F.col(key).alias("_k"), F.struct(*attributes).alias("_o"), F.lit(True).alias("_had"))
    both = left.join(right, "_k", "left")
    changes = [
        F.when(
            F.col("_had") & ~F.col(f"_n.`{a}`").eqNullSafe(F.col(f"_o.`{a}`")),
            F.struct(
                F.lit(a).alias("attribute"),
                F.col(f"_o.`{a}`").cast("string").alias("old_value"),
                F.col(f"_n.`{a}`").cast("string").alias("new_value"),
            ),
        )
        for a in attributes
    ]
    created = F.when(
        F.col("_had").isNull(),
        F.struct(
            F.lit("entity_created").alias("attribute"),
            F.lit(None).cast("string").alias("old_value"),
            F.col("_k").cast("string").alias("new_value"),
        ),
    )
    return (
        both.select(F.col("_k").cast("string").alias("record_key"), F.explode(F.array_compact(F.array(created, *changes))).alias("_c"))
        .select("record_key", "_c.*")
    )
