"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quorumlake.session import cut


def salts_of(df: DataFrame, salts: int | None = None) -> int:
    """Number of salts: as given, else the session's shuffle partitions."""
    return salts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: A key of fewer rows is never heavy, whatever its share.
LEAST_HEAVY = 50_000


def heavy_keys(df: DataFrame, keys: Sequence[str], least: int = LEAST_HEAVY) -> DataFrame | None:
    """(keys, _n): the keys that hold more than a quarter of an even partition's rows, with the number
    of tasks each should be spread over; None if there are none.

    At most four keys a shuffle partition can be that large, so the result is bounded by the session's
    settings, not by the data. One aggregate that combines before it shuffles; `df` is read once, so
    callers pass what is cheap to read. Nulls are no key.
    """
    spark = df.sparkSession
    most = 4 * salts_of(df)
    seen = Observation()
    sizes = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).observe(seen, F.sum("_n").alias("total"))
    top = sizes.filter(F.col("_n") >= least).orderBy(F.desc("_n")).limit(most).collect()
    if not top:
        return None
    share = max(least, seen.get["total"] / most)
    rows = [(*r[:-1], int(-(-r["_n"] // share))) for r in top if r["_n"] >= share]
    return spark.createDataFrame(rows, sizes.schema) if rows else None


def salted_join(
    large: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner", least: int = LEAST_HEAVY
) -> DataFrame:
    """Equi-join in which the heavy keys of `large` are spread over several tasks by the column `spread`.

    Only `small` rows of heavy keys are replicated, as often as the key's size asks for (`heavy_keys`);
    without heavy keys this is a plain join. how: inner, left, left_semi or left_anti. Nulls in keys
    match nothing. A join with replicated rows is a sort-merge join by hint, since runtime sizes are
    taken before the replication.
    """
    heavy = heavy_keys(large, keys, least)
    if heavy is None:
        return large.join(small, list(keys), how)
    heavy = F.broadcast(heavy)  # at most four rows a shuffle partition
    salts = F.coalesce(F.col("_n"), F.lit(1))
    left = large.join(heavy, list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_n")
    right = small.join(heavy, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int")))).drop("_n")
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def salted_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, salts: int | None = None) -> DataFrame:
    """Adds a number 0, 1, ... without gaps within each key; no task holds a whole key.

    Rows are spread by a hash of `order` (which must be unique in a key) and numbered within each
    salt; the starts of the salts come from one count per key and salt. The numbering is fixed by
    the data alone, so it is the same on every run.
    """
    n = salts_of(df, salts)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    w = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy(*keys, "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        .drop("_n")
    )
    local = salted.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)).cast("bigint") - 1
    )
    return local.join(starts, [*keys, "_salt"]).withColumn(name, F.col(name) + F.col("_start")).drop("_salt", "_start")


def lag_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the `value` of the row before, within `keys`, by `order` (unique in a key).

    Rows are range-partitioned on keys and order, so a large key spans many tasks; each task takes
    the row before from its own range, and the first row of a key in a range takes the last one of
    the ranges before (one row per key and range, compared in a second, small window).
    """
    ranged = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    marked = ranged.withColumn("_first", F.row_number().over(inner) == 1).withColumn(name, F.lag(value).over(inner))
    ends = ranged.groupBy(*keys, "_part").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    before = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_part")))
    return (
        marked.join(before, [*keys, "_part"], "left")
        .withColumn(name, F.when(F.col("_first"), F.col("_end")).otherwise(F.col(name)))
        .drop("_part", "_first", "_end")
    )


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the last non-null `value` up to and including the row, within `keys`, by `order` (unique in a key).

    Like `lag_in_order` a large key spans many tasks, and what crosses a border comes from one row per
    key and range.
    """
    ranged = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.filter(F.col(value).isNotNull()).groupBy(*keys, "_part").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    parts = ranged.select(*keys, "_part").distinct().join(ends, [*keys, "_part"], "left")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    return (
        ranged.join(parts, [*keys, "_part"], "left")
        .withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inner), F.col("_before")))
        .drop("_part", "_before")
    )
