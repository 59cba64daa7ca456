"""Joins by which tables are assembled: marks, computed keys, fallbacks and prefix exclusion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mark_exists(rows: DataFrame, other: DataFrame, key: Column, other_key: Column, name: str) -> DataFrame:
    """rows with a boolean column: whether other has the key. A null key has no partner."""
    keys = other.select(other_key.alias("_k")).dropna().distinct().withColumn("_hit", F.lit(True))
    marked = rows.withColumn("_key", key).join(keys, F.col("_key") == F.col("_k"), "left")
    return marked.withColumn(name, F.col("_hit").isNotNull()).drop("_key", "_k", "_hit")


def first_by_key(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """(_k, _row): one row per key, the first by order; null keys are dropped."""
    return rows.select(key.alias("_k"), order.alias("_o"), F.struct(*rows.columns).alias("_r")).dropna(subset=["_k"]).groupBy("_k").agg(F.min_by("_r", "_o").alias("_row"))


def fallback_join(rows: DataFrame, other: DataFrame, keys: Sequence[Column], other_key: Column, other_order: Column, columns: Sequence[str]) -> DataFrame:
    """Left join on the first of several keys that finds a partner; the partner comes from one key as a whole.

    keys are tried in order; a null key is skipped. other has one row per key afterwards (the first).
    """
    build = first_by_key(other, other_key, other_order)
    out, found = rows, []
    for i, k in enumerate(keys):
        side = build.select(F.col("_k").alias(f"_k{i}"), F.col("_row").alias(f"_r{i}"))
        out = out.withColumn(f"_key{i}", k).join(side, F.col(f"_key{i}") == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_r{i}"))
    picked = F.coalesce(*found)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[picked.getField(c).alias(c) for c in columns])


def not_beneath(paths: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Paths that neither equal a collapsed path nor lie beneath one.

    Every path is looked up by all its own prefixes, so this is an equi-join instead of a comparison
    of every pair.
    """
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    hit = paths.select("path", F.explode(prefixes).alias("_p")).join(collapsed.select(F.col("path").alias("_p")).distinct(), "_p", "left_semi")
    return paths.join(hit.select("path").distinct(), "path", "left_anti")


def lookup(rows: DataFrame, other: DataFrame, key: Column, other_key: Column, columns: Sequence[str], defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """rows with columns of the partner (one row per key, the smallest of several), or defaults without one.

    A null key has no partner; columns of rows of the same names are replaced.
    """
    side = other.select(other_key.alias("_k"), F.struct(*columns).alias("_r")).dropna(subset=["_k"]).groupBy("_k").agg(F.min("_r").alias("_r"))
    joined = rows.withColumn("_key", key).join(side, F.col("_key") == F.col("_k"), "left")
    found = [F.coalesce(F.col("_r")[c], defaults[c]).alias(c) if defaults and c in defaults else F.col("_r")[c].alias(c) for c in columns]
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns if c not in columns], *found)


def name_join(rows: DataFrame, other: DataFrame, key: Column, other_key: Column, name: str = "k") -> DataFrame:
    """Left join of all rows with all partners of a computed key, which comes out as `name`."""
    return rows.withColumn(name, key).join(other.withColumn("_other", other_key), F.col(name) == F.col("_other"), "left").drop("_other")


def without_partner(rows: DataFrame, other: DataFrame, key: Column, other_key: Column) -> DataFrame:
    """The rows whose key the other table doesn't have; rows with a null key are among them."""
    keys = other.select(other_key.alias("_k")).dropna().distinct()
    return rows.withColumn("_key", key).join(keys, F.col("_key") == F.col("_k"), "left_anti").drop("_key")


def union_tagged(parts: Sequence[tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """Tables as one, each with its constant columns; a column that a table lacks is null there."""
    tagged = [df.select("*", *[c.alias(n) for n, c in tags.items()]) for df, tags in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def search(rows: DataFrame, terms: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows of which any column matches its term, without case: (column, contains | starts | equals, text)."""
    tests = {"contains": Column.contains, "starts": Column.startswith, "equals": Column.__eq__}
    hits = [tests[how](F.lower(F.col(c).cast("string")), F.lit(text.lower())) for c, how, text in terms]
    return rows.filter(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits], F.lit(False)))


def flag_counts(rows: DataFrame, by: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """Number of rows per group and combination of flags."""
    return rows.groupBy(*by, *[c.alias(n) for n, c in flags.items()]).agg(F.count(F.lit(1)).alias("n"))
