"""References to records that do not exist: direct orphans by period, and what they pull down with them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.skew import salted_join
from quorumlake.session import cut


@dataclass(frozen=True)
class Reference:
    """Rows (period, record_key, ref_period, ref) of a child table that point to a parent table's records.

    ref_period is the period in which the parent must hold the record (the child's own, usually); by
    is the column of the parent's keys that ref means (its key, or another name of the record).
    """

    child: str
    parent: str
    rows: DataFrame
    by: str = "key"


#: A record that a reference leads to: the table, the kind of key, the period in which it must be there, the key.
TARGET = ["parent", "by", "ref_period", "ref"]


def missing_targets(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows (period, record_key and TARGET) whose target isn't among the keys (TARGET), with orphan_kind.

    The references are reduced to distinct targets before they meet the keys; the join back to the rows
    is salted for targets that many rows share.
    """
    missing = rows.select(*TARGET).distinct().join(keys, TARGET, "left_anti")
    span = keys.groupBy("parent", "by", "ref").agg(F.min("ref_period").alias("_min"), F.max("ref_period").alias("_max"))
    kind = (
        F.when(F.col("_min") < F.col("ref_period"), "deleted").when(F.col("_max") > F.col("ref_period"), "late").otherwise("missing")
    )
    status = missing.join(span, ["parent", "by", "ref"], "left").select(*TARGET, kind.alias("orphan_kind"))
    return salted_join(rows, status, TARGET, F.struct("period", "record_key"))


def edges_of(r: Reference) -> DataFrame:
    return r.rows.dropna(subset=["ref"]).select(
        F.lit(r.child).alias("table_name"), "period", "record_key", F.lit(r.parent).alias("parent"), F.lit(r.by).alias("by"), "ref_period", "ref"
    )


def keys_of(parent: str, by: str, records: DataFrame) -> DataFrame:
    return records.select(F.lit(parent).alias("parent"), F.lit(by).alias("by"), F.col("period").alias("ref_period"), F.col(by).alias("ref")).dropna()


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def direct_orphans(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows (period, record_key, ref_period, ref) of one reference whose parent record is missing in its
    period, with orphan_kind.

    parents: (period, key), any repeats. orphan_kind is `deleted` if an earlier period has the record,
    else `late` if a later one has it, else `missing`. Null references are no case; repeated child rows
    come out once.
    """
    edges = edges_of(Reference("", "", rows)).distinct()
    return missing_targets(edges, keys_of("", "key", parents).distinct()).select("period", "record_key", "ref", "orphan_kind")


def cascade(references: list[Reference], parents: dict[str, DataFrame]) -> DataFrame:
    """Fixpoint over the foreign-key graph: (table_name, period, record_key, orphan_kind, depth).

    parents: per table (period, key) and the columns that references name in `by`. Periods and keys have
    one type each throughout. Depth 0 are direct orphans. A row whose parent record is itself an orphan
    (of the referenced period) is `inherited`, at the depth of the shortest chain of references. All
    references are one table of distinct edges; each round semi-joins it with the records that became
    orphans in the round before, and it stops when nothing new can follow, so cycles end too. A row may be
    a direct orphan by several references; it then comes out per kind.
    """
    edges = cut(union(edges_of(r) for r in references).distinct())
    kinds = sorted({(r.parent, r.by) for r in references})
    keys = union(keys_of(p, by, parents[p]) for p, by in kinds).distinct()
    row = ["table_name", "period", "record_key"]
    direct = missing_targets(edges, keys).select(*row, "orphan_kind", F.lit(0).alias("depth"))
    rounds = [cut(direct.distinct())]
    while True:
        frontier = rounds[-1]
        # as many rows as there are tables
        lost_in = {r.table_name for r in frontier.select("table_name").distinct().collect()}
        if not any(p in lost_in for p, _ in kinds):
            break
        lost = [frontier.select(F.col("table_name").alias("parent"), F.lit("key").alias("by"), F.col("period").alias("ref_period"), F.col("record_key").alias("ref"))]
        for p, by in kinds:
            if p in lost_in and by != "key":
                gone = frontier.filter(F.col("table_name") == p).select("period", F.col("record_key").alias("key"))
                lost.append(keys_of(p, by, parents[p].join(gone, ["period", "key"], "left_semi")))
        fresh = salted_join(edges, union(lost).distinct(), TARGET, F.struct("period", "record_key"), "left_semi").select(*row).distinct()
        for known in rounds:
            fresh = fresh.join(known.select(*row), row, "left_anti")
        fresh = cut(fresh.withColumn("orphan_kind", F.lit("inherited")).withColumn("depth", F.lit(len(rounds))))
        if fresh.isEmpty():
            break
        rounds.append(fresh)
    return union(rounds)
