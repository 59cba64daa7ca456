"""Trust resolution: one value per entity and attribute, and every disagreement on record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.skew import salted_join
from quorumlake.session import cut

KEY = ["entity_id", "attribute"]


def resolve(claims: DataFrame) -> DataFrame:
    """(entity_id, attribute, value_json, winning_source, n_claims, n_distinct).

    The claim of the lowest priority wins, of equals the first emitted; null values don't compete.
    One shuffle: the partial aggregates carry one candidate a group and task, however large the
    group; distinct values are counted after a first aggregate by value, so a hot group spreads.
    """
    by_value = (
        claims.filter("value_json is not null")
        .groupBy(*KEY, "value_json")
        .agg(F.min(F.struct("priority", "seq", "source")).alias("_best"), F.count(F.lit(1)).alias("_n"))
    )
    return by_value.groupBy(*KEY).agg(
        F.min_by("value_json", "_best").alias("value_json"),
        F.min("_best").getField("source").alias("winning_source"),
        F.sum("_n").alias("n_claims"),
        F.count(F.lit(1)).alias("n_distinct"),
    )


def disputed_claims(claims: DataFrame, written: bool = False) -> DataFrame:
    """Every non-null claim of a group in which sources disagree, one row each, with the group's winner.

    The same content as `discrepancies` without gathering a group in one row. The claims are written once
    (unless they already are: written) and read for the winners and for the rows; groups that hold many
    of them are salted.
    """
    said = claims.filter("value_json is not null").select(*KEY, "source", "value_json", "priority", "seq")
    said = said if written else cut(said)
    torn = resolve(said).filter("n_distinct > 1").select(*KEY, F.col("value_json").alias("resolved_value"), "winning_source")
    return salted_join(said, torn, KEY, F.struct("source", "seq"))


def discrepancies(claims: DataFrame, written: bool = False) -> DataFrame:
    """(entity_id, attribute, claims, resolved_value, winning_source, kind) where sources disagree.

    claims lists all non-null claims as emitted. kind is `self` if all come from one source. Only
    groups found to disagree are gathered; where a group may be too large for one row, take
    `disputed_claims`.
    """
    grouped = (
        disputed_claims(claims, written)
        .groupBy(*KEY, "resolved_value", "winning_source")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "source", "value_json"))).alias("_l"), F.min("source").alias("_a"), F.max("source").alias("_b"))
    )
    return grouped.select(
        *KEY,
        F.transform("_l", lambda x: F.struct(x["source"].alias("source"), x["value_json"].alias("value"))).alias("claims"),
        "resolved_value",
        "winning_source",
        F.when(F.col("_a") == F.col("_b"), "self").otherwise("cross_source").alias("kind"),
    )


def pivot_entities(resolved: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row per entity with a JSON text column per attribute asked for."""
    return resolved.groupBy("entity_id").pivot("attribute", list(attributes)).agg(F.first("value_json", ignorenulls=True))


def upsert(rows: DataFrame, entity_column: str, resolved: DataFrame, targets: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Rows whose columns take resolved values where there are any.

    targets: column -> (attribute, type). Rows without resolved values stay as they are; so do
    columns whose resolved value doesn't fit the type. Column names of rows are kept.
    """
    wide = pivot_entities(resolved.filter(F.col("attribute").isin([a for a, _ in targets.values()])), sorted({a for a, _ in targets.values()}))
    wide = wide.select(F.col("entity_id").alias("_entity"), *[F.col(a).alias(f"_r_{a}") for a in sorted({a for a, _ in targets.values()})])
    joined = rows.join(wide, rows[entity_column] == wide["_entity"], "left")
    out = []
    for c in rows.columns:
        if c in targets:
            attribute, kind = targets[c]
            out.append(F.coalesce(F.try_variant_get(F.try_parse_json(f"_r_{attribute}"), "$", kind), rows[c].cast(kind)).alias(c))
        else:
            out.append(rows[c])
    return joined.select(*out)


def first_seen(claims: DataFrame) -> DataFrame:
    """Distinct entities with the place at which each was first emitted."""
    return claims.groupBy("entity_id").agg(F.min("seq").alias("first_seq"))
