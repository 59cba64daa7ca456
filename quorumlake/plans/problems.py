"""Queries pN_... of the general problems, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions.clean import blank_to_null, canonical_json, canonical_value, instant_micros, norm_id, period_of, trimmed
from quorumlake.operators import drift, orphans, snapshots, variants, versions
from quorumlake.session import table


def update_log(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "change_history")
    return t.select(
        norm_id(t["entity_id"]).alias("entity_id"),
        norm_id(t["attribute"]).alias("attribute"),
        instant_micros(t["recorded_at"]).alias("at"),
        canonical_value(t["old_value"]).alias("old_value"),
        canonical_value(t["new_value"]).alias("new_value"),
        norm_id(t["source_key"]).alias("run"),
    )


def seconds(v: DataFrame) -> list:
    end = F.coalesce(F.floor(F.col("valid_to") / 1_000_000), F.lit(-1))
    return [F.floor(F.col("valid_from") / 1_000_000).cast("bigint").alias("valid_from_s"), end.cast("bigint").alias("valid_to_s")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per version of every attribute in the change log, whose sources are merged."""
    v = versions.build_versions(update_log(spark, d))
    return v.select("entity_id", "attribute", *seconds(v))


def snapshot_content(t: DataFrame, key: str) -> dict[str, Column]:
    """Every column of a snapshot table but key and instants, in a form that compares."""
    content = {}
    for f in t.schema:
        if f.name in (key, "snapshot_ts", "loaded_at"):
            continue
        c = t[f.name]
        if f.name in ("localized_names", "stat_buffs"):
            c = canonical_json(c)
        elif f.name == "species_slug":
            c = norm_id(c)
        elif f.dataType.typeName() == "string":
            c = blank_to_null(c)
        elif f.dataType.typeName() == "array":
            c = F.transform(c, trimmed)
        content[f.name] = c
    return content


SNAPSHOT_KEYS = {"species": "slug", "forms": "slug", "moves": "move_id"}


def p1_snapshot_history(spark: SparkSession, d: str) -> DataFrame:
    """Versions of all attributes of species, forms and moves, built from the periodic snapshots instead of the log."""
    out = None
    for name, key in SNAPSHOT_KEYS.items():
        t = table(spark, d, name)
        content = snapshot_content(t, key)
        # of several rows of a key in one snapshot the one loaded last counts
        last = (
            t.select(norm_id(t[key]).alias("_key"), "snapshot_ts", F.struct("loaded_at", *[c.alias(n) for n, c in content.items()]).alias("_r"))
            .groupBy("_key", "snapshot_ts")
            .agg(F.max("_r").alias("_r"))
        )
        log = versions.snapshots_as_log(
            last,
            F.concat(F.lit(f"{name}:"), F.col("_key")),
            F.unix_micros(F.col("snapshot_ts").cast("timestamp")),
            {n: F.to_json(F.col(f"_r.{n}")) if t.schema[n].dataType.typeName() == "array" else canonical_value(F.col(f"_r.{n}")) for n in content},
        )
        v = versions.build_versions(log)
        one = v.select("entity_id", "attribute", "value", *seconds(v))
        out = one if out is None else out.unionByName(one)
    return out


def snapshot_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The last-loaded records of the three snapshot tables, with content to compare."""
    out = {}
    for name, key in SNAPSHOT_KEYS.items():
        t = table(spark, d, name)
        out[name] = snapshots.last_loaded(t, norm_id(t[key]), t["snapshot_ts"], t["loaded_at"], snapshot_content(t, key))
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """What was added, removed or changed between consecutive snapshots of species, forms and moves."""
    out = None
    for name, records in snapshot_tables(spark, d).items():
        one = snapshots.snapshot_changes(records).select(
            F.lit(name).alias("table_name"), period_of(F.col("snapshot")).alias("period"), "record_key", "change_kind"
        )
        out = one if out is None else out.unionByName(one)
    return out


def p3_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of changes by table, period and kind."""
    return p3_found(spark, d).groupBy("table_name", "period", "change_kind").agg(F.count(F.lit(1)).alias("n_records"))


#: Tables whose records the change log names as `table:key`, with the kind of key.
LOGGED = {"species": "slug", "forms": "slug", "moves": "move_id"}


def reference_graph(spark: SparkSession, d: str) -> tuple[list[orphans.Reference], dict[str, DataFrame]]:
    """All references between the tables, and the keys of the tables they lead to.

    Forms, raid bosses and community days point to species of their period (the days by name). The
    entries of the change log, which have no period of their own, point to species, forms or moves of
    that table's last snapshot.
    """
    tables = {n: table(spark, d, n) for n in ("species", "forms", "moves", "raid_bosses", "community_days")}
    at = F.col("snapshot_ts").alias("period")
    parents = {n: tables[n].select(at, norm_id(F.col(k)).alias("key"), *([norm_id(F.col("name")).alias("name")] if n == "species" else [])) for n, k in LOGGED.items()}

    def rows(name: str, key: str, ref: Column) -> DataFrame:
        found = tables[name].select(at, norm_id(F.col(key)).alias("record_key"), F.col("snapshot_ts").alias("ref_period"), ref.alias("ref"), "loaded_at")
        found = found.dropna(subset=["record_key", "period"])
        if name == "forms":  # of several rows of a form in one snapshot the one loaded last counts
            found = found.groupBy("period", "record_key", "ref_period").agg(F.max(F.struct("loaded_at", "ref")).alias("_r")).withColumn("ref", F.col("_r.ref"))
        return found.select("period", "record_key", "ref_period", "ref")

    references = [
        orphans.Reference("forms", "species", rows("forms", "slug", norm_id(F.col("species_slug")))),
        orphans.Reference("raid_bosses", "species", rows("raid_bosses", "boss_id", F.translate(norm_id(F.col("pokemon_id")), "_", "-"))),
        orphans.Reference("community_days", "species", rows("community_days", "event_id", norm_id(F.col("featured_pokemon"))), "name"),
    ]
    entity = table(spark, d, "change_history").select(norm_id(F.col("entity_id")).alias("record_key")).distinct()
    for name in LOGGED:
        last = F.lit(tables[name].agg(F.max("snapshot_ts")).first()[0]).cast("timestamp_ntz")  # one value
        ref = F.expr(f"substring(record_key, {len(name) + 2})")
        log = entity.filter(F.col("record_key").startswith(f"{name}:")).select(last.alias("period"), "record_key", last.alias("ref_period"), ref.alias("ref"))
        references.append(orphans.Reference("change_history", name, log))
    return references, parents


def p4_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans of all tables that refer to others, the change log included."""
    found = orphans.cascade(*reference_graph(spark, d))
    return found.select("table_name", period_of(F.col("period")).alias("period"), "record_key", "orphan_kind", "depth").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphans of the cascade in forms, raid bosses and community days."""
    direct = p4_cascade(spark, d).filter((F.col("depth") == 0) & (F.col("table_name") != "change_history"))
    return direct.select("table_name", "period", "record_key", "orphan_kind")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans counted per table, period, kind and depth."""
    return p4_cascade(spark, d).groupBy("table_name", "period", "orphan_kind", "depth").agg(F.count(F.lit(1)).alias("n_records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every child record of every payload with the key of its parent."""
    return variants.nested_tables(table(spark, d, "raw_payloads")).select("payload_id", "child_kind", "parent_key", "child_key")


def p6_cp_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of CP bounds, all structural variants unified."""
    return variants.supertype(variants.nested_tables(table(spark, d, "raw_payloads")), "boss_cp").withColumnRenamed("value", "cp")


def p6_mega_stats(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of mega stats, all structural variants unified."""
    return variants.supertype(variants.nested_tables(table(spark, d, "raw_payloads")), "mega_stat").withColumnRenamed("value", "stat")


def p6_variants(spark: SparkSession, d: str) -> DataFrame:
    """How many payloads and rows each structural variant has."""
    rows = variants.nested_tables(table(spark, d, "raw_payloads")).filter("child_kind <> 'boss'")
    return rows.groupBy("child_kind", "variant").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("payload_id").alias("n_payloads"))


def payload_files(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "raw_payloads")
    return t.select(
        "payload_id", norm_id(t["mirror"]).alias("mirror"), norm_id(t["endpoint"]).alias("endpoint"), t["snapshot_ts"].alias("snapshot"), "payload"
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Schema changes of each file against the delivery before it."""
    return drift.schema_changes(payload_files(spark, d)).select("payload_id", "field_path", "change_kind", "new_path")


def p7_unified(spark: SparkSession, d: str) -> DataFrame:
    """All files in one consistent table: renamed fields under one name, every field with one type, misfits marked."""
    files = payload_files(spark, d)
    return drift.unified_records(files, drift.name_versions(drift.schema_changes(files)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_snapshot_history, p3_found, p3_summary, p4_found, p4_cascade, p4_report,
        p6_found, p6_cp_bounds, p6_mega_stats, p6_variants, p7_found, p7_unified,
    )
}
