"""Audits: is what was claimed what was stored, and which source fields reach the tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators.extract import unwrap
from quorumlake.operators.joins import not_beneath
from quorumlake.operators.profiling import all_paths, detect_shape, schema_paths
from quorumlake.operators.skew import salted_join
from quorumlake.session import cut
from quorumlake.sources.documents import latest_snapshot, read_document
from quorumlake.sources.templates import Template, template_from

#: Fixed: the buckets of a replay.
BUCKETS = ["matched", "overridden", "collision", "gap", "unmapped"]


def replay(
    claims: DataFrame, canonical: DataFrame, mapped: Column, aliases: dict[str, str] | None = None, candidates: Sequence[tuple[str, Column]] | None = None
) -> DataFrame:
    """Every claim with its bucket.

    canonical: (entity_id, attribute, value_json) and, with several tables, table_name. candidates are
    looked up in order as (table, the claim's key there); the first table that has the claim's attribute
    under the key counts, null keys are skipped; without them the key is entity_id. mapped says for a
    claim whether its entity belongs to a table at all. A claim is unmapped, else matched if the stored
    value equals it or (stored as a list) holds it, else overridden if the winner (lowest priority, first
    emitted) matches and is another source's, else a collision if the winner is its own source's, else a
    gap. The ledger is written once (`cut`); joins are salted for entities with many claims.
    """
    names = F.create_map(*[F.lit(x) for p in (aliases or {}).items() for x in p]) if aliases else None
    attribute = F.coalesce(F.try_element_at(names, F.col("attribute")), F.col("attribute")) if aliases else F.col("attribute")
    key = ["entity_id", "_attribute"]
    ledger = cut(claims.filter("value_json is not null").withColumn("_attribute", attribute))
    winners = ledger.groupBy(*key).agg(
        F.min_by(F.struct("value_json", "source"), F.struct("priority", "seq")).alias("_winner")
    )
    if candidates is None:
        candidates = [("", F.col("entity_id"))]
    tables = canonical if "table_name" in canonical.columns else canonical.withColumn("table_name", F.lit(""))
    stored = tables.groupBy("table_name", "entity_id", F.col("attribute").alias("_attribute")).agg(F.min("value_json").alias("_stored"))
    # one lookup per group of claims, not per claim
    groups = winners
    for i, (name, entity) in enumerate(candidates):
        side = stored.filter(F.col("table_name") == name).select(F.col("entity_id").alias("_key"), "_attribute", F.struct("_stored").alias(f"_s{i}"))
        groups = groups.withColumn("_key", entity).join(side, ["_key", "_attribute"], "left").drop("_key")
    groups = groups.withColumn("_stored", F.coalesce(*[F.col(f"_s{i}") for i in range(len(candidates))])["_stored"])
    judged = salted_join(ledger, groups.select(*key, "_winner", "_stored"), key, F.struct("source", "seq"))

    def same(v: Column) -> Column:
        listed = F.try_parse_json("_stored").try_cast("array<variant>")
        return F.coalesce((F.col("_stored") == v) | F.exists(F.transform(listed, lambda x: F.to_json(x)), lambda x: x == v), F.lit(False))

    won = same(F.col("_winner.value_json"))
    bucket = (
        F.when(~mapped, "unmapped")
        .when(same(F.col("value_json")), "matched")
        .when(won & (F.col("_winner.source") != F.col("source")), "overridden")
        .when(won, "collision")
        .otherwise("gap")
    )
    return judged.withColumn("bucket", bucket).drop("_attribute", "_winner", "_stored")


def replay_report(replayed: DataFrame) -> DataFrame:
    """Counts per source and bucket."""
    return replayed.groupBy("source").pivot("bucket", BUCKETS).count().fillna(0, BUCKETS)


def coverage_tiers(fields: DataFrame, mapped: DataFrame, canonical: DataFrame, claimed: DataFrame, strict_names: bool = False) -> DataFrame:
    """(path, tier): CANONICAL if the field reaches a table, CLAIMS_ONLY if only claims, else MISSING.

    fields: path; mapped: (path, attribute) by the templates; canonical and claimed: attribute. With
    strict_names a path counts by its own name instead of the attribute it is mapped to.
    """
    named = fields.select("path").distinct()
    if strict_names:
        wide = named.select("path", F.col("path").alias("attribute"))
        via = mapped.select("path").distinct().withColumn("_mapped", F.lit(True))
        wide = wide.join(via, "path", "left")
    else:
        wide = named.join(mapped.select("path", "attribute").distinct(), "path", "left").withColumn("_mapped", F.col("attribute").isNotNull())
    known = canonical.select("attribute").distinct().withColumn("_c", F.lit(True))
    said = claimed.select("attribute").distinct().withColumn("_l", F.lit(True))
    marks = wide.join(known, "attribute", "left").join(said, "attribute", "left")
    best = marks.groupBy("path").agg(F.max(F.coalesce("_c", F.lit(False))).alias("c"), F.max(F.coalesce(F.col("_l"), F.col("_mapped"), F.lit(False))).alias("l"))
    return best.select("path", F.when(F.col("c"), "CANONICAL").when(F.col("l"), "CLAIMS_ONLY").otherwise("MISSING").alias("tier"))


def tier_counts(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def markdown(rows: list[dict], title: str) -> str:
    """A small report as a Markdown table."""
    if not rows:
        return f"# {title}\n\n(none)\n"
    head = list(rows[0])
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    lines += ["| " + " | ".join(str(r[h]) for h in head) + " |" for r in rows]
    return f"# {title}\n\n" + "\n".join(lines) + "\n"


def mapped_fields(t: Template) -> list[tuple[str, str]]:
    """(path within a record, attribute) of all that a template reads."""
    out = [(m["source_field"], a) for a, m in t.field_mappings.items()]
    out += [(m["fallback_field"], a) for a, m in t.field_mappings.items() if m.get("fallback_field")]
    for s in t.sub_records:
        out += [(f"{s.list_field}.{m['source_field']}", a) for a, m in s.field_mappings.items()]
    return out


def method_mismatch(walked: set[str], inferred: set[str], collapsed: set[str]) -> list[str]:
    """Paths that a walk over all records finds and schema inference doesn't, but for what lies at or
    below a path that inference leaves dynamic. Both sets are as large as a schema."""
    parents = lambda p: {p} | {p[:i] for i, c in enumerate(p) if c == "."}
    return sorted(p for p in walked - inferred if not parents(p) & collapsed)


#: Fixed: tables that hold no facts of their own.
META_TABLES = ("_meta", "_claims_ledger", "change_history", "schema_inventory", "discrepancies", "resolved")


def canonical_names(tables: Mapping[str, DataFrame], meta: Sequence[str] = META_TABLES) -> list[str]:
    """The names of all columns of all tables that hold facts: what a source's field may reach."""
    return sorted({c for n, df in tables.items() if n not in meta and not n.startswith("_") for c in df.columns})


def claimed_attributes(claims: DataFrame) -> DataFrame:
    """(source, attribute): what each source makes claims about."""
    return claims.select("source", "attribute").distinct()


def path_differences(walked: DataFrame, inferred: DataFrame, collapsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all paths of either way of finding them, paths only the walk found that don't lie at or below a
    collapsed one), both as (path)."""
    either = walked.select("path").unionByName(inferred.select("path")).distinct()
    only = walked.select("path").subtract(inferred.select("path"))
    return either, not_beneath(only, collapsed)


@dataclass(frozen=True)
class SourceCoverage:
    """What a source's documents hold and where it ends up."""

    source: str
    endpoints: dict[str, dict[str, list[str]]]  # endpoint -> tier -> fields
    untemplated: list[str]
    unreadable: list[str]
    mismatches: dict[str, list[str]]

    def counts(self) -> dict[str, int]:
        return {t: sum(len(e.get(t, [])) for e in self.endpoints.values()) for t in ("CANONICAL", "CLAIMS_ONLY", "MISSING")}


def source_coverage(
    spark: SparkSession, root: str | Path, source: str, templates: Mapping[str, Template], tables: Mapping[str, DataFrame], claims: DataFrame
) -> SourceCoverage:
    """Every field of every document of a source's last snapshot with its tier, found in two ways.

    Fields of all records count (unsampled): one distributed aggregate a document. A document that isn't
    JSON is unreadable; one without a template has no mapped field. Documents without records have no
    fields.
    """
    canonical = spark.createDataFrame([(n,) for n in canonical_names(tables)], "attribute string")
    claimed = claimed_attributes(claims).filter(F.col("source") == source).select("attribute")
    by_endpoint = {t.endpoint: t for t in templates.values() if t.source_key == source}
    snapshot = latest_snapshot(root, source)
    out = SourceCoverage(source, {}, [], [], {})
    for p in sorted((Path(root) / source / snapshot).glob("*.json")) if snapshot else []:
        if p.name.startswith("."):
            continue
        doc = read_document(spark, root, source, p.stem, snapshot)
        if doc.filter("doc is not null").isEmpty():
            out.unreadable.append(p.stem)
            continue
        t = by_endpoint.get(p.stem)
        if t is None:
            out.untemplated.append(p.stem)
            t = template_from({"source_key": source, "endpoint": p.stem, "record_extraction": shape_of_document(doc)})
        records = unwrap(doc, t)
        walked = all_paths(records)
        fields = spark.createDataFrame([(x,) for x in sorted(walked)], "path string")
        tiers = coverage_tiers(fields, spark.createDataFrame(mapped_fields(t), "path string, attribute string"), canonical, claimed).collect()
        out.endpoints[p.stem] = {tier: sorted(r.path for r in tiers if r.tier == tier) for tier in ("CANONICAL", "CLAIMS_ONLY", "MISSING")}
        missed = method_mismatch(walked, *schema_paths(records))
        if missed:
            out.mismatches[p.stem] = missed
    return out


def shape_of_document(doc: DataFrame) -> dict[str, Any]:
    """How to take records out of a document (one row) that has no template."""
    shape = detect_shape(json.loads(doc.select("text").first()["text"]))
    return {"unwrap_path": shape["path"], "iterate_mode": shape["mode"]} if shape else {"iterate_mode": "single_object"}


def coverage_markdown(found: Sequence[SourceCoverage]) -> str:
    """The report on all sources: counts by tier, then what is missing, untemplated or unreadable."""
    rows = [{"source": c.source, **{t.lower(): n for t, n in c.counts().items()}} for c in found]
    text = markdown(rows, "Field coverage")
    for c in found:
        notes = [f"- {e}: missing {', '.join(t['MISSING'])}" for e, t in sorted(c.endpoints.items()) if t.get("MISSING")]
        notes += [f"- {e}: no template" for e in c.untemplated] + [f"- {e}: not readable" for e in c.unreadable]
        notes += [f"- {e}: only found record by record: {', '.join(x)}" for e, x in sorted(c.mismatches.items())]
        if notes:
            text += f"\n## {c.source}\n\n" + "\n".join(notes) + "\n"
    return text


def coverage_report(endpoints: Mapping[str, tuple[DataFrame, Template]], canonical: DataFrame, claimed: DataFrame) -> list[dict]:
    """Per endpoint the number of fields in each tier, and the fields that reach nothing."""
    rows = []
    for name, (records, t) in sorted(endpoints.items()):
        spark = records.sparkSession
        fields = spark.createDataFrame([(p,) for p in sorted(all_paths(records))], "path string")
        tiers = coverage_tiers(fields, spark.createDataFrame(mapped_fields(t), "path string, attribute string"), canonical, claimed).collect()
        count = lambda x: sum(r.tier == x for r in tiers)  # noqa: B023, E731
        rows.append(
            {"endpoint": name, "canonical": count("CANONICAL"), "claims_only": count("CLAIMS_ONLY"), "missing": count("MISSING"),
             "missing_fields": ", ".join(sorted(r.path for r in tiers if r.tier == "MISSING"))}
        )
    return rows
