"""Profiling of a source's documents: shape, fields, identity, gender signals, ranges, and a template draft."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlake.functions import variant as V
from quorumlake.functions.transforms import shape_fingerprint
from quorumlake.operators.extract import unwrap
from quorumlake.sources.documents import latest_snapshot, read_document
from quorumlake.sources.templates import template_from

SAMPLE = 200


def detect_shape(payload: Any, max_depth: int = 4) -> dict[str, Any] | None:
    """Where one document's records are: {path, mode, n_records}, the least deep and largest candidate.

    A list is a record list if its first 20 items are all objects; an object of which more than half
    the members are record lists is one candidate as a whole. Works on one parsed document.
    """

    def is_records(v: Any) -> bool:
        return isinstance(v, list) and bool(v) and all(isinstance(x, dict) for x in v[:20])

    found: list[tuple[int, int, list[str], str]] = []
    queue: list[tuple[Any, list[str]]] = [(payload, [])]
    for v, path in queue:
        if is_records(v):
            found.append((len(path), -len(v), path, "top_level_list"))
        elif isinstance(v, dict):
            lists = [x for x in v.values() if is_records(x)]
            if v and 2 * len(lists) > len(v):
                found.append((len(path), -sum(map(len, lists)), path, "dict_of_lists"))
            elif len(path) < max_depth:
                queue.extend((x, [*path, k]) for k, x in v.items())
    if not found:
        return None
    depth, n, path, mode = min(found, key=lambda x: x[:2])
    return {"path": path, "mode": mode, "n_records": -n}


def sampled(records: DataFrame, sample: int | None) -> DataFrame:
    """The first records of a file by pos, or all of them with None."""
    return records if sample is None else records.orderBy("pos").limit(sample)


def record_fields(records: DataFrame) -> DataFrame:
    """(pos, path, value) of every field, nested ones one level down with a dot."""
    top = records.select("pos", F.explode(V.entries(F.col("record"))).alias("path", "value"))
    below = top.filter(V.kind(F.col("value")) == "object").select("pos", "path", F.explode(V.entries(F.col("value"))).alias("_k", "_v"))
    return top.unionByName(below.select("pos", F.concat_ws(".", "path", "_k").alias("path"), F.col("_v").alias("value")))


def catalog_fields(records: DataFrame, sample: int | None = SAMPLE) -> DataFrame:
    """(path, n_present, types, example): presence, types by name and the first non-null example.

    Looks at the first `sample` records, or all of them with None.
    """
    rows = record_fields(sampled(records, sample))
    rows = rows.select("pos", "path", V.kind(F.col("value")).alias("_t"), V.canonical(F.col("value")).alias("_x"))
    return rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_present"),
        F.array_sort(F.collect_set("_t")).alias("types"),
        F.min_by("_x", F.when(F.col("_x").isNotNull(), F.col("pos"))).alias("example"),
    )


def rank_identities(records: DataFrame, sample: int | None = SAMPLE) -> DataFrame:
    """(path, n_unique, rank): text or number fields that all records have, the most distinct first."""
    rows = sampled(records, sample)
    total = rows.count()
    top = rows.select("pos", F.explode(V.entries(F.col("record"))).alias("path", "value"))
    scalar = top.filter(V.kind(F.col("value")).isin("string", "number")).select("pos", "path", V.canonical(F.col("value")).alias("_x"))
    counted = scalar.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("_x").alias("n_unique")).filter(F.col("_n") == total)
    # as many rows as a record has fields
    return counted.select("path", "n_unique", F.row_number().over(Window.orderBy(F.desc("n_unique"), "path")).alias("rank"))


def gender_signals(records: DataFrame, sample: int | None = SAMPLE) -> DataFrame:
    """(signal_type, path): boolean fields named like female, text fields with such values."""
    rows = record_fields(sampled(records, sample))
    kind = V.kind(F.col("value"))
    signal = F.when((kind == "boolean") & F.col("path").rlike("(?i)female"), "boolean_field").when(
        (kind == "string") & V.as_text(F.col("value")).rlike("(?i)female"), "value_pattern"
    )
    return rows.select(signal.alias("signal_type"), "path").filter("signal_type is not null").distinct()


def range_pairs(catalog: DataFrame) -> DataFrame:
    """Fields whose example is a pair of numbers: (path, low, high) with names for two columns."""
    pair = F.try_parse_json("example").try_cast("array<variant>")
    hit = (F.size(pair) == 2) & F.forall(pair, lambda x: F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|BOOLEAN)"))
    return catalog.filter(hit).select("path", F.concat(F.lit("min_"), "path").alias("low"), F.concat(F.lit("max_"), "path").alias("high"))


def fingerprint(records: DataFrame) -> DataFrame:
    """One row: the shape fingerprint over all paths of all records."""
    return record_fields(records).agg(shape_fingerprint(F.collect_set("path")).alias("fingerprint"))


def paths_of_schema(schema: str) -> set[str]:
    """Dotted paths of a variant schema text (as schema_of_variant_agg gives it); arrays are looked through."""
    out: set[str] = set()

    def split(body: str) -> list[str]:
        parts, depth, at = [], 0, 0
        for i, c in enumerate(body):
            depth += (c == "<") - (c == ">")
            if c == "," and depth == 0:
                parts.append(body[at:i])
                at = i + 1
        return [p.strip() for p in [*parts, body[at:]] if p.strip()]

    def walk(s: str, prefix: str) -> None:
        while s.startswith("ARRAY<"):
            s = s[6:-1]
        if s.startswith("OBJECT<"):
            for member in split(s[7:-1]):
                name, _, kind = member.partition(": ")
                path = f"{prefix}.{name.strip('`')}" if prefix else name.strip("`")
                out.add(path)
                walk(kind, path)

    walk(schema, "")
    return out


def dynamic_paths(schema: str) -> set[str]:
    """Paths of such a text that have no type of their own, because records disagree on it; what lies below
    them isn't in it."""
    return {p for p in paths_of_schema(re.sub(r"\bVARIANT\b", "OBJECT<*: VOID>", schema)) if p.endswith(".*")}


def schema_paths(records: DataFrame) -> tuple[set[str], set[str]]:
    """(paths, paths that are left dynamic) as one distributed schema aggregate sees them."""
    found = records.agg(F.schema_of_variant_agg("record").alias("s")).first()["s"]
    return (paths_of_schema(found), {p.removesuffix(".*") for p in dynamic_paths(found)}) if found else (set(), set())


def walk_paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """JSON texts to the dotted paths in them, each once a task; arrays are looked through."""
    seen: set[str] = set()
    for batch in batches:
        fresh = set()
        for text in batch.column(0).to_pylist():
            stack = [("", json.loads(text))] if text else []
            while stack:
                at, v = stack.pop()
                if isinstance(v, list):
                    stack += [(at, x) for x in v if isinstance(x, (dict, list))]
                    continue
                for k, x in v.items() if isinstance(v, dict) else ():
                    path = f"{at}.{k}" if at else k
                    fresh.add(path)
                    if isinstance(x, (dict, list)):
                        stack.append((path, x))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(fresh - seen), pa.string())], names=["path"])
        seen |= fresh


def all_paths(records: DataFrame) -> set[str]:
    """Dotted paths of every record, unsampled and whatever type a field has elsewhere; as many as the
    records' fields have."""
    texts = records.select(F.to_json("record").alias("t"))
    return {r.path for r in texts.mapInArrow(walk_paths, "path string").distinct().collect()}


def profile_source(spark: SparkSession, root: str | Path, source: str, previous: Mapping[str, Mapping[str, Any]] | None = None) -> dict[str, dict[str, Any]]:
    """Template drafts for every JSON document of a source's last snapshot that holds records, by endpoint."""
    snapshot = latest_snapshot(root, source)
    drafts = {}
    for p in sorted((Path(root) / source / snapshot).glob("*.json")) if snapshot else []:
        doc = read_document(spark, root, source, p.stem, snapshot)
        text = doc.select("text").first()
        try:
            shape = detect_shape(json.loads(text["text"])) if text else None
        except ValueError:
            shape = None
        if shape and not p.name.startswith("."):
            t = template_from({"source_key": source, "endpoint": p.stem, "record_extraction": {"unwrap_path": shape["path"], "iterate_mode": shape["mode"]}})
            drafts[p.stem] = draft_template(unwrap(doc, t), source, p.stem, shape, (previous or {}).get(p.stem))
    return drafts


def draft_template(records: DataFrame, source_key: str, endpoint: str, shape: Mapping[str, Any], previous: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """A template for a source's records, ready to be written as YAML.

    What a person wrote stays: overrides, sub_records, prefix, injected key and a chosen identity;
    overrides of fields that are gone are listed under needs_review.
    """
    previous = previous or {}
    catalog = {r.path: r for r in catalog_fields(records).collect()}
    ranked = [r.path for r in rank_identities(records).orderBy("rank").limit(10).collect()]
    pairs = {r.path: (r.low, r.high) for r in range_pairs(catalog_fields(records)).collect()}
    mappings: dict[str, Any] = {}
    for path, row in sorted(catalog.items()):
        if path in pairs:
            for index, name in enumerate(pairs[path]):
                mappings[name] = {"source_field": path, "transform": "list_index", "index": index}
        elif row.types != ["object"]:
            mappings[path.replace(".", "_")] = {"source_field": path, "transform": "nested_path" if "." in path else "direct"}
    overrides = dict(previous.get("overrides") or {})
    review = [f"override {k}: field {m.get('source_field')} is gone" for k, m in overrides.items() if m.get("source_field") not in catalog]
    how = {"unwrap_path": shape["path"], "iterate_mode": shape["mode"]}
    kept = {k: previous[k] for k in ("entity_id_prefix", "sub_records") if previous.get(k)}
    injected = (previous.get("record_extraction") or {}).get("key_becomes_field")
    return {
        "source_key": source_key,
        "endpoint": endpoint,
        "source_fingerprint": fingerprint(records).first()["fingerprint"],
        "record_extraction": how | ({"key_becomes_field": injected} if injected else {}),
        "identity_field": previous.get("identity_field") or (ranked[0] if ranked else None),
        "field_mappings": mappings,
        "gender_signals": [
            {"signal_type": r.signal_type, "source_field": r.path, **({"pattern": "(?i)female", "value": "female"} if r.signal_type == "value_pattern" else {"when_true": "female"})}
            for r in gender_signals(records).orderBy("signal_type", "path").collect()
        ],
        "overrides": overrides,
        "needs_review": review,
        **kept,
    }
