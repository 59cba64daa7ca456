"""Reading snapshots, documents and tables; missing input gives an empty result, not an error."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from quorumlake.functions import variant as V
from quorumlake.functions.transforms import snake_case

DOCUMENT_SCHEMA = "source string, endpoint string, snapshot string, doc variant, text string"


def latest_snapshot(root: str | Path, source: str, exclude: str | None = None) -> str | None:
    """The last snapshot folder of a source; names are instants that sort by time. None if there is none."""
    folder = Path(root) / source
    names = [p.name for p in folder.iterdir() if p.is_dir() and p.name != exclude] if folder.is_dir() else []
    return max(names, default=None)


def latest_rows(df: DataFrame, keys: list[str], snapshot: str) -> DataFrame:
    """The rows of each key's last snapshot (all of them)."""
    last = df.groupBy(*keys).agg(F.max(snapshot).alias(snapshot))
    return df.join(last, [*keys, snapshot], "left_semi")


def read_document(spark: SparkSession, root: str | Path, source: str, endpoint: str, snapshot: str | None = None) -> DataFrame:
    """(source, endpoint, snapshot, doc, text) of one JSON document, the last snapshot's by default.

    doc is null if the text is no JSON. No snapshot or no file gives no row.
    """
    snapshot = snapshot or latest_snapshot(root, source)
    path = Path(root) / source / (snapshot or "") / f"{endpoint}.json"
    if not snapshot or not path.is_file():
        return spark.createDataFrame([], DOCUMENT_SCHEMA)
    raw = spark.read.text(str(path), wholetext=True)
    return raw.select(
        F.lit(source).alias("source"), F.lit(endpoint).alias("endpoint"), F.lit(snapshot).alias("snapshot"),
        F.try_parse_json("value").alias("doc"), F.col("value").alias("text"),
    )


def read_raw(spark: SparkSession, folder: str | Path, name: str) -> DataFrame:
    """(doc, text) of `name.json`, else of the file `name` as text, else no row."""
    for path in (Path(folder) / f"{name}.json", Path(folder) / name):
        if path.is_file():
            raw = spark.read.text(str(path), wholetext=True)
            return raw.select(F.try_parse_json("value").alias("doc"), F.col("value").alias("text"))
    return spark.createDataFrame([], "doc variant, text string")


def read_json_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file as a table of inferred schema."""
    return spark.read.option("multiLine", True).json(path)


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names; arrays stay as they are."""

    def leaves(fields: StructType, at: tuple[str, ...]) -> list[tuple[str, ...]]:
        out = []
        for f in fields:
            out += leaves(f.dataType, (*at, f.name)) if isinstance(f.dataType, StructType) else [(*at, f.name)]
        return out

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema, ())])


def field_paths(schema: StructType, prefix: str = "") -> tuple[set[str], set[str]]:
    """(dotted paths, paths that end in a dynamic type) of an inferred schema; arrays are looked through."""
    paths, collapsed = set(), set()
    for f in schema:
        path, kind = f"{prefix}.{f.name}" if prefix else f.name, f.dataType
        while isinstance(kind, ArrayType):
            kind = kind.elementType
        paths.add(path)
        if isinstance(kind, StructType):
            below, dynamic = field_paths(kind, path)
            paths |= below
            collapsed |= dynamic
        elif kind.typeName() in ("map", "variant"):
            collapsed.add(path)
    return paths, collapsed


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def heterogeneous_records(documents: DataFrame) -> DataFrame:
    """(template_id, record_id, record) of documents that are lists of {templateId, data: {kind: object}}.

    A row per kind within data; elements of another shape give nothing.
    """
    items = documents.select(F.explode(V.items(F.col("doc"))).alias("_i"))
    data = items.select(V.as_text(V.field(F.col("_i"), "templateId")).alias("template_id"), F.explode(V.entries(V.field(F.col("_i"), "data"))))
    return data.filter(V.kind(F.col("value")) == "object").select("template_id", F.col("key").alias("record_id"), F.col("value").alias("record"))


def records_of_kind(records: DataFrame, kind: str) -> DataFrame:
    """One flat table of one kind of heterogeneous records, its schema inferred over all its rows."""
    rows = records.filter(F.col("record_id") == kind)
    found = rows.agg(F.schema_of_variant_agg("record").alias("s")).first()
    if found is None or found["s"] is None or not found["s"].startswith("OBJECT<") or found["s"] == "OBJECT<>":
        return rows.select("template_id")
    schema = found["s"].replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    return flattened(rows.select("template_id", F.from_json(F.to_json("record"), schema).alias("_r")).select("template_id", "_r.*"))


def top_level_arrays(documents: DataFrame, prefix: str = "refjson_") -> DataFrame:
    """(table_name, position, record): every top-level array of an object, one table each by name."""
    tables = documents.select(F.explode(V.entries(F.col("doc")))).filter(V.kind(F.col("value")) == "array")
    named = tables.select(F.concat(F.lit(prefix), snake_case(F.col("key"))).alias("table_name"), V.items(F.col("value")).alias("_a"))
    return named.select("table_name", F.posexplode_outer("_a").alias("position", "record"))


def top_level_key_order(text: str, path: str = "$") -> str:
    """SQL for the keys of a JSON object in the order of the document (VARIANT sorts them)."""
    return f"json_object_keys({text})" if path == "$" else f"json_object_keys(get_json_object({text}, '{path}'))"


def folder_hash(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the sorted names and contents of a folder's files, .meta.json left out."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(name.alias("n"), F.sha2("content", 256).alias("h")).filter("n <> '.meta.json'").orderBy("n").collect()
    return hashlib.sha256("\n".join(f"{r.n}:{r.h}" for r in rows).encode()).hexdigest()


def changed_endpoints(remote: DataFrame, stored: DataFrame) -> DataFrame:
    """Remote (source, endpoint, etag) whose etag isn't the stored one: what a fetch must load."""
    return remote.join(stored.select("source", "endpoint", "etag").distinct(), ["source", "endpoint", "etag"], "left_anti")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by `order` (ascending, nulls first); of equal rows the smallest.

    One aggregate that combines before it shuffles, so a key may hold any share of the rows.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest))
    return df.groupBy(*keys).agg(first.alias("_f")).select(*[c if c in keys else F.col(f"_f.`{c}`") for c in df.columns])
