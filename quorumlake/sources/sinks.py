"""Writing tables: catalog tables, Parquet exports, claim dumps, custom tables and their inventory."""

from __future__ import annotations

import json
import re
import shutil
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quorumlake.session import cut

INVENTORY_SCHEMA = "source string, table_name string, row_count bigint, field_count int, sample_fields string"
META_SCHEMA = "source string, last_pulled_at string"
HISTORY_SCHEMA = "recorded_at string, entity_id string, attribute string, old_value string, new_value string, source_key string"

#: Fixed: tables that diffs follow, with their keys.
DIFFED = {"species": "slug", "forms": "slug", "moves": "move_id", "progression": "level", "weather_boosts": "weather", "community_days": "event_id"}


def conform(df: DataFrame, schema: StructType | str) -> DataFrame:
    """The columns of a declared schema in its order: cast where needed, null where missing.

    An empty and a filled build so have one schema.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def write_tables(tables: Mapping[str, DataFrame], folder: str | Path) -> None:
    """Each table as Parquet files, replacing what was there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def export_parquet(spark: SparkSession, database: str | Path, folder: str | Path) -> dict[str, int]:
    """Every public table of a database folder as `<name>.parquet` with its number of rows.

    Names with a leading underscore are internal and stay out; exports of tables that are gone are
    removed; empty tables are exported too. A missing database is an error.
    """
    database, folder = Path(database), Path(folder)
    if not database.is_dir():
        raise FileNotFoundError(database)
    folder.mkdir(parents=True, exist_ok=True)
    names = sorted(p.name.removesuffix(".parquet") for p in database.glob("*.parquet"))
    public = [n for n in names if not n.startswith("_")]
    for old in folder.glob("*.parquet"):
        if old.name.removesuffix(".parquet") not in public:
            shutil.rmtree(old) if old.is_dir() else old.unlink()
    counts = {}
    for n in public:
        df = spark.read.parquet(str(database / f"{n}.parquet"))
        df.write.mode("overwrite").parquet(str(folder / f"{n}.parquet"))
        counts[n] = df.count()
    return counts


def purge(spark: SparkSession, prefixes: Iterable[str], names: Iterable[str] = ()) -> list[str]:
    """Drops the catalog's tables of the given prefixes and names; returns what was dropped."""
    prefixes, names = tuple(prefixes), set(names)
    gone = [t.name for t in spark.catalog.listTables() if t.name.startswith(prefixes) or t.name in names]
    for n in gone:
        spark.sql(f"DROP TABLE IF EXISTS `{n}`")
    return gone


def inventory_row(df: DataFrame, source: str, name: str) -> tuple[str, str, int, int, str]:
    return source, name, df.count(), len(df.columns), json.dumps(df.columns[:10])


def register_custom_table(spark: SparkSession, name: str | None, data: Any, source: str = "custom", inventory: DataFrame | None = None) -> tuple[bool, DataFrame | None]:
    """A user's table as a temporary view: from a DataFrame, a list of dicts or a SQL text.

    Returns whether it was registered, and the inventory with its row replaced. Another kind of data
    gives False; an empty name is an error.
    """
    if not name or not name.strip():
        raise ValueError("a table needs a name")
    if isinstance(data, DataFrame):
        df = data
    elif isinstance(data, str):
        df = spark.sql(data)
    elif isinstance(data, list) and all(isinstance(x, dict) for x in data):
        df = spark.createDataFrame(data) if data else spark.createDataFrame([], "id string")
    else:
        return False, inventory
    df.createOrReplaceTempView(name)
    if inventory is not None:
        row = spark.createDataFrame([inventory_row(df, source, name)], INVENTORY_SCHEMA)
        inventory = inventory.filter(F.col("table_name") != name).unionByName(row)
    return True, inventory


def schema_inventory(tables: Mapping[str, DataFrame], source: str = "build") -> DataFrame:
    """(source, table_name, row_count, field_count, sample_fields) of every table, the largest first."""
    spark = next(iter(tables.values())).sparkSession
    rows = [inventory_row(df, source, n) for n, df in tables.items()]
    return spark.createDataFrame(rows, INVENTORY_SCHEMA).orderBy(F.desc("row_count"), "table_name")


def largest_tables(inventory: DataFrame, k: int = 30) -> DataFrame:
    """The k largest tables with their first ten fields as an array."""
    fields = F.slice(F.from_json("sample_fields", "array<string>"), 1, 10)
    return inventory.orderBy(F.desc("row_count"), "table_name").limit(k).withColumn("fields", fields)


def meta_rows(spark: SparkSession, pulled: Mapping[str, str]) -> DataFrame:
    """When each source was pulled, and a row for the build itself."""
    now = datetime.now(UTC).isoformat()
    return spark.createDataFrame([*pulled.items(), ("__build__", now)], META_SCHEMA)


def append_history(changes: DataFrame, domain: str, source_key: str, folder: str | Path, now: str | None = None) -> None:
    """Appends keyed_diff rows of a domain to the change history."""
    rows = changes.select(
        F.lit(now or datetime.now(UTC).isoformat(timespec="seconds")).alias("recorded_at"),
        F.concat(F.lit(f"{domain}:"), "record_key").alias("entity_id"), "attribute", "old_value", "new_value", F.lit(source_key).alias("source_key"),
    )
    rows.write.mode("append").parquet(str(folder))


def dump_claims(claims: DataFrame, folder: str | Path, source: str, snapshot: str) -> str:
    """Parsed claims as JSON lines under <source>/<snapshot>."""
    path = f"{folder}/{source}/{snapshot}/claims.jsonl"
    claims.write.mode("overwrite").json(path)
    return path


def submissions_as_claims(rows: DataFrame, tier: str = "confirmed_owner_submission") -> DataFrame:
    """Community submissions (CSV rows) as claims: entity_id, attribute, value, trust_tier.

    Columns may be called entity or entity_id, attribute or field, value or new_value; the first that
    isn't empty counts. Rows without entity or attribute give nothing.
    """

    def pick(*names: str):
        found = [F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")) for n in names if n in rows.columns]
        return F.coalesce(*found, F.lit(None).cast("string"))

    out = rows.select(
        pick("entity_id", "entity").alias("entity_id"), pick("attribute", "field").alias("attribute"), pick("value", "new_value").alias("value"), F.lit(tier).alias("trust_tier")
    )
    return out.filter("entity_id is not null and attribute is not null")


def append_submissions(spark: SparkSession, csv: str, folder: str, tier: str = "confirmed_owner_submission") -> int:
    """Appends the submissions of a CSV file to the stored ones (JSON lines); returns how many there are now.

    A missing file is an error; rows are kept as they are delivered, also if they were before.
    """
    from quorumlake.sources.documents import read_csv

    submissions_as_claims(read_csv(spark, csv), tier).write.mode("append").json(folder)
    return spark.read.schema("entity_id string, attribute string, value string, trust_tier string").json(folder).count()


def write_arrays(documents: DataFrame, folder: str, prefix: str = "refjson_") -> dict[str, int]:
    """Every top-level array of a document as a Parquet table of its own, replacing what was there.

    Tables have an inferred schema over all their rows; members of another kind than objects are one
    column `value`. An empty array gives an empty table with a column `placeholder`. Returns rows per table.
    """
    from quorumlake.sources.documents import flattened, top_level_arrays

    rows = cut(top_level_arrays(documents, prefix))
    spark, out = documents.sparkSession, {}
    # as many tables as the document has arrays at its top
    for name in sorted(r.table_name for r in rows.select("table_name").distinct().collect()):
        own = rows.filter((F.col("table_name") == name) & F.col("record").isNotNull())
        found = own.agg(F.schema_of_variant_agg("record").alias("s"), F.count(F.lit(1)).alias("n")).first()
        out[name] = found["n"]
        if not found["n"]:
            table = spark.createDataFrame([], "placeholder string")
        elif found["s"].startswith("OBJECT<") and found["s"] != "OBJECT<>":
            schema = found["s"].replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
            table = flattened(own.select("position", F.from_json(F.to_json("record"), schema).alias("_r")).select("position", "_r.*"))
        else:
            table = own.select("position", F.to_json("record").alias("value"))
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return out


def domain_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of a build."""
    counted = [df.select(F.lit(n).alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows")) for n, df in tables.items()]
    found = reduce(DataFrame.unionByName, counted)
    names = found.sparkSession.createDataFrame([(n,) for n in tables], "table_name string")
    return names.join(found, "table_name", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def with_counts(text: str, counts: Mapping[str, int]) -> str:
    """A Markdown text whose table rows `| name | number |` have the numbers of a build; other lines stay."""

    def line(x: str) -> str:
        cells = [c.strip() for c in x.split("|")]
        name = cells[1].strip("`*") if len(cells) > 3 else ""
        if name not in counts or not re.fullmatch(r"[\d,~]+", cells[2]):
            return x
        return x.replace(cells[2], f"{counts[name]:,}", 1)

    return "\n".join(line(x) for x in text.split("\n"))
