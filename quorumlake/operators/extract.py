"""Records out of documents: unwrap modes, and templates compiled into columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import variant as V
from quorumlake.functions.transforms import compiled, gender_of
from quorumlake.sources.templates import Template


def with_field(record: Column, name: str, value: Column) -> Column:
    """The record with one field set; a field of that name is replaced."""
    kept = F.map_filter(V.entries(record), lambda k, _: k != name)
    return F.to_variant_object(F.map_concat(kept, F.create_map(F.lit(name), value)))


def key_order(path: list[str]) -> Column:
    """The keys of an object of the document in the order of its text (VARIANT itself sorts them)."""
    if not path:
        return F.json_object_keys("text")
    return F.json_object_keys(F.get_json_object("text", "$" + "".join(f"['{p}']" for p in path)))


def members_in_order(path: list[str], v: Column) -> Column:
    """The members of an object as an array of (pos from 1, key, value), pos as in the document's text.

    Both lists of members are sorted by key and zipped, so a document of n members costs n log n.
    """
    keys = F.array_sort(F.transform(key_order(path), lambda k, i: F.struct(k.alias("key"), i.alias("i"))))
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    found = F.array_sort(F.map_entries(V.entries(v)), by_key)
    return F.zip_with(keys, found, lambda k, m: F.struct((k["i"] + 1).alias("pos"), m["key"].alias("key"), m["value"].alias("value")))


def place(at: Column, member: Column | None = None) -> Column:
    """The place of a record in its document."""
    return F.struct(at.cast("bigint").alias("at"), (F.lit(0) if member is None else member).cast("bigint").alias("member")).alias("pos")


def unwrap(documents: DataFrame, t: Template) -> DataFrame:
    """(endpoint columns..., record, record_key, pos): the records of documents (doc, text).

    pos, a struct (at, member), orders records as the file does: at counts its members, member the
    elements of a member that is a list itself. A missing path, another shape than the mode's or
    null documents give no record; list elements that are no objects are dropped.
    """
    others = [c for c in documents.columns if c not in ("doc", "text")]
    inner = V.nested(F.col("doc"), ".".join(t.unwrap_path)) if t.unwrap_path else V.present(F.col("doc"))
    if t.mode == "list_of_dicts_with_subkey":
        found = documents.select(*others, F.posexplode(V.items(V.present(F.col("doc")))).alias("pos", "_item"))
        below = V.nested(F.col("_item"), ".".join(t.unwrap_path)) if t.unwrap_path else F.col("_item")
        found = found.withColumn("_below", below).filter((V.kind(F.col("_below")) == "object") & (F.size(V.entries(F.col("_below"))) > 0))
        record = F.col("_below")
        if t.key_becomes_field:
            parent = F.coalesce(V.field(F.col("_item"), t.key_becomes_field), V.field(F.col("_item"), "templateId"))
            record = F.when(parent.isNotNull(), with_field(record, t.key_becomes_field, parent)).otherwise(record)
        return found.select(*others, record.alias("record"), F.lit(None).cast("string").alias("record_key"), place(F.col("pos")))
    base, member = documents.withColumn("_v", inner), F.lit(0)
    if t.mode == "top_level_list":
        found = base.select(*others, F.posexplode(V.items(F.col("_v"))).alias("pos", "record")).withColumn("record_key", F.lit(None).cast("string"))
    elif t.mode == "dict_of_lists":
        keyed = base.select(*others, F.explode(members_in_order(t.unwrap_path, F.col("_v"))).alias("_m"))
        found = keyed.select(*others, F.col("_m.key").alias("record_key"), F.col("_m.pos").alias("pos"), F.posexplode(V.items(F.col("_m.value"))).alias("_p", "record"))
        member = F.col("_p")
        if t.key_becomes_field:
            found = found.filter(V.kind(F.col("record")) == "object").withColumn(
                "record", with_field(F.col("record"), t.key_becomes_field, F.col("record_key").cast("variant"))
            )
    elif t.mode == "single_object":
        found = base.select(*others, F.col("_v").alias("record"), F.lit(None).cast("string").alias("record_key"), F.lit(0).alias("pos"))
    else:  # dict_of_scalars
        keyed = base.select(*others, F.explode(members_in_order(t.unwrap_path, F.col("_v"))).alias("_m"))
        pair = F.create_map(F.lit(t.dict_key_field), F.col("_m.key").cast("variant"), F.lit(t.dict_value_field), F.col("_m.value"))
        found = keyed.select(*others, F.col("_m.key").alias("record_key"), F.to_variant_object(pair).alias("record"), F.col("_m.pos").alias("pos"))
    return found.filter(V.kind(F.col("record")) == "object").select(*others, "record", "record_key", place(F.col("pos"), member))


def compile_fields(t: Template) -> dict[str, Column]:
    """Attribute -> variant column over `record`: the template, interpreted once instead of per record."""
    return {a: compiled(m)(F.col("record"), m) for a, m in t.field_mappings.items()}


def transformed_records(records: DataFrame, t: Template) -> DataFrame:
    """One row per record with a variant column per attribute, and gender if the template has signals.

    Rows without any value stay.
    """
    columns = [c.alias(a) for a, c in compile_fields(t).items()]
    if t.gender_signals:
        columns.append(gender_of(F.col("record"), t.gender_signals, F.col("record_key")).alias("gender"))
    return records.select("pos", *columns)


def array_rows(records: DataFrame, name: str, level: str, value: str) -> DataFrame:
    """(level, value): elements of an array field with their numbers from 1, both as double."""
    found = records.select(F.posexplode(V.items(V.field(F.col("record"), name))))
    return found.select((F.col("pos") + 1).cast("double").alias(level), F.try_variant_get("col", "$", "double").alias(value))


def crosstab_rows(documents: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, column, value) of {row: {column: number}}."""
    outer = documents.select(F.explode(V.entries(F.col("doc"))).alias(row, "_m"))
    inner = outer.select(row, F.explode(V.entries(F.col("_m"))).alias(column, "_x"))
    return inner.select(row, column, F.try_variant_get("_x", "$", "double").alias(value))


def keyed_lists(documents: DataFrame, key: str, values: str) -> DataFrame:
    """(key, array of texts) of {key: [texts]}."""
    found = documents.select(F.explode(V.entries(F.col("doc"))).alias(key, "_l"))
    return found.select(key, F.transform(V.items(F.col("_l")), V.as_text).alias(values))


def list_or_object(documents: DataFrame) -> DataFrame:
    """(record_key, record, pos): members of a document that is a list or an object, whichever it is."""
    lists = documents.select(F.lit(None).cast("string").alias("record_key"), F.posexplode(V.items(F.col("doc"))).alias("pos", "record"))
    keyed = documents.select(F.explode(members_in_order([], F.col("doc"))).alias("_m"))
    objects = keyed.select(F.col("_m.key").alias("record_key"), (F.col("_m.pos") - 1).cast("int").alias("pos"), F.col("_m.value").alias("record"))
    return lists.unionByName(objects).filter(V.kind(F.col("record")) == "object").select("record_key", "record", place(F.col("pos")))


def passthrough(texts: DataFrame, column: str, key: str = "templateId") -> DataFrame:
    """(template_id, record_type, data_json): each JSON object as it is; its type is its first other key."""
    keys = F.filter(F.json_object_keys(column), lambda k: k != key)
    return texts.select(F.get_json_object(column, f"$.{key}").alias("template_id"), F.get(keys, F.lit(0)).alias("record_type"), F.col(column).alias("data_json"))
