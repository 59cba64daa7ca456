"""Claims (entity_id, attribute, source, value_json, priority, seq) from records, and how one source collapses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import variant as V
from quorumlake.functions.transforms import compiled, display_name, form_entity_id, form_identity, gender_of, identity_slug
from quorumlake.operators.extract import compile_fields
from quorumlake.sources.templates import TRUST, UNLISTED, SubRecords, Template

CLAIM_COLUMNS = ["entity_id", "attribute", "source", "value_json", "priority", "seq"]


def sequence(record: Column, group: Column | None = None, member: Column | None = None, attribute: Column | None = None) -> Column:
    """The place of a claim in its source: the record's place, then the group of sub-records (0: the record
    itself), the member within it and the attribute. Structs compare part by part, so none can run into
    the next however large it is."""
    part = lambda c: (F.lit(0) if c is None else c).cast("bigint")
    return F.struct(record.alias("record"), part(group).alias("group"), part(member).alias("member"), part(attribute).alias("attribute"))


def priority_of(source: Column, trust: Mapping[str, int] = TRUST, unlisted: int = UNLISTED) -> Column:
    """The rank of a source; unknown sources rank last."""
    ranks = F.create_map(*[F.lit(x) for pair in trust.items() for x in pair]) if trust else None
    return F.coalesce(F.try_element_at(ranks, source), F.lit(unlisted)) if trust else F.lit(unlisted)


def unpivot_claims(
    df: DataFrame, entity: Column, attributes: Mapping[str, Column], source: str, priority: int, record: Column, group: Column | None = None, member: Column | None = None
) -> DataFrame:
    """Wide rows as claims: one per attribute whose value isn't null.

    Values are JSON text already, or any column to_json can't take is written by its own cast. record,
    group and member (together unique per row) order the rows; attributes follow in the order given.
    """
    cells = [F.struct(F.lit(a).alias("attribute"), c.cast("string").alias("value_json"), F.lit(i).alias("_i")) for i, (a, c) in enumerate(attributes.items())]
    cells = cells or [F.struct(F.lit("").alias("attribute"), F.lit(None).cast("string").alias("value_json"), F.lit(0).alias("_i"))]  # nothing mapped, no claim
    places = [record.alias("_r"), (F.lit(0) if group is None else group).alias("_g"), (F.lit(0) if member is None else member).alias("_m")]
    rows = df.select(entity.alias("entity_id"), *places, F.explode(F.array(*cells)).alias("_c"))
    return rows.filter("entity_id is not null and _c.value_json is not null").select(
        "entity_id", "_c.attribute", F.lit(source).alias("source"), "_c.value_json", F.lit(priority).alias("priority"),
        sequence(F.col("_r"), F.col("_g"), F.col("_m"), F.col("_c._i")).alias("seq"),
    )


def identity_of(t: Template) -> Column:
    """The record's identity as text: the mapped value if the identity field is mapped, else the raw field."""
    fields = compile_fields(t)
    value = fields[t.identity_field] if t.identity_field in fields else V.field(F.col("record"), t.identity_field)
    return V.as_text(value)


def record_claims(records: DataFrame, t: Template, trust: Mapping[str, int] = TRUST) -> DataFrame:
    """Claims of a template's records and their sub-records; records without identity give none."""
    attributes = {a: V.canonical(c) for a, c in compile_fields(t).items()}
    if t.gender_signals:
        attributes["gender"] = F.to_json(gender_of(F.col("record"), t.gender_signals, F.col("record_key")).cast("variant"))
    raw_id = identity_of(t)
    entity = F.concat(F.lit(f"{t.prefix}_"), raw_id)
    priority = trust.get(t.source_key, UNLISTED)
    out = unpivot_claims(records, entity, attributes, t.source_key, priority, F.col("pos"))
    for n, sub in enumerate(t.sub_records):
        out = out.unionByName(sub_claims(records, t, sub, n, raw_id, priority))
    return out


def sub_claims(records: DataFrame, t: Template, sub: SubRecords, number: int, raw_id: Column, priority: int) -> DataFrame:
    """Claims of the entities nested in each record, under one id per variant however it is spelled.

    The key of an object names its member, else the mapped form name does. Members without any name,
    costume or gender are placeholders and give nothing. Earlier sub_records of a template come first.
    """
    holder = V.field(F.col("record"), sub.list_field)
    fields = compile_fields(t)
    name = V.as_text(fields["name"]) if "name" in fields else F.lit(None).cast("string")
    base = records.select("pos", raw_id.alias("_id"), name.alias("_name"), holder.alias("_h")).filter("_id is not null")
    if sub.container_type == "dict":
        # VARIANT sorts the members of an object by name, so their numbers are the same on every run
        listed = F.map_entries(V.entries(F.col("_h")))
        members = base.select("pos", "_id", "_name", F.posexplode(listed).alias("_p", "_e"))
        members = members.select("pos", "_id", "_name", F.col("_e.key").alias("record_key"), F.col("_p"), F.col("_e.value").alias("record"))
    else:
        members = base.select("pos", "_id", "_name", F.lit(None).cast("string").alias("record_key"), F.posexplode(V.items(F.col("_h"))).alias("_p", "record"))
    members = members.filter(V.kind(F.col("record")) == "object")
    mapped = {a: compiled(m)(F.col("record"), m) for a, m in sub.field_mappings.items()}
    empty = F.lit(None).cast("variant")
    gender = gender_of(F.col("record"), sub.gender_signals, F.col("record_key")) if sub.gender_signals else F.lit("unknown")
    form, costume = V.as_text(mapped.get("form_name", empty)), V.as_text(mapped.get("costume_name", empty))
    said = F.coalesce(F.col("record_key"), form)
    named = members.withColumn("_gender", gender).withColumn("_said", said).withColumn("_form", form).withColumn("_costume", costume)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    named = named.filter(~(blank("_said") & blank("_costume") & (F.col("_gender") == "unknown")))
    slug = F.concat(F.col("_id"), F.lit("-"), F.coalesce(identity_slug(F.col("_name")), F.lit("")))
    entity = form_entity_id(t.prefix, F.col("_id"), form_identity(slug, F.col("_said"), F.col("_costume"), F.col("_gender")))
    as_json = lambda c: F.to_json(F.when(c.isNotNull(), c.cast("variant")))
    shown = display_name(F.when(blank("_form"), F.col("_said")).otherwise(F.col("_form")))
    number_or_text = F.when(F.col("_id").rlike("^[0-9]{1,18}$"), F.col("_id")).otherwise(as_json(F.col("_id")))
    attributes = {
        "dex_number": number_or_text,
        "form_name": as_json(shown),
        "costume_name": as_json(F.when(~blank("_costume"), F.col("_costume"))),
        "gender": as_json(F.col("_gender")),
    } | {a: V.canonical(c) for a, c in mapped.items() if a not in ("form_name", "costume_name")}
    return unpivot_claims(named, entity, attributes, t.source_key, priority, F.col("pos"), F.lit(number + 1), F.col("_p"))


def ledger(parts: Sequence[DataFrame]) -> DataFrame:
    """All sources' claims as one ledger; a source given earlier was emitted earlier.

    seq stays unique and ordered: the source's place comes before the claim's own seq.
    """
    out = None
    for i, p in enumerate(parts):
        one = p.select(*CLAIM_COLUMNS[:-1], F.struct(F.lit(i).alias("part"), F.col("seq").alias("at")).alias("seq"))
        out = one if out is None else out.unionByName(one)
    return out


def last_wins(claims: DataFrame) -> DataFrame:
    """One claim per entity and attribute of a source: the last value, at the place of the first."""
    return claims.groupBy("entity_id", "attribute", "source").agg(
        F.max_by("value_json", "seq").alias("value_json"), F.max_by("priority", "seq").alias("priority"), F.min("seq").alias("seq")
    )


def truthy_claims(claims: DataFrame) -> DataFrame:
    """Claims whose value is neither empty, zero nor false."""
    return claims.filter(V.truthy(F.try_parse_json("value_json")))


def renamed_entities(claims: DataFrame, pattern: str, prefix: str) -> DataFrame:
    """Claims whose entity_id matches the whole pattern, under prefix + first group (a number without leading zeros)."""
    kept = claims.filter(F.col("entity_id").rlike(f"^(?:{pattern})$"))
    group = F.regexp_replace(F.regexp_extract("entity_id", pattern, 1), "^0+(?=[0-9])", "")
    return kept.withColumn("entity_id", F.concat(F.lit(prefix), group))


def claims_as_text(claims: DataFrame) -> DataFrame:
    """The ledger as stored: values as text instead of JSON."""
    return claims.withColumn("value", V.as_text(F.try_parse_json("value_json"))).drop("value_json")
