"""Queries over the reconciliation operators, each on the whole star-schema or source tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import transforms as T
from quorumlake.functions import variant as V
from quorumlake.operators import audit, claims, extract, joins, profiling, resolve, snapshots
from quorumlake.session import ensure_checkpoint_dir, table
from quorumlake.sources import documents as D
from quorumlake.sources import sinks
from quorumlake.sources.templates import template_from

#: Trust of the sources that make claims about orders.
ORDER_TRUST = {"order_desk": 2, "line_totals": 6, "customer_file": 7}


def order_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of three sources about orders: totals twice, status twice, priority and segment once."""
    orders, lines, customers = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer")
    entity = F.concat(F.lit("order_"), F.col("k").cast("string"))
    money = lambda c: c.cast("decimal(18,2)")
    desk = orders.select(
        F.col("o_orderkey").alias("k"), money(F.col("o_totalprice")).cast("string").alias("total"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    sums = lines.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sum(money(F.col("l_extendedprice"))).cast("decimal(28,2)").cast("string").alias("total"), F.max("l_linestatus").alias("status")
    )
    file = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(F.col("o_orderkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    parts = []
    for source, df, names in [("order_desk", desk, ["total", "status", "priority"]), ("line_totals", sums, ["total", "status"]), ("customer_file", file, ["segment"])]:
        parts.append(claims.unpivot_claims(df, entity, {n: F.col(n) for n in names}, source, ORDER_TRUST[source], F.col("k")))
    return claims.ledger(parts)


def trust_resolve(spark: SparkSession, d: str) -> DataFrame:
    """One value per order and attribute by source trust."""
    return resolve.resolve(order_claims(spark, d))


def discrepancy_rows(spark: SparkSession, d: str) -> DataFrame:
    """What sources disagree on, with all claims in the order of emission."""
    found = resolve.discrepancies(order_claims(spark, d))
    said = F.array_join(F.transform("claims", lambda x: F.concat(x["source"], F.lit("="), x["value"])), ";")
    return found.select("entity_id", "attribute", said.alias("said"), "resolved_value", "winning_source", "kind")


def disputed_claim_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same, one row per claim, so that no group is gathered."""
    return resolve.disputed_claims(order_claims(spark, d)).select("entity_id", "attribute", "source", "value_json", "resolved_value", "winning_source")


def last_wins_collapse(spark: SparkSession, d: str) -> DataFrame:
    """A source's repeats collapse to the last value at the place of the first."""
    e = table(spark, d, "events")
    rows = e.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity_id"), F.col("event_type").alias("attribute"), F.lit("events").alias("source"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("value_json"), F.lit(1).alias("priority"), F.col("event_id").alias("seq"),
    )
    return claims.last_wins(rows).select("entity_id", "attribute", "value_json", F.col("seq").alias("first_seq"))


def eav_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Wide rows as claims, nulls left out."""
    p = table(spark, d, "part")
    size = F.when(F.col("p_size") > 5, F.col("p_size"))
    out = claims.unpivot_claims(
        p, F.concat(F.lit("part_"), F.col("p_partkey").cast("string")), {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": size}, "parts", 1, F.col("p_partkey")
    )
    return out.select("entity_id", "attribute", "value_json", F.col("seq.record").alias("record"), F.col("seq.attribute").alias("place"))


def eav_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Resolved claims as one row per entity."""
    return resolve.pivot_entities(trust_resolve(spark, d), ["total", "status", "priority", "segment"])


def first_seen_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities with the place where each was first emitted."""
    return resolve.first_seen(order_claims(spark, d)).select("entity_id", F.col("first_seq.part").cast("bigint").alias("part"), F.col("first_seq.at.attribute").alias("place"))


def upsert_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Draft rows take resolved values where there are any."""
    e, won = table(spark, d, "orders"), last_wins_collapse(spark, d)
    drafts = e.select(
        "o_orderkey", F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("entity"), F.lit("none").alias("click_value"), F.col("o_orderstatus").alias("status")
    )
    won = won.withColumn("value_json", F.to_json(F.col("value_json").cast("variant")))
    return resolve.upsert(drafts, "entity", won, {"click_value": ("click", "string")})


def fallback_join(spark: SparkSession, d: str) -> DataFrame:
    """Partner by exact name, else (large parts only) by the name with a suffix; the first of several counts."""
    p = table(spark, d, "part")
    name = T.strict_join_key(F.concat_ws(" ", F.col("p_name"), (F.col("p_partkey") % 50).cast("string")))
    rows = p.select("p_partkey", F.col("p_size"), name.alias("name"))
    other = p.select(
        F.when(F.col("p_partkey") % 3 == 0, F.concat(name, F.lit("_FAST"))).otherwise(name).alias("move"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("brand")
    )
    keys = [F.col("name"), F.when(F.col("p_size") > 20, F.concat(F.col("name"), F.lit("_FAST")))]
    found = joins.fallback_join(rows, other, keys, F.col("move"), F.col("seq"), ["seq", "brand"])
    return found.select("p_partkey", F.col("seq").alias("partner"), F.col("brand").alias("partner_brand"))


def norm_name_join(spark: SparkSession, d: str) -> DataFrame:
    """Left join on a normalised name."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    left = T.strict_join_key(F.replace("s_name", F.lit("Supplier"), F.lit("Entity")))
    right = T.strict_join_key(F.replace("c_name", F.lit("Customer#"), F.lit("entity ")))
    return joins.name_join(s, c, left, right).select("s_suppkey", "c_custkey", "k")


def existence_flags(spark: SparkSession, d: str) -> DataFrame:
    """Marks whether a customer has orders, and urgent ones."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    marked = joins.mark_exists(c.select("c_custkey"), o, F.col("c_custkey"), F.col("o_custkey"), "has_orders")
    return joins.mark_exists(marked, o.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey"), F.col("o_custkey"), "has_urgent")


def enrichment_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the context of their dimensions."""
    c, n, r, o = (table(spark, d, t) for t in ("customer", "nation", "region", "orders"))
    counts = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    out = joins.lookup(c.select("c_custkey", "c_nationkey"), n, F.col("c_nationkey"), F.col("n_nationkey"), ["n_name", "n_regionkey"])
    out = joins.lookup(out, r, F.col("n_regionkey"), F.col("r_regionkey"), ["r_name"])
    out = joins.lookup(out, counts, F.col("c_custkey"), F.col("o_custkey"), ["n_orders"], {"n_orders": F.lit(0).cast("bigint")})
    return out.select("c_custkey", "n_name", "r_name", "n_orders")


def left_anti_rows(spark: SparkSession, d: str) -> DataFrame:
    """What has no partner."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return joins.without_partner(c.select("c_custkey"), o.filter("o_totalprice > 400000"), F.col("c_custkey"), F.col("o_custkey"))


def not_beneath_paths(spark: SparkSession, d: str) -> DataFrame:
    """paths that aren't at or below a collapsed one."""
    p = table(spark, d, "part")
    path = F.concat_ws(".", F.replace("p_name", F.lit(" "), F.lit(".")), F.lower("p_type"))
    paths = p.select(path.alias("path")).distinct()
    collapsed = p.filter("p_size = 7").select(F.regexp_extract("p_name", "^([a-z]+)", 1).alias("w"), "p_brand").filter("p_brand = 'Brand#2'").select(F.col("w").alias("path"))
    return joins.not_beneath(paths, collapsed)


def event_records(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.try_parse_json("props").alias("record"), F.col("event_id").alias("pos"))


def json_nested_path(spark: SparkSession, d: str) -> DataFrame:
    """A field by path, a fallback where it is missing."""
    mapping = {"source_field": "a.b", "transform": "nested_path", "fallback_field": "k"}
    v = T.compiled(mapping)(F.col("record"), mapping)
    return event_records(spark, d).select("event_id", F.try_variant_get(v, "$", "bigint").alias("k"), V.nested(F.col("record"), "a.b").isNull().alias("missing"))


def json_flatten_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of all records with counts and types."""
    out = profiling.catalog_fields(event_records(spark, d), None)
    return out.select("path", "n_present", F.array_join("types", ",").alias("types"), "example")


def catalog_sample(spark: SparkSession, d: str) -> DataFrame:
    """The same over the first 200 records."""
    out = profiling.catalog_fields(event_records(spark, d))
    return out.select("path", "n_present", F.array_join("types", ",").alias("types"), "example")


def list_index_explode(spark: SparkSession, d: str) -> DataFrame:
    """Elements of an array with numbers from 1."""
    e = table(spark, d, "embeddings")
    rows = e.select("vec_id", F.posexplode("embedding"))
    return rows.select("vec_id", (F.col("pos") + 1).cast("double").alias("level"), F.col("col").cast("double").alias("value"))


def bool_truthy(spark: SparkSession, d: str) -> DataFrame:
    """Truth of dynamic values, and the first that is true."""
    e = event_records(spark, d)
    k = V.field(F.col("record"), "k")
    even = F.when(F.try_variant_get(k, "$", "bigint") % 2 == 0, F.lit("").cast("variant")).otherwise(k)
    return e.select("event_id", V.truthy(k).alias("k_true"), V.truthy(even).alias("even_true"), V.as_text(V.first_truthy(even, F.lit("none").cast("variant"))).alias("chosen"))


def slugify_chain(spark: SparkSession, d: str) -> DataFrame:
    """Names as slugs, keys, titles and safe table names."""
    p = table(spark, d, "part")
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return p.select(
        "p_partkey", T.slugify(text).alias("slug"), T.identity_slug(text).alias("identity"), T.table_name(text).alias("safe"), T.title_case(text).alias("title"),
        T.species_slug(F.col("p_partkey"), F.col("p_name")).alias("species"), T.padded_number(F.col("p_size")).alias("number"), T.capitalised(F.col("p_type")).alias("word"),
    )


def regex_extract_int(spark: SparkSession, d: str) -> DataFrame:
    """A number out of a text, without leading zeros; null without a match."""
    s = table(spark, d, "supplier")
    return s.select(
        "s_suppkey", T.regex_text(F.col("s_name"), r"^Supplier#(\d+)$").alias("number"), T.regex_text(F.col("s_name"), r"^Customer#(\d+)$").alias("none"),
        T.regex_text(F.col("s_name"), r"^([A-Z][a-z]+)").alias("word"),
    )


def camel_snake(spark: SparkSession, d: str) -> DataFrame:
    """camelCase to snake_case."""
    p = table(spark, d, "part").select(F.array_join(F.transform(F.split("p_name", " "), T.capitalised), "").alias("camel")).distinct()
    return p.select("camel", T.snake_case(F.col("camel")).alias("snake"))


def gender_signal_case(spark: SparkSession, d: str) -> DataFrame:
    """The first signal that fires gives its label."""
    docs = table(spark, d, "documents")
    record = F.to_variant_object(F.struct((F.col("n_chars") > 3000).alias("is_long"), F.col("source").alias("source")))
    signals = [
        {"signal_type": "boolean_field", "source_field": "is_long", "when_true": "long"},
        {"signal_type": "value_pattern", "source_field": "source", "pattern": "(?i)^WIKI", "value": "wiki"},
        {"signal_type": "key_pattern", "key_pattern": "^[Ee]n", "value": "english"},
    ]
    return docs.select("doc_id", record.alias("record"), "lang").select("doc_id", T.gender_of(F.col("record"), signals, F.col("lang")).alias("label"))


def identity_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of one variant under one id."""
    p = table(spark, d, "part")
    first, last = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    slug = F.concat((F.col("p_partkey") % 10).cast("string"), F.lit("-"), first)
    spelled = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat(first, F.lit(" ("), F.lit("Female)")))
        .when(F.col("p_partkey") % 5 == 1, F.concat(F.upper(first), F.lit("_"), last))
        .when(F.col("p_partkey") % 5 == 2, F.concat(last, F.lit(" female "), first))
        .when(F.col("p_partkey") % 5 == 3, F.lit("Standard"))
        .otherwise(F.lit(None))
    )
    gender = F.when((F.col("p_partkey") % 5).isin(0, 2), "female").otherwise("unknown")
    costume = F.when(F.col("p_size") % 3 == 0, F.lower("p_type"))
    who = T.form_identity(slug, spelled, costume, gender)
    return p.select("p_partkey", who.alias("_w")).select(
        "p_partkey", F.col("_w.form_token").alias("form_token"), F.col("_w.costume_token").alias("costume_token"),
        T.form_entity_id("dex", (F.col("p_partkey") % 10).cast("string"), F.col("_w")).alias("entity_id"),
    )


def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each key's last snapshot."""
    s = table(spark, d, "forms").select(F.lower(F.btrim("slug", F.lit(" \t"))).alias("slug"), "snapshot_ts", "loaded_at")
    return D.latest_rows(s, ["slug"], "snapshot_ts")


def orders_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("total"), "o_orderpriority")
    old = o.filter("o_orderkey % 11 <> 3").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("total")).alias("total"),
        "o_orderpriority",
    )
    return old, o.filter("o_orderkey % 13 <> 4")


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Change rows between two builds of a table."""
    old, new = orders_versions(spark, d)
    return snapshots.keyed_diff(old, new, "o_orderkey", ["o_orderstatus", "total", "o_orderpriority"])


def entity_created(spark: SparkSession, d: str) -> DataFrame:
    """Only the keys that are new."""
    return snapshot_diff(spark, d).filter("attribute = 'entity_created'").select("record_key", "new_value")


def replayed(spark: SparkSession, d: str) -> DataFrame:
    ledger = order_claims(spark, d)
    stored = resolve.resolve(ledger).filter("not (attribute = 'priority' and value_json = '5-LOW')").select("entity_id", "attribute", "value_json")
    return audit.replay(ledger, stored, F.col("attribute") != "segment")


def ledger_replay(spark: SparkSession, d: str) -> DataFrame:
    """Claims per source and bucket after a replay against the stored values."""
    return audit.replay_report(replayed(spark, d))


def coverage_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Which fields of the mega files reach a table, only claims, or nothing."""
    p = table(spark, d, "raw_payloads").filter("endpoint = 'mega_pokemon'")
    items = p.select(F.explode(V.items(F.try_parse_json("payload"))).alias("record")).withColumn("pos", F.lit(0))
    fields = profiling.record_fields(items).select("path").distinct()
    mapped = spark.createDataFrame([("pokemon_id", "dex_number"), ("mega_name", "mega_name"), ("stats.base_attack", "attack"), ("form", "form")], "path string, attribute string")
    canonical = spark.createDataFrame([("dex_number",), ("mega_name",)], "attribute string")
    claimed = spark.createDataFrame([("attack",)], "attribute string")
    return audit.coverage_tiers(fields, mapped, canonical, claimed)


def rank_identity(spark: SparkSession, d: str) -> DataFrame:
    """Identity candidates of all customers by distinctness."""
    c = table(spark, d, "customer")
    record = F.to_variant_object(F.struct("c_custkey", "c_nationkey", "c_mktsegment"))
    return profiling.rank_identities(c.select(record.alias("record"), F.col("c_custkey").alias("pos")), None).select("path", "n_unique", F.col("rank").cast("bigint").alias("rank"))


def range_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Fields that hold a pair of numbers."""
    p = table(spark, d, "raw_payloads").filter("endpoint = 'raidboss'").withColumn("text", F.col("payload")).withColumn("doc", F.try_parse_json("payload"))
    t = template_from({"source_key": "s", "endpoint": "e", "record_extraction": {"unwrap_path": ["currentList"], "iterate_mode": "dict_of_lists"}})
    records = extract.unwrap(p.select("doc", "text"), t)
    top = records.select("pos", F.explode(V.entries(F.col("record"))).alias("path", "value"))
    pairs = top.filter(F.size(V.items(F.col("value"))) == 2).select("path", V.canonical(F.col("value")).alias("example")).distinct()
    return profiling.range_pairs(pairs).distinct()


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint of the shape of all records."""
    return profiling.fingerprint(event_records(spark, d))


ALL_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "species", "forms", "moves", "raid_bosses", "community_days", "change_history", "discrepancies", "source_registry", "raw_payloads", "benchmark",
]


def schema_inventory(spark: SparkSession, d: str) -> DataFrame:
    """All tables by size with the number of their fields."""
    out = sinks.schema_inventory({n: table(spark, d, n) for n in ALL_TABLES})
    return out.select("table_name", "row_count", F.col("field_count").cast("bigint").alias("field_count"))


def top_tables(spark: SparkSession, d: str) -> DataFrame:
    """The three largest tables."""
    return sinks.largest_tables(sinks.schema_inventory({n: table(spark, d, n) for n in ALL_TABLES}), 3).select("table_name", "row_count")


def dup_identity_check(spark: SparkSession, d: str) -> DataFrame:
    """Texts that more than one document has."""
    return audit.duplicates(table(spark, d, "documents").select(F.sha2("text", 256).alias("digest")), ["digest"])


def union_tagged(spark: SparkSession, d: str) -> DataFrame:
    """Two tables as one with a constant tag."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    suppliers = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    customers = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return joins.union_tagged([(suppliers, {"is_supplier": F.lit(True)}), (customers, {"is_supplier": F.lit(False)})])


def search_filter(spark: SparkSession, d: str) -> DataFrame:
    """rows any of whose texts contains the words searched."""
    found = joins.search(table(spark, d, "part"), [("p_name", "contains", "ring"), ("p_partkey", "contains", "77"), ("p_type", "starts", "eco")])
    return found.select("p_partkey", "p_name")


def crosstab_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """A document of documents as rows."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    inner = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("double")))).alias("m"))
    outer = inner.join(r, inner["n_regionkey"] == r["r_regionkey"]).agg(F.map_from_entries(F.collect_list(F.struct("r_name", "m"))).alias("m"))
    return extract.crosstab_rows(outer.select(F.parse_json(F.to_json("m")).alias("doc")), "region", "nation", "value")


def keyed_list_rows(spark: SparkSession, d: str) -> DataFrame:
    """Keys with lists of texts."""
    n = table(spark, d, "nation")
    lists = n.groupBy(F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("k")).agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    doc = lists.agg(F.map_from_entries(F.collect_list(F.struct("k", "l"))).alias("m")).select(F.parse_json(F.to_json("m")).alias("doc"))
    return extract.keyed_lists(doc, "region", "nations").select("region", F.array_join("nations", ",").alias("nations"))


def conditional_array(spark: SparkSession, d: str) -> DataFrame:
    """Lists of the flags that are set and of the values that are there."""
    c = table(spark, d, "customer")
    flags = T.flags_as_list({"rich": F.col("c_acctbal") > 5000, "debt": F.col("c_acctbal") < 0, "builder": F.col("c_mktsegment") == "BUILDING"})
    both = T.compact_list(F.when(F.col("c_nationkey") > 12, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, F.lit("even")))
    return c.select("c_custkey", flags.alias("flags"), F.array_join(both, ",").alias("both"))


def passthrough_templates(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects as they are, typed by their first key that isn't the id."""
    e = table(spark, d, "events")
    text = F.concat(F.lit('{"templateId": "T'), F.col("event_id").cast("string"), F.lit('", "'), F.col("event_type"), F.lit('": '), F.col("props"), F.lit(', "a": 1}'))
    return extract.passthrough(e.select(text.alias("t")), "t")


def raid_boss_records(spark: SparkSession, d: str) -> DataFrame:
    """Bosses of all raid files by a template with an injected key."""
    p = table(spark, d, "raw_payloads").filter("endpoint = 'raidboss'")
    docs = p.select("payload_id", F.try_parse_json("payload").alias("doc"), F.col("payload").alias("text"))
    t = template_from(
        {
            "source_key": "mirror", "endpoint": "raidboss", "identity_field": "id",
            "record_extraction": {"unwrap_path": ["currentList"], "iterate_mode": "dict_of_lists", "key_becomes_field": "tier"},
            "field_mappings": {
                "tier": {"source_field": "tier"}, "pokemon_id": {"source_field": "id"},
                "name": {"source_field": "names.English", "transform": "nested_path", "fallback_field": "id"},
                "min_cp": {"source_field": "cpRange", "transform": "list_index"},
                "shiny": {"source_field": "shiny", "transform": "boolean"}, "slug": {"source_field": "id", "transform": "slugify"},
            },
        }
    )
    fields = extract.compile_fields(t)
    records = extract.unwrap(docs, t)
    return records.select(
        "payload_id", *[V.as_text(fields[a]).alias(a) for a in ("tier", "pokemon_id", "name", "slug")], F.try_variant_get(fields["min_cp"], "$", "bigint").alias("min_cp"),
        F.try_variant_get(fields["shiny"], "$", "boolean").alias("shiny"),
    )


def mega_records(spark: SparkSession, d: str) -> DataFrame:
    """Members of top-level lists with the ids of their entities."""
    p = table(spark, d, "raw_payloads").filter("endpoint = 'mega_pokemon'")
    docs = p.select("payload_id", F.try_parse_json("payload").alias("doc"), F.col("payload").alias("text"))
    t = template_from({"source_key": "m", "endpoint": "mega", "identity_field": "pokemon_id", "entity_id_prefix": "mega", "field_mappings": {}})
    records = extract.unwrap(docs, t)
    return records.select("payload_id", F.col("pos.at").alias("pos"), F.concat(F.lit(f"{t.prefix}_"), claims.identity_of(t)).alias("entity_id"), V.as_text(V.field(F.col("record"), "mega_name")).alias("mega_name"))


def first_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each group by rank and place."""
    o = table(spark, d, "orders")
    first = D.first_per_key(o, ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")])
    return first.select("o_custkey", "o_orderkey", "o_orderpriority")


def top_orders(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)


def bool_group_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per source and flag."""
    return joins.flag_counts(table(spark, d, "documents"), ["source"], {"is_long": F.col("n_chars") > 1000})


def format_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A table through CSV, JSON and Parquet and back."""
    folder = f"{ensure_checkpoint_dir(spark)}/roundtrip-{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    n.write.option("header", True).csv(f"{folder}/csv")
    n.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name")))).write.text(f"{folder}/json")  # one document of 25 records
    n.write.parquet(f"{folder}/parquet")
    csv = D.read_csv(spark, f"{folder}/csv").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("csv_name"))
    js = D.read_json_inferred(spark, f"{folder}/json").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("json_name"))
    pq = spark.read.parquet(f"{folder}/parquet").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("parquet_name"))
    return csv.join(js, "k").join(pq, "k")


def custom_table_sql(spark: SparkSession, d: str) -> DataFrame:
    """A user's table from a SQL text, queried by name."""
    table(spark, d, "orders").createOrReplaceTempView("ql_orders")
    sinks.register_custom_table(spark, "ql_status", "SELECT o_orderstatus, count(*) AS n FROM ql_orders GROUP BY o_orderstatus")
    return spark.sql("SELECT o_orderstatus AS status, n FROM ql_status")


def mega_by_template_key(spark: SparkSession, d: str) -> DataFrame:
    """The object below each list item, with the item's own key carried along."""
    p = table(spark, d, "raw_payloads").filter("endpoint = 'mega_pokemon'")
    docs = p.select("payload_id", F.try_parse_json("payload").alias("doc"), F.col("payload").alias("text"))
    t = template_from(
        {"source_key": "m", "endpoint": "mega", "record_extraction": {"unwrap_path": ["stats"], "iterate_mode": "list_of_dicts_with_subkey", "key_becomes_field": "mega_name"}}
    )
    r = F.col("record")
    return extract.unwrap(docs, t).select(
        "payload_id", F.col("pos.at").alias("pos"), V.as_text(V.field(r, "mega_name")).alias("mega_name"), V.as_text(V.field(r, "base_defense")).alias("base_defense")
    )


def species_names(spark: SparkSession, d: str) -> DataFrame:
    """{language: name} as rows, over every species row."""
    s = table(spark, d, "species")
    docs = s.select("dex_number", "snapshot_ts", F.try_parse_json("localized_names").alias("doc"), F.col("localized_names").alias("text"))
    t = template_from({"source_key": "n", "endpoint": "names", "record_extraction": {"iterate_mode": "dict_of_scalars", "dict_key_field": "language", "dict_value_field": "name"}})
    r = F.col("record")
    rows = extract.unwrap(docs, t).select("dex_number", V.as_text(V.field(r, "language")).alias("language"), V.as_text(V.field(r, "name")).alias("name"))
    return rows.groupBy("dex_number", "language").agg(F.count_distinct("name").alias("n_names"), F.min("name").alias("first_name"))


def payload_documents(spark: SparkSession, d: str, endpoint: str) -> DataFrame:
    p = table(spark, d, "raw_payloads").filter(F.col("endpoint") == endpoint)
    return p.select("payload_id", F.try_parse_json("payload").alias("doc"), F.col("payload").alias("text"))


def single_object_record(spark: SparkSession, d: str) -> DataFrame:
    """An object of a document as one record."""
    t = template_from({"source_key": "s", "endpoint": "e", "record_extraction": {"unwrap_path": ["currentList"], "iterate_mode": "single_object"}})
    found = extract.unwrap(payload_documents(spark, d, "raidboss"), t)
    return found.select("payload_id", F.size(V.entries(F.col("record"))).cast("bigint").alias("n_tiers"))


def override_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of a template whose overrides beat its mappings."""
    t = template_from({
        "source_key": "m", "endpoint": "mega_pokemon", "identity_field": "pokemon_id", "entity_id_prefix": "mega",
        "field_mappings": {"shown": {"source_field": "mega_name"}, "form": {"source_field": "form"}}, "overrides": {"shown": {"source_field": "pokemon_name"}},
    })
    found = claims.record_claims(extract.unwrap(payload_documents(spark, d, "mega_pokemon"), t), t)
    return found.select("entity_id", "attribute", "value_json", F.col("seq.record.at").alias("at"), F.col("seq.attribute").alias("place"))


def sub_record_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims of the entities nested in each record, under their own ids."""
    t = template_from({
        "source_key": "m", "endpoint": "raidboss", "identity_field": "id", "entity_id_prefix": "boss",
        "record_extraction": {"unwrap_path": ["currentList"], "iterate_mode": "dict_of_lists"},
        "sub_records": [{"list_field": "battleResult", "container_type": "dict", "field_mappings": {"level": {"source_field": "pokemonLevel"}}}],
    })
    found = claims.record_claims(extract.unwrap(payload_documents(spark, d, "raidboss"), t), t)
    return found.groupBy("entity_id", "attribute", "value_json").agg(F.count(F.lit(1)).alias("n_claims"))


def polymorphic_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of documents that are lists or objects, whichever they are."""
    docs = payload_documents(spark, d, "mega_pokemon").unionByName(payload_documents(spark, d, "raidboss"))
    found = extract.list_or_object(docs.select("doc", "text"))
    return found.groupBy("record_key", F.col("pos.at").alias("at")).agg(F.count(F.lit(1)).alias("n"))


def shouted_types(spark: SparkSession, d: str) -> DataFrame:
    """Shouted constants without their prefix."""
    m = table(spark, d, "moves").select(F.upper(F.btrim("move_type")).alias("t")).filter("t <> ''").distinct()
    return m.select("t", T.without_prefix(F.concat(F.lit("POKEMON_TYPE_"), "t"), "POKEMON_TYPE_").alias("shown"), T.without_prefix(F.col("t"), "POKEMON_TYPE_").alias("plain"))


def canonical_values(spark: SparkSession, d: str) -> DataFrame:
    """Values as canonical JSON, equal however they are written, and whole numbers only."""
    e = table(spark, d, "events")
    spelled = F.parse_json(F.concat(F.lit('{"b": '), F.col("event_id").cast("string"), F.lit('.0, "a": '), F.get_json_object("props", "$.k"), F.lit("}")))
    half = F.to_variant_object(F.struct((F.col("event_id") / 2).alias("h")))
    return e.select("event_id", V.canonical(spelled).alias("json"), T.integer_only(F.try_variant_get(F.parse_json("props"), "$.k", "variant")).alias("whole"), T.integer_only(V.field(half, "h")).isNull().alias("no_whole"))


def attribute_claims(spark: SparkSession, d: str) -> DataFrame:
    """One attribute's claims that say something, the last of each entity."""
    e = table(spark, d, "events")
    rows = e.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity_id"), F.col("event_type").alias("attribute"), F.lit("events").alias("source"),
        F.get_json_object("props", "$.k").alias("value_json"), F.lit(1).alias("priority"), F.col("event_id").alias("seq"),
    )
    last = claims.last_wins(claims.truthy_claims(rows.filter("attribute = 'click'")))
    return last.select("entity_id", "value_json")


def discrepancy_counts(spark: SparkSession, d: str) -> DataFrame:
    """Disagreements, once per entity and attribute, counted by attribute and kind."""
    found = resolve.discrepancies(order_claims(spark, d))
    return found.groupBy("attribute", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("n_entities"))


def replay_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A replay against several tables, of which the first that has the entity counts."""
    ledger = order_claims(spark, d)
    won = resolve.resolve(ledger).select("entity_id", "attribute", "value_json")
    even = won.filter("right(entity_id, 1) in ('0', '2', '4', '6', '8')")
    first = even.select(F.lit("urgent").alias("table_name"), "entity_id", "attribute", F.when(F.col("attribute") == "status", F.lit("?")).otherwise(F.col("value_json")).alias("value_json"))
    tables = first.unionByName(won.select(F.lit("orders").alias("table_name"), "entity_id", "attribute", "value_json"))
    found = audit.replay(ledger, tables, F.lit(True), candidates=[("urgent", F.col("entity_id")), ("orders", F.col("entity_id"))])
    return found.groupBy("attribute", "source", "bucket").agg(F.count(F.lit(1)).alias("n"))


def source_attributes(spark: SparkSession, d: str) -> DataFrame:
    """What each source makes claims about."""
    return audit.claimed_attributes(order_claims(spark, d))


def canonical_columns(spark: SparkSession, d: str) -> DataFrame:
    """The names of all columns of the tables that hold facts, in order."""
    tables = {n: table(spark, d, n) for n in ALL_TABLES}
    return spark.createDataFrame([(n,) for n in audit.canonical_names(tables)], "column_name string")


def path_sets(spark: SparkSession, d: str) -> DataFrame:
    """The paths of all mega records at any depth, and which of them a look one level down misses."""
    t = template_from({"source_key": "m", "endpoint": "mega_pokemon"})
    records = extract.unwrap(payload_documents(spark, d, "mega_pokemon"), t)
    walked = spark.createDataFrame([(p,) for p in sorted(profiling.all_paths(records))], "path string")
    flat = profiling.record_fields(records).select("path").distinct()
    either, only = audit.path_differences(walked, flat, flat.limit(0))
    return either.join(only.withColumn("deep", F.lit(True)), "path", "left").select("path", F.coalesce("deep", F.lit(False)).alias("deep"))


def kind_records(spark: SparkSession, d: str) -> DataFrame:
    """Objects of several kinds in one list, as one flat table of a kind."""
    e = table(spark, d, "events")
    text = F.concat(F.lit('[{"templateId": "T'), F.col("event_id").cast("string"), F.lit('", "data": {"'), F.col("event_type"), F.lit('": {"p": '), F.col("props"), F.lit("}}}]"))
    records = D.heterogeneous_records(e.select(F.parse_json(text).alias("doc")))
    return D.records_of_kind(records, "click").select("template_id", F.col("`p.k`").cast("bigint").alias("k"))


def domain_row_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows per table of a build."""
    return sinks.domain_counts({n: table(spark, d, n) for n in ("species", "forms", "moves", "raid_bosses", "community_days")})


def coverage_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many fields each tier has."""
    return audit.tier_counts(coverage_tiers(spark, d))


def mapped_field_paths(spark: SparkSession, d: str) -> DataFrame:
    """The paths that a template reads, fallbacks and nested ones included."""
    t = template_from({
        "source_key": "m", "endpoint": "e", "field_mappings": {"name": {"source_field": "names.English", "transform": "nested_path", "fallback_field": "id"}},
        "sub_records": [{"list_field": "forms", "field_mappings": {"form_name": {"source_field": "form"}}}],
    })
    return spark.createDataFrame(audit.mapped_fields(t), "path string, attribute string")


def claims_dump(spark: SparkSession, d: str) -> DataFrame:
    """Parsed claims as JSON lines under their source and snapshot, read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/dump-{uuid.uuid4().hex}"
    path = sinks.dump_claims(eav_unpivot(spark, d), folder, "parts", "2031-01-01T000000Z")
    return spark.read.schema("entity_id string, attribute string, value_json string, record bigint, place bigint").json(path)


def submission_claims(spark: SparkSession, d: str) -> DataFrame:
    """Submitted rows as claims of their trust tier; rows that name nothing give none."""
    c = table(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("entity"), F.when(F.col("c_nationkey") == 3, F.lit("")).otherwise(F.col("c_mktsegment")).alias("field"),
        F.lit("").alias("value"), F.col("c_custkey").cast("string").alias("new_value"),
    )
    return sinks.submissions_as_claims(c)


def array_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every array at the top of a document as a table of its own, empty ones too."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    nations = n.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nationList"))
    names = r.agg(F.array_sort(F.collect_list("r_name")).alias("regionNames"))
    doc = nations.withColumn("_k", F.lit(1)).join(names.withColumn("_k", F.lit(1)), "_k")  # one row each
    doc = doc.select(F.parse_json(F.to_json(F.struct("nationList", "regionNames", F.array().cast("array<string>").alias("emptyOne"), F.lit(1).alias("scalar")))).alias("doc"))
    counts = sinks.write_arrays(doc, f"{ensure_checkpoint_dir(spark)}/arrays-{uuid.uuid4().hex}")
    return spark.createDataFrame(sorted(counts.items()), "table_name string, n_rows bigint")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        trust_resolve, discrepancy_rows, disputed_claim_rows, last_wins_collapse, eav_unpivot, eav_pivot, first_seen_entities, upsert_resolved, fallback_join,
        norm_name_join, existence_flags, enrichment_join, left_anti_rows, not_beneath_paths, json_nested_path, json_flatten_fields, catalog_sample,
        list_index_explode, bool_truthy, slugify_chain, regex_extract_int, camel_snake, gender_signal_case, identity_normalise, latest_snapshot,
        snapshot_diff, entity_created, ledger_replay, coverage_tiers, rank_identity, range_pairs, fingerprint, schema_inventory, top_tables,
        dup_identity_check, union_tagged, search_filter, crosstab_unpivot, keyed_list_rows, conditional_array, passthrough_templates,
        raid_boss_records, mega_records, mega_by_template_key, species_names, first_by_priority, top_orders, bool_group_counts, format_roundtrip,
        custom_table_sql, single_object_record, override_claims, sub_record_claims, polymorphic_members, shouted_types, canonical_values, attribute_claims,
        discrepancy_counts, replay_candidates, source_attributes, canonical_columns, path_sets, kind_records, domain_row_counts, coverage_totals,
        mapped_field_paths, claims_dump, submission_claims, array_tables,
    )
}
