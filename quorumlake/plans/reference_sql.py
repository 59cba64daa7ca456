"""SQL (DuckDB) that checks the reconciliation queries on the same tables."""

from __future__ import annotations

CLAIMS = """(
select 'order_' || o_orderkey as entity_id, a.attribute, 'order_desk' as source, a.v as value_json, 2 as priority, (0, o_orderkey, a.i) as seq
from orders, lateral (values ('total', cast(cast(o_totalprice as decimal(18,2)) as varchar), 0), ('status', o_orderstatus, 1), ('priority', o_orderpriority, 2)) a(attribute, v, i)
union all
select 'order_' || k, a.attribute, 'line_totals', a.v, 6, (1, k, a.i)
from (select l_orderkey k, sum(cast(l_extendedprice as decimal(18,2))) t, max(l_linestatus) s from lineitem group by 1),
lateral (values ('total', cast(cast(t as decimal(28,2)) as varchar), 0), ('status', s, 1)) a(attribute, v, i)
union all
select 'order_' || o_orderkey, 'segment', 'customer_file', c_mktsegment, 7, (2, o_orderkey, 0) from orders join customer on o_custkey = c_custkey
)"""
RESOLVED = f"""
select entity_id, attribute, arg_min(value_json, (priority, seq)) as value_json, arg_min(source, (priority, seq)) as winning_source,
  count(*) as n_claims, count(distinct value_json) as n_distinct from {CLAIMS} where value_json is not null group by 1, 2"""

RECORDS = "(select event_id, props as record from events)"
MEGA = """(select payload_id, unnest(from_json(payload, '["json"]')) as r, generate_subscripts(from_json(payload, '["json"]'), 1) - 1 as pos
from (select * from raw_payloads where endpoint = 'mega_pokemon' and json_valid(payload)))"""
RAID = """(select payload_id, tier, unnest(from_json(list, '["json"]')) as b from (
  select payload_id, tier, json_extract(payload, '$.currentList."' || tier || '"') as list from (
    select payload_id, payload, unnest(json_keys(payload, '$.currentList')) as tier from raw_payloads
    where endpoint = 'raidboss' and json_valid(payload) and json_type(payload, '$.currentList') = 'OBJECT')))"""


def title(c: str) -> str:
    """Letters after anything but a letter in upper case, all others lower (ASCII)."""
    return f"list_aggregate(list_transform(regexp_extract_all({c}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '')"


def token(t: str, species: str) -> str:
    """The words of a variant's text that tell it apart, with hyphens; null for none. species is one word."""
    words = f"list_filter(string_split_regex(lower({t}), '[^a-z0-9]+'), lambda x: x not in ('', 'female', 'male'))"
    rest = f"case when {words}[1] = {species} then {words}[2:] when {words}[-1] = {species} then {words}[:-2] else {words} end"
    return f"nullif(array_to_string({rest}, '-'), '')"


PART_WORDS = "split_part(p_name, ' ', 1)"
SPELLED = (
    f"case p_partkey % 5 when 0 then {PART_WORDS} || ' (Female)' when 1 then upper({PART_WORDS}) || '_' || split_part(p_name, ' ', 2) "
    f"when 2 then split_part(p_name, ' ', 2) || ' female ' || {PART_WORDS} when 3 then 'Standard' end"
)
IDENTITY = f"""
select p_partkey, nullif(f, 'standard') as form_token, c as costume_token,
  'dex_' || (p_partkey % 10) || '_form_' || coalesce(nullif(concat_ws('_', nullif(f, 'standard'), c, case when p_partkey % 5 in (0, 2) then 'female' end), ''), 'standard') as entity_id
from (select p_partkey, {token(SPELLED, PART_WORDS)} as f, {token("case when p_size % 3 = 0 then lower(p_type) end", PART_WORDS)} as c from part)"""

KEY = "trim(regexp_replace(upper(p_name || ' ' || (p_partkey % 50)), '[^A-Z0-9]+', '_', 'g'), '_')"
FALLBACK = f"""
with o as (select move, min(seq) seq, arg_min(brand, seq) brand from (
  select case when p_partkey % 3 = 0 then {KEY} || '_FAST' else {KEY} end as move, p_partkey as seq, p_brand as brand from part) group by move)
select p.p_partkey, coalesce(a.seq, b.seq) as partner, case when a.seq is not null then a.brand else b.brand end as partner_brand
from (select *, {KEY} as k from part) p left join o a on a.move = p.k left join o b on p.p_size > 20 and b.move = p.k || '_FAST'"""

TEXT = "p_name || ' ' || p_brand || ' ' || p_type"
OLD = """(select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus,
  case when o_orderkey % 5 = 0 then null else cast(o_totalprice as decimal(18,2)) end as total, o_orderpriority from orders where o_orderkey % 11 <> 3)"""
NEW = "(select o_orderkey, o_orderstatus, cast(o_totalprice as decimal(18,2)) as total, o_orderpriority from orders where o_orderkey % 13 <> 4)"
DIFF = f"""
select cast(n.o_orderkey as varchar) as record_key, 'entity_created' as attribute, cast(null as varchar) as old_value, cast(n.o_orderkey as varchar) as new_value
from {NEW} n where not exists (select 1 from {OLD} o where o.o_orderkey = n.o_orderkey)
union all select cast(n.o_orderkey as varchar), a.attribute, a.o, a.n from {NEW} n join {OLD} o on o.o_orderkey = n.o_orderkey,
lateral (values ('o_orderstatus', o.o_orderstatus, n.o_orderstatus), ('total', cast(o.total as varchar), cast(n.total as varchar)), ('o_orderpriority', o.o_orderpriority, n.o_orderpriority)) a(attribute, o, n)
where a.o is distinct from a.n"""

REPLAY = f"""
with c as (select * from {CLAIMS} where value_json is not null), r as ({RESOLVED}),
s as (select entity_id, attribute, value_json as stored from r where not (attribute = 'priority' and value_json = '5-LOW')),
j as (select c.*, s.stored, r.value_json as won, r.winning_source as ws from c join r using (entity_id, attribute) left join s using (entity_id, attribute)),
b as (select source, case when attribute = 'segment' then 'unmapped' when value_json = stored then 'matched' when won = stored and ws <> source then 'overridden'
  when won = stored then 'collision' else 'gap' end as bucket from j)
select source, count(*) filter (bucket = 'matched') as matched, count(*) filter (bucket = 'overridden') as overridden,
  count(*) filter (bucket = 'collision') as collision, count(*) filter (bucket = 'gap') as gap, count(*) filter (bucket = 'unmapped') as unmapped from b group by source"""

ALL_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "species", "forms", "moves", "raid_bosses", "community_days", "change_history", "discrepancies", "source_registry", "raw_payloads", "benchmark",
]
SIZES = " union all ".join(f"select '{t}' as table_name, count(*) as row_count, cast((select count(*) from (describe {t})) as bigint) as field_count from {t}" for t in ALL_TABLES)

ORACLE_SQL = {
    "trust_resolve": RESOLVED,
    "discrepancy_rows": f"""
select c.entity_id, c.attribute, string_agg(c.source || '=' || c.value_json, ';' order by c.seq) as said, any_value(r.value_json) as resolved_value,
  any_value(r.winning_source) as winning_source, case when count(distinct c.source) = 1 then 'self' else 'cross_source' end as kind
from {CLAIMS} c join ({RESOLVED}) r on r.entity_id = c.entity_id and r.attribute = c.attribute where r.n_distinct > 1 and c.value_json is not null group by 1, 2""",
    "disputed_claim_rows": f"""
select c.entity_id, c.attribute, c.source, c.value_json, r.value_json as resolved_value, r.winning_source
from {CLAIMS} c join ({RESOLVED}) r on r.entity_id = c.entity_id and r.attribute = c.attribute where r.n_distinct > 1 and c.value_json is not null""",
    "last_wins_collapse": """
select 'user_' || user_id as entity_id, event_type as attribute, arg_max(cast(cast(value as decimal(18,2)) as varchar), event_id) as value_json, min(event_id) as first_seq
from events group by 1, 2""",
    "eav_unpivot": """
select 'part_' || p_partkey as entity_id, a.attribute, a.v as value_json, p_partkey as record, cast(a.i as bigint) as place from part,
lateral (values ('brand', p_brand, 0), ('type', p_type, 1), ('size', case when p_size > 5 then cast(p_size as varchar) end, 2)) a(attribute, v, i) where a.v is not null""",
    "eav_pivot": f"""
select entity_id, max(value_json) filter (attribute = 'total') as total, max(value_json) filter (attribute = 'status') as status,
  max(value_json) filter (attribute = 'priority') as priority, max(value_json) filter (attribute = 'segment') as segment from ({RESOLVED}) group by 1""",
    "first_seen_entities": f"select entity_id, cast(part as bigint) as part, cast(place as bigint) as place from (select entity_id, min(seq) as s, s[1] as part, s[3] as place from {CLAIMS} where value_json is not null group by 1)",
    "upsert_resolved": """
select o_orderkey, 'user_' || o_custkey as entity, coalesce(v, 'none') as click_value, o_orderstatus as status from orders left join (
  select user_id, arg_max(cast(cast(value as decimal(18,2)) as varchar), event_id) as v from events where event_type = 'click' group by 1) on user_id = o_custkey""",
    "fallback_join": FALLBACK,
    "norm_name_join": """
select s_suppkey, c_custkey, k from (select s_suppkey, 'ENTITY_' || substr(s_name, 10) as k from supplier)
left join (select c_custkey, 'ENTITY_' || substr(c_name, 10) as k from customer) using (k)""",
    "existence_flags": """
select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as has_orders,
  exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') as has_urgent from customer""",
    "enrichment_join": """
select c_custkey, n_name, r_name, coalesce(n, 0) as n_orders from customer left join nation on c_nationkey = n_nationkey
left join region on n_regionkey = r_regionkey left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey""",
    "left_anti_rows": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)",
    "not_beneath_paths": """
with p as (select distinct replace(p_name, ' ', '.') || '.' || lower(p_type) as path from part),
c as (select distinct regexp_extract(p_name, '^([a-z]+)', 1) as path from part where p_size = 7 and p_brand = 'Brand#2')
select path from p where not exists (select 1 from c where p.path = c.path or starts_with(p.path, c.path || '.'))""",
    "json_nested_path": "select event_id, cast(json_extract(props, '$.k') as bigint) as k, json_extract(props, '$.a.b') is null as missing from events",
    "json_flatten_fields": """
select k as path, count(*) as n_present, 'number' as types, arg_min(v, event_id) as example from (
  select event_id, k, cast(json_extract(props, '$.' || k) as varchar) as v from (select event_id, props, unnest(json_keys(props)) as k from events)) group by 1""",
    "catalog_sample": """
select k as path, count(*) as n_present, 'number' as types, arg_min(v, event_id) as example from (
  select event_id, k, cast(json_extract(props, '$.' || k) as varchar) as v from (select event_id, props, unnest(json_keys(props)) as k from events where event_id < 200)) group by 1""",
    "list_index_explode": """
select vec_id, cast(generate_subscripts(embedding, 1) as double) as level, cast(unnest(embedding) as double) as value from embeddings""",
    "bool_truthy": """
select event_id, k <> 0 as k_true, case when k % 2 = 0 then false else true end as even_true, case when k % 2 = 0 then 'none' else cast(k as varchar) end as chosen
from (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events)""",
    "slugify_chain": f"""
select p_partkey, replace(replace(lower({TEXT}), '_', '-'), ' ', '-') as slug, trim(regexp_replace(lower({TEXT}), '[^a-z0-9]+', '-', 'g'), '-') as identity,
  lower(trim(regexp_replace(regexp_replace({TEXT}, '[^0-9A-Za-z_]', '_', 'g'), '_+', '_', 'g'), '_')) as safe, {title(TEXT)} as title,
  p_partkey || '-' || replace(lower(p_name), ' ', '-') as species, '#' || lpad(cast(p_size as varchar), 3, '0') as number, upper(p_type[1]) || lower(p_type[2:]) as word from part""",
    "regex_extract_int": """
select s_suppkey, cast(cast(regexp_extract(s_name, '^Supplier#([0-9]+)$', 1) as bigint) as varchar) as number, cast(null as varchar) as none, 'Supplier' as word from supplier""",
    "camel_snake": f"""
select camel, lower(regexp_replace(camel, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) as snake from (select distinct replace({title('p_name')}, ' ', '') as camel from part)""",
    "gender_signal_case": """
select doc_id, case when n_chars > 3000 then 'long' when regexp_matches(source, '(?i)^WIKI') then 'wiki' when regexp_matches(coalesce(lang, ''), '^[Ee]n') then 'english' else 'unknown' end as label from documents""",
    "identity_normalise": IDENTITY,
    "latest_snapshot": """
with f as (select lower(trim(slug, ' ' || chr(9))) as slug, snapshot_ts, loaded_at from forms)
select f.* from f join (select slug, max(snapshot_ts) as m from f group by 1) x on x.slug = f.slug and x.m = f.snapshot_ts""",
    "snapshot_diff": DIFF,
    "entity_created": f"select record_key, new_value from ({DIFF}) where attribute = 'entity_created'",
    "ledger_replay": REPLAY,
    "coverage_tiers": f"""
with t as (select k, json_extract(r, '$."' || k || '"') as v from (select r, unnest(json_keys(r)) as k from {MEGA})),
p as (select distinct k as path from t union select k || '.' || unnest(json_keys(v)) from t where json_type(v) = 'OBJECT')
select path, case when path in ('pokemon_id', 'mega_name') then 'CANONICAL' when path in ('stats.base_attack', 'form') then 'CLAIMS_ONLY' else 'MISSING' end as tier from p""",
    "rank_identity": """
select path, n_unique, row_number() over (order by n_unique desc, path) as rank from (
  select 'c_custkey' as path, count(distinct c_custkey) as n_unique from customer union all select 'c_nationkey', count(distinct c_nationkey) from customer
  union all select 'c_mktsegment', count(distinct c_mktsegment) from customer)""",
    "range_pairs": f"""
with f as (select k, json_extract(b, '$."' || k || '"') as v from (select b, unnest(json_keys(b)) as k from {RAID}))
select distinct k as path, 'min_' || k as low, 'max_' || k as high from f
where json_type(v) = 'ARRAY' and json_array_length(v) = 2 and json_type(v, '$[0]') in ('UBIGINT', 'BIGINT', 'DOUBLE') and json_type(v, '$[1]') in ('UBIGINT', 'BIGINT', 'DOUBLE')""",
    "fingerprint": """select 'sha256:' || substr(sha256('["k"]'), 1, 16) as fingerprint""",
    "schema_inventory": SIZES,
    "top_tables": f"select table_name, row_count from ({SIZES}) order by row_count desc, table_name limit 3",
    "dup_identity_check": "select sha256(text) as digest, count(*) as n from documents group by 1 having count(*) > 1",
    "union_tagged": "select s_suppkey as id, s_name as name, true as is_supplier from supplier union all select c_custkey, c_name, false from customer",
    "search_filter": """
select p_partkey, p_name from part where contains(lower(p_name), 'ring') or contains(cast(p_partkey as varchar), '77') or starts_with(lower(p_type), 'eco')""",
    "crosstab_unpivot": "select r_name as region, n_name as nation, cast(n_nationkey as double) as value from nation join region on n_regionkey = r_regionkey",
    "keyed_list_rows": "select 'region_' || n_regionkey as region, string_agg(n_name, ',' order by n_name) as nations from nation group by 1",
    "conditional_array": """
select c_custkey, '[' || concat_ws(',', case when c_acctbal > 5000 then '"rich"' end, case when c_acctbal < 0 then '"debt"' end, case when c_mktsegment = 'BUILDING' then '"builder"' end) || ']' as flags,
  concat_ws(',', case when c_nationkey > 12 then c_mktsegment end, case when c_custkey % 2 = 0 then 'even' end) as both from customer""",
    "passthrough_templates": """
select 'T' || event_id as template_id, event_type as record_type, '{"templateId": "T' || event_id || '", "' || event_type || '": ' || props || ', "a": 1}' as data_json from events""",
    "raid_boss_records": f"""
select payload_id, tier, json_extract_string(b, '$.id') as pokemon_id, coalesce(json_extract_string(b, '$.names.English'), json_extract_string(b, '$.id')) as name,
  replace(lower(json_extract_string(b, '$.id')), '_', '-') as slug, case when json_type(b, '$.cpRange') = 'ARRAY' then cast(json_extract(b, '$.cpRange[0]') as bigint) end as min_cp,
  case json_type(b, '$.shiny') when 'BOOLEAN' then cast(json_extract_string(b, '$.shiny') as boolean) when 'VARCHAR' then json_extract_string(b, '$.shiny') <> ''
    when 'NULL' then null else cast(json_extract(b, '$.shiny') as double) <> 0 end as shiny from {RAID}""",
    "mega_records": f"select payload_id, pos, 'mega_' || json_extract_string(r, '$.pokemon_id') as entity_id, json_extract_string(r, '$.mega_name') as mega_name from {MEGA}",
    "mega_by_template_key": f"""
select payload_id, pos, json_extract_string(r, '$.mega_name') as mega_name, json_extract_string(r, '$.stats.base_defense') as base_defense
from {MEGA} where json_type(r, '$.stats') = 'OBJECT' and len(json_keys(r, '$.stats')) > 0""",
    "species_names": """
select dex_number, language, count(distinct name) as n_names, min(name) as first_name from (
  select dex_number, language, json_extract_string(localized_names, '$."' || language || '"') as name from (
    select dex_number, localized_names, unnest(json_keys(localized_names)) as language from species where json_valid(localized_names))) group by 1, 2""",
    "first_by_priority": """
select o_custkey, o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) as n from orders) where n = 1""",
    "top_orders": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 30",
    "bool_group_counts": "select source, n_chars > 1000 as is_long, count(*) as n from documents group by 1, 2",
    "format_roundtrip": "select cast(n_nationkey as bigint) as k, n_name as csv_name, n_name as json_name, n_name as parquet_name from nation",
    "custom_table_sql": "select o_orderstatus as status, count(*) as n from orders group by 1",
    "single_object_record": """
select payload_id, len(json_keys(payload, '$.currentList')) as n_tiers from raw_payloads
where endpoint = 'raidboss' and json_valid(payload) and json_type(payload, '$.currentList') = 'OBJECT'""",
    "override_claims": f"""
select 'mega_' || json_extract_string(r, '$.pokemon_id') as entity_id, a as attribute, cast(v as varchar) as value_json, pos as at, cast(i as bigint) as place
from {MEGA}, lateral (values ('shown', json_extract(r, '$.pokemon_name'), 0), ('form', json_extract(r, '$.form'), 1)) x(a, v, i)
where json_extract_string(r, '$.pokemon_id') is not null and json_type(v) <> 'NULL'""",
    "sub_record_claims": f"""
with m as (select json_extract_string(b, '$.id') as id, k, json_extract(b, '$.battleResult."' || k || '"') as o from (
  select b, unnest(json_keys(b, '$.battleResult')) as k from {RAID} where json_type(b, '$.battleResult') = 'OBJECT'))
select 'boss_' || id || '_form_' || k as entity_id, a as attribute, v as value_json, count(*) as n_claims from m,
lateral (values ('dex_number', '"' || id || '"'), ('form_name', '"' || upper(k[1]) || lower(k[2:]) || '"'), ('gender', '"unknown"'),
  ('level', cast(json_extract(o, '$.pokemonLevel') as varchar))) x(a, v)
where id is not null and json_type(o) = 'OBJECT' and v is not null group by 1, 2, 3""",
    "polymorphic_members": f"""
select cast(null as varchar) as record_key, pos as at, count(*) as n from {MEGA} where json_type(r) = 'OBJECT' group by 2
union all select k, i - 1, count(*) from (
  select payload, unnest(json_keys(payload)) as k, generate_subscripts(json_keys(payload), 1) as i from raw_payloads where endpoint = 'raidboss' and json_valid(payload))
where json_type(payload, '$."' || k || '"') = 'OBJECT' group by 1, 2""",
    "shouted_types": """
select t, upper(t[1]) || lower(t[2:]) as shown, upper(t[1]) || lower(t[2:]) as plain from (select distinct upper(trim(move_type)) as t from moves) where t <> ''""",
    "canonical_values": """
select event_id, '{"a":' || json_extract_string(props, '$.k') || ',"b":' || event_id || '}' as json, cast(json_extract(props, '$.k') as bigint) as whole, true as no_whole from events""",
    "attribute_claims": """
select 'user_' || user_id as entity_id, arg_max(json_extract_string(props, '$.k'), event_id) as value_json from events
where event_type = 'click' and cast(json_extract(props, '$.k') as bigint) <> 0 group by 1""",
    "discrepancy_counts": f"""
select attribute, kind, count(*) as n, count(distinct entity_id) as n_entities from (
  select entity_id, attribute, case when count(distinct source) = 1 then 'self' else 'cross_source' end as kind from {CLAIMS}
  where value_json is not null group by 1, 2 having count(distinct value_json) > 1) group by 1, 2""",
    "replay_candidates": f"""
with c as (select * from {CLAIMS} where value_json is not null), r as ({RESOLVED}),
j as (select c.*, r.value_json as won, r.winning_source as ws,
  case when right(entity_id, 1) in ('0', '2', '4', '6', '8') and attribute = 'status' then '?' else r.value_json end as stored from c join r using (entity_id, attribute))
select attribute, source, case when value_json = stored then 'matched' when won = stored and ws <> source then 'overridden' when won = stored then 'collision' else 'gap' end as bucket,
  count(*) as n from j group by 1, 2, 3""",
    "source_attributes": f"select distinct source, attribute from {CLAIMS} where value_json is not null",
    "canonical_columns": "select distinct column_name from (" + " union all ".join(f"select column_name from (describe {t})" for t in ALL_TABLES if t not in ("change_history", "discrepancies")) + ")",
    "path_sets": f"""
with a as (select k, json_extract(r, '$."' || k || '"') as v from (select r, unnest(json_keys(r)) as k from {MEGA})),
b as (select k || '.' || j as k, json_extract(v, '$."' || j || '"') as v from (select k, v, unnest(json_keys(v)) as j from a where json_type(v) = 'OBJECT')),
c as (select k || '.' || j as k from (select k, unnest(json_keys(v)) as j from b where json_type(v) = 'OBJECT'))
select k as path, bool_and(deep) as deep from (select k, false as deep from a union all select k, false from b union all select k, true from c) group by 1""",
    "kind_records": "select 'T' || event_id as template_id, cast(json_extract(props, '$.k') as bigint) as k from events where event_type = 'click'",
    "domain_row_counts": " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in ("species", "forms", "moves", "raid_bosses", "community_days")),
    "mapped_field_paths": "select * from (values ('names.English', 'name'), ('id', 'name'), ('forms.form', 'form_name')) x(path, attribute)",
    "submission_claims": """
select c_name as entity_id, c_mktsegment as attribute, cast(c_custkey as varchar) as value, 'confirmed_owner_submission' as trust_tier
from customer where c_custkey % 5 > 0 and c_nationkey <> 3 and c_mktsegment <> ''""",
    "array_tables": """
select 'refjson_nation_list' as table_name, count(*) as n_rows from nation union all select 'refjson_region_names', count(*) from region union all select 'refjson_empty_one', 0""",
}
ORACLE_SQL["claims_dump"] = ORACLE_SQL["eav_unpivot"]
ORACLE_SQL["coverage_totals"] = f"select tier, count(*) as n from ({ORACLE_SQL['coverage_tiers']}) group by 1"
