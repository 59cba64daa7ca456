"""SQL (DuckDB) that checks the general problems' queries on the same tables."""

from __future__ import annotations

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(160) || chr(12288)"


def trimmed(c: str) -> str:
    return f"trim(cast({c} as varchar), {BLANKS})"


def filled(c: str) -> str:
    return f"nullif({trimmed(c)}, '')"


def norm_id(c: str) -> str:
    return f"lower({filled(c)})"


def instant(c: str) -> str:
    t = trimmed(c)
    form = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}):?(\d{2}):?(\d{2})(\.\d+)?([zZ]|[+-]\d{2}:?\d{2})?$"
    part = lambda i: f"regexp_extract({t}, '{form}', {i})"
    zone = part(6)
    offset = (
        f"case when {zone} in ('', 'z', 'Z') then 0 else (case left({zone}, 1) when '-' then -1 else 1 end) "
        f"* (cast(substr({zone}, 2, 2) as bigint) * 60 + cast(right({zone}, 2) as bigint)) end"
    )
    local = f"epoch_us(cast({part(1)} || ' ' || {part(2)} || ':' || {part(3)} || ':' || {part(4)} || {part(5)} as timestamp))"
    return f"case when regexp_full_match({t}, '-?[0-9]{{1,15}}') then cast({t} as bigint) * 1000 when regexp_matches({t}, '{form}') then {local} - ({offset}) * 60000000 end"


def value(c: str) -> str:
    t = filled(c)
    return (
        f"case when lower({t}) in ('none', 'nan') then null when lower({t}) in ('true', 'false') then lower({t}) "
        f"when regexp_full_match({t}, '[+-]?[0-9]{{1,26}}(\\.[0-9]{{0,12}})?') then cast(cast({t} as decimal(38, 12)) as varchar) else {t} end"
    )


P1 = f"""
with p as (
  select distinct {norm_id('entity_id')} e, {norm_id('attribute')} a, {instant('recorded_at')} t, {value('old_value')} o, {value('new_value')} n
  from change_history
), k as (select * from p where e is not null and a is not null and t is not null),
f as (
  select e, a, t, min(n) n from k x where not exists (
    select 1 from k y where y.e = x.e and y.a = x.a and y.t = x.t and y.o is not distinct from x.n
    and not (y.o is not distinct from x.o and y.n is not distinct from x.n)) group by e, a, t
), s as (
  select e, a, t, min(o) o from k x where not exists (
    select 1 from k y where y.e = x.e and y.a = x.a and y.t = x.t and y.n is not distinct from x.o
    and not (y.o is not distinct from x.o and y.n is not distinct from x.n)) group by e, a, t
), v as (
  select f.e, f.a, f.t, f.n, row_number() over w r, lag(f.n) over w p, s.o from f left join s using (e, a, t) window w as (partition by f.e, f.a order by f.t)
), c as (select * from v where n is distinct from (case when r = 1 then o else p end))
select e as entity_id, a as attribute, t // 1000000 as valid_from_s,
  coalesce(lead(t) over (partition by e, a order by t) // 1000000, -1) as valid_to_s from c
"""


def json_text(c: str) -> str:
    """JSON objects by content: their keys in order, each with its value's text."""
    t = filled(c)
    return (
        f"case when {t} is not null then (select string_agg(k || '=' || coalesce(cast(json_extract(cast({t} as json), '$.\"' || k || '\"') as varchar), ''), '|' order by k) "
        f"from (select unnest(json_keys(cast({t} as json))) as k)) end"
    )


SNAPSHOT_COLUMNS = {
    "species": ("slug", "dex_number name gen can_mega_evolve can_gigantamax buddy_distance_km base_attack base_defense base_stamina max_cp_lvl40 localized_names types"),
    "forms": (
        "slug",
        "species_slug dex_number form_name costume_name costume_display_name gender shiny_available shiny_release_date shadow_available "
        "buddy_distance_km base_attack base_defense base_stamina max_cp_lvl40 image_url shiny_image_url",
    ),
    "moves": ("move_id", "name move_type is_fast pve_power pve_duration_ms pve_energy_delta pvp_power pvp_energy_cost pvp_cooldown_turns stat_buffs"),
}


def changes(name: str) -> str:
    key, columns = SNAPSHOT_COLUMNS[name]
    content = []
    for c in columns.split():
        e = json_text(c) if c in ("localized_names", "stat_buffs") else norm_id(c) if c == "species_slug" else filled(c)
        content.append(f"coalesce({e}, chr(1))")
    digest = " || chr(2) || ".join(content)
    return f"""(
with r as (select {norm_id(key)} k, snapshot_ts s, loaded_at l, {digest} d from {name}),
x as (select k, s, arg_max(d, l) d from r where k is not null and s is not null group by k, s),
o as (select s, lag(s) over (order by s) p from (select distinct s from x)),
n as (select o.s, x.k, x.d from x join o on x.s = o.s where o.p is not null),
b as (select o.s, x.k, x.d from x join o on x.s = o.p)
select '{name}' as table_name, strftime(coalesce(n.s, b.s), '%Y-%m-%d') as period, coalesce(n.k, b.k) as record_key,
  case when b.k is null then 'added' when n.k is null then 'removed' else 'changed' end as change_kind
from n full join b on n.s = b.s and n.k = b.k where n.d is distinct from b.d)"""


P3 = " union all ".join(changes(n) for n in SNAPSHOT_COLUMNS)


def orphan(name: str, rows: str, key: str) -> str:
    return f"""
select distinct '{name}' as table_name, strftime(c.s, '%Y-%m-%d') as period, c.k as record_key,
  case when m.lo < c.s then 'deleted' when m.hi > c.s then 'late' else 'missing' end as orphan_kind
from ({rows}) c left join (select {norm_id(key)} r, min(snapshot_ts) lo, max(snapshot_ts) hi from species group by 1) m on m.r = c.r
where c.r is not null and c.k is not null and not exists (select 1 from species p where p.snapshot_ts = c.s and {norm_id('p.' + key)} = c.r)"""


P4 = " union all ".join(
    [
        orphan("forms", f"select {norm_id('slug')} k, snapshot_ts s, arg_max(coalesce({norm_id('species_slug')}, ''), loaded_at) r0, nullif(r0, '') r from forms group by 1, 2", "slug"),
        orphan("raid_bosses", f"select {norm_id('boss_id')} k, snapshot_ts s, replace({norm_id('pokemon_id')}, '_', '-') r from raid_bosses", "slug"),
        orphan("community_days", f"select {norm_id('event_id')} k, snapshot_ts s, {norm_id('featured_pokemon')} r from community_days", "name"),
    ]
)



def logged(name: str, key: str) -> str:
    """Entries of the change log about one table, against that table's last snapshot."""
    last = f"(select max(snapshot_ts) from {name})"
    return f"""
select 'change_history' as t, {last} as s, e.k, 0 as depth, case when m.lo < {last} then 'deleted' else 'missing' end as kind
from (select distinct {norm_id('entity_id')} k from change_history) e
left join (select {norm_id(key)} r, min(snapshot_ts) lo from {name} group by 1) m on m.r = substr(e.k, {len(name) + 2})
where starts_with(e.k, '{name}:') and {last} is not null
and not exists (select 1 from {name} p where p.snapshot_ts = {last} and {norm_id('p.' + key)} = substr(e.k, {len(name) + 2}))"""


#: Every reference as (child, child's snapshot, child's key, parent, parent's snapshot, parent's key); species have no parent.
EDGES = " union all ".join(
    f"select 'change_history' as ct, (select max(snapshot_ts) from {n}) as cs, {norm_id('entity_id')} as ck, '{n}' as pt, "
    f"(select max(snapshot_ts) from {n}) as ps, substr({norm_id('entity_id')}, {len(n) + 2}) as pk from change_history where starts_with({norm_id('entity_id')}, '{n}:')"
    for n in ("species", "forms", "moves")
) + "".join(
    f" union all select '{n}', snapshot_ts, {norm_id(key)}, 'species', snapshot_ts, '' from {n}"  # a species is never an orphan itself
    for n, key in (("forms", "slug"), ("raid_bosses", "boss_id"), ("community_days", "event_id"))
)
P4_CASCADE = f"""
with recursive direct as (
  select table_name as t, strptime(period, '%Y-%m-%d') as day, record_key as k, 0 as depth, orphan_kind as kind from ({P4})
  union select t, date_trunc('day', s), k, depth, kind from ({logged('species', 'slug')} union all {logged('forms', 'slug')} union all {logged('moves', 'move_id')})
), edges as (select distinct ct, date_trunc('day', cs) cs, ck, pt, date_trunc('day', ps) ps, pk from ({EDGES})),
reached as (
  select t, day, k, 0 as depth from direct
  union select e.ct, e.cs, e.ck, r.depth + 1 from reached r join edges e on e.pt = r.t and e.ps = r.day and e.pk = r.k where r.depth < 10
)
select t as table_name, strftime(day, '%Y-%m-%d') as period, k as record_key, kind as orphan_kind, depth from direct
union all select t, strftime(day, '%Y-%m-%d'), k, 'inherited', min(depth) from reached x
where not exists (select 1 from direct y where y.t = x.t and y.day = x.day and y.k = x.k) group by 1, 2, 3"""


def members(array: str, source: str) -> str:
    """Each element of a JSON array with its position from 0."""
    return f"unnest(from_json({array}, '[\"json\"]')) as r, generate_subscripts(from_json({array}, '[\"json\"]'), 1) - 1 as pos from ({source})"


def files(endpoint: str) -> str:
    return f"select payload_id, payload from raw_payloads where endpoint = '{endpoint}' and json_valid(payload)"


RAID = f"""(select payload_id, tier, {members('list', f"""
  select payload_id, tier, json_extract(payload, '$.currentList."' || tier || '"') as list from (
    select payload_id, payload, unnest(json_keys(payload, '$.currentList')) as tier from ({files('raidboss')}) where json_type(payload, '$.currentList') = 'OBJECT')""")})"""
MEGA = f"(select payload_id, {members('payload', files('mega_pokemon'))})"
TYPES = f"(select payload_id, {members('payload', files('types'))})"


def given(*paths: str) -> str:
    """The first of several fields that isn't null."""
    return "coalesce(" + ", ".join(f"nullif(json_extract(r, '$.{p}'), 'null')" for p in paths) + ")"


def bound(v: str, i: int, name: str) -> str:
    one = (
        f"case json_type({v}) when 'ARRAY' then json_extract_string({v}, '$[{i}]') when 'OBJECT' then json_extract_string({v}, '$.{name}') "
        f"when 'VARCHAR' then nullif(split_part(json_extract_string({v}, '$'), '-', {i + 1}), '') end"
    )
    return f"cast(cast({one} as double) as bigint)"


CP = " union all ".join(
    f"select payload_id, tier || '/' || pos as parent_key, '{child}' as child_key, {bound(given(*names), i, end)} as cp, "
    f"'boss_cp_' || case json_type({given(*names)}) when 'ARRAY' then 'pair' when 'OBJECT' then 'bounds' else 'range_text' end as variant from {RAID}"
    for names, ends in ((("cpRange", "cp_range"), ("min", "max")), (("cpRangeBoost", "boostedCpRange"), ("boosted_min", "boosted_max")))
    for i, (child, end) in enumerate(zip(ends, ("min", "max")))
)
STATS = " union all ".join(
    f"select payload_id, cast(pos as varchar) as parent_key, '{stat}' as child_key, cast(cast(json_extract_string({v}, case json_type({v}) when 'OBJECT' then '$.value' else '$' end) as double) as bigint) as stat, "
    f"'mega_stat_' || case json_type({v}) when 'OBJECT' then 'boxed' when 'VARCHAR' then 'number_text' else 'number' end as variant from {MEGA}"
    for stat, v in (
        ("base_attack", given("stats.base_attack", "stats.baseAttack")), ("base_defense", given("stats.base_defense")), ("base_stamina", given("stats.base_stamina", "stats.base_hp"))
    )
)
WEATHER = given("weatherBoost.names")
NAMES = f"""
select payload_id, 'boss_name' as child_kind, p as parent_key, k as child_key, false as is_text from (
  select payload_id, tier || '/' || pos as p, r, unnest(json_keys(r, '$.names')) as k from {RAID}) where json_type(r, '$.names."' || k || '"') <> 'NULL'
union all select payload_id, 'weather_name', json_extract_string(r, '$.type'), 'English', true from {TYPES} where json_type({WEATHER}) = 'VARCHAR'
union all select payload_id, 'weather_name', t, k, false from (
  select payload_id, json_extract_string(r, '$.type') as t, r, unnest(json_keys({WEATHER})) as k from {TYPES} where json_type({WEATHER}) = 'OBJECT'
) where json_type(r, '$.weatherBoost.names."' || k || '"') <> 'NULL'"""
P6 = f"""
select payload_id, 'boss' as child_kind, tier as parent_key, cast(pos as varchar) as child_key from {RAID} where json_type(r) = 'OBJECT'
union all select payload_id, child_kind, parent_key, child_key from ({NAMES})
union all select payload_id, 'boss_cp', parent_key, child_key from ({CP}) where cp is not null
union all select payload_id, 'mega_stat', parent_key, child_key from ({STATS}) where stat is not null"""

ORACLE_SQL = {
    "p6_found": P6,
    "p6_cp_bounds": f"select payload_id, parent_key, child_key, variant, cp from ({CP}) where cp is not null",
    "p6_mega_stats": f"select payload_id, parent_key, child_key, variant, stat from ({STATS}) where stat is not null",
    "p6_variants": f"""
select child_kind, variant, count(*) as n_rows, count(distinct payload_id) as n_payloads from (
  select 'boss_cp' as child_kind, variant, payload_id from ({CP}) where cp is not null
  union all select 'mega_stat', variant, payload_id from ({STATS}) where stat is not null
  union all select child_kind, child_kind || '_' || case when child_kind = 'weather_name' and is_text then 'text' else 'labels' end, payload_id from ({NAMES})
) group by all""",
    "p1_found": P1,
    "p3_found": P3,
    "p3_summary": f"select table_name, period, change_kind, count(*) as n_records from ({P3}) group by all",
    "p4_found": P4,
    "p4_cascade": P4_CASCADE,
    "p4_report": f"select table_name, period, orphan_kind, depth, count(*) as n_records from ({P4_CASCADE}) group by all",
}
