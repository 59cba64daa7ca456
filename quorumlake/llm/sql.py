"""SQL (DuckDB) that checks queries of this subpackage on the same tables."""

from __future__ import annotations

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(160) || chr(12288)"


def filled(c: str) -> str:
    return f"nullif(trim(cast({c} as varchar), {BLANKS}), '')"


def source_key(c: str) -> str:
    return f"replace(replace(lower({filled(c)}), '-', '_'), ' ', '_')"


NUMBER = f"try_cast(nullif(regexp_extract({filled('entity_id')}, '([0-9]+)$', 1), '') as bigint)"
PLACEHOLDERS = "('-', '--', '?', '??', 'n/a', 'na', 'nan', 'none', 'null', 'tba', 'tbd', 'unknown')"

CLAIMS = f"""
select distinct c.dex_number, c.attribute, c.claim_id, c.source, c.value, coalesce(r.rank, 99) as rank, c.claimed from (
  select {NUMBER} as dex_number, lower({filled('attribute')}) as attribute, x.claim_id as claim_id, {source_key('x.source')} as source,
    {filled('x.value')} as value, x.claimed_at as claimed
  from (select entity_id, attribute, unnest(claims) as x from discrepancies)
) c left join (select {source_key('source_key')} as source, min(trust_rank) as rank from source_registry group by 1) r on r.source = c.source
where c.value is not null and lower(c.value) not in {PLACEHOLDERS} and c.dex_number is not null and c.attribute is not null and c.claim_id is not null
"""

SURVIVORS = f"""
select dex_number, attribute, claim_id, value, source from (
  select *, row_number() over (partition by dex_number, attribute order by rank, claimed desc nulls last, claim_id) as n from ({CLAIMS})
) where n = 1"""

P5 = f"select dex_number, attribute, claim_id from ({SURVIVORS})"

P5_CORRECTIONS = f"""
select distinct s.row_id, s.dex_number, s.attribute, s.stored_value, s.stored_source, w.value as true_value, w.source as true_source,
  (s.stored_value is not distinct from w.value and s.stored_source is not distinct from w.source) as was_right
from (select row_id, {NUMBER} as dex_number, lower({filled('attribute')}) as attribute, {filled('resolved_value')} as stored_value,
  {source_key('winning_source')} as stored_source from discrepancies) s
join ({SURVIVORS}) w on w.dex_number = s.dex_number and w.attribute = s.attribute"""

ORACLE_SQL = {"p5_found": P5, "p5_corrections": P5_CORRECTIONS}
