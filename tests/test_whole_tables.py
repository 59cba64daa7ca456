"""Queries against what the Parquet files themselves say, so that a cut the SQL shares can't hide."""

import re
from pathlib import Path

import pyarrow.parquet as pq

from quorumlake.plans import reference


def test_inventory_has_every_table_with_all_its_fields(spark, small):
    files = {p.stem: pq.ParquetFile(p) for p in Path(small).glob("*.parquet")}
    want = {n: (f.metadata.num_rows, len(f.schema_arrow.names)) for n, f in files.items()}
    got = {r.table_name: (r.row_count, r.field_count) for r in reference.schema_inventory(spark, small).collect()}
    assert got == want
    top = [(r.table_name, r.row_count) for r in reference.top_tables(spark, small).collect()]
    assert top == sorted(((n, rows) for n, (rows, _) in want.items()), key=lambda x: (-x[1], x[0]))[:3]


def test_fallback_join_keeps_every_part(spark, small):
    parts = pq.read_table(f"{small}/part.parquet").to_pylist()
    name = lambda r: re.sub("[^A-Z0-9]+", "_", f"{r['p_name']} {r['p_partkey'] % 50}".upper()).strip("_")
    moves = {}
    for r in sorted(parts, key=lambda r: r["p_partkey"]):
        moves.setdefault(name(r) + "_FAST" * (r["p_partkey"] % 3 == 0), (r["p_partkey"], r["p_brand"]))
    want = {r["p_partkey"]: moves.get(name(r)) or (r["p_size"] > 20 and moves.get(name(r) + "_FAST")) or (None, None) for r in parts}
    rows = reference.fallback_join(spark, small).collect()
    assert len(rows) == len(parts)
    assert {r.p_partkey: (r.partner, r.partner_brand) for r in rows} == want
    assert (None, None) in want.values()


def test_norm_name_join_finds_every_customer(spark, small):
    number = lambda text: text.rpartition("#")[2]
    customers, suppliers = (pq.read_table(f"{small}/{t}.parquet").to_pylist() for t in ("customer", "supplier"))
    by_number = {number(c["c_name"]): c["c_custkey"] for c in customers}
    want = {(s["s_suppkey"], by_number.get(number(s["s_name"])), "ENTITY_" + number(s["s_name"])) for s in suppliers}
    got = [(r.s_suppkey, r.c_custkey, r.k) for r in reference.norm_name_join(spark, small).collect()]
    assert len(by_number) == len(customers) and len(got) == len(suppliers)
    assert set(got) == want
