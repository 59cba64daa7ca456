"""Versions from snapshots: a record that is absent has none."""

from collections import defaultdict
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quorumlake.operators import versions
from quorumlake.plans import problems

EPOCH = datetime(1970, 1, 1)
ROWS = [
    ("stays", 1, "a"), ("stays", 2, "a"), ("stays", 3, "a"), ("stays", 4, "b"),
    ("removed", 1, "a"), ("removed", 2, "a"),
    ("returns", 1, "a"), ("returns", 3, "a"), ("returns", 4, "a"),
    ("nulls", 1, "a"), ("nulls", 2, None), ("nulls", 4, None),
    ("late", 3, None), ("late", 4, ""), (None, 4, "a"), ("stays", None, "c"),
]


@pytest.mark.parametrize("ranges", [1, 12])
def test_removed_and_returning_records(spark, ranges):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(ROWS, "k string, t bigint, v string")
        log = versions.snapshots_as_log(df, F.col("k"), F.col("t"), {"v": F.col("v")})
        got = sorted((r.entity_id, r.valid_from, r.valid_to, r.value) for r in versions.build_versions(log).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [
        ("late", 3, 4, None), ("late", 4, None, ""), ("nulls", 1, 2, "a"), ("nulls", 2, 3, None), ("nulls", 4, None, None), ("removed", 1, 3, "a"),
        ("returns", 1, 2, "a"), ("returns", 3, None, "a"), ("stays", 1, 4, "a"), ("stays", 4, None, "b"),
    ]


def test_an_update_log_beside_snapshots(spark):
    log = spark.createDataFrame([("x", "v", 2, "a", "b"), ("y", "v", 1, None, "=")], "entity_id string, attribute string, at bigint, old_value string, new_value string")
    snaps = spark.createDataFrame([("x", 1, "a"), ("z", 3, "c")], "k string, t bigint, v string")
    both = versions.build_versions(log, versions.snapshots_as_log(snaps, F.col("k"), F.col("t"), {"v": F.col("v")}))
    got = {(r.entity_id, r.valid_from, r.valid_to, r.value) for r in both.collect()}
    assert got == {("x", 1, 2, "a"), ("x", 2, 3, "b"), ("y", 1, None, "="), ("z", 3, None, "c")}


def test_query_holds_where_the_records_are(spark, small):
    held = defaultdict(list)
    for r in problems.p1_snapshot_history(spark, small).collect():
        held[r.entity_id, r.attribute].append((r.valid_from_s, r.valid_to_s, r.value))
    want_keys = set()
    for name, key in (("species", "slug"), ("forms", "slug"), ("moves", "move_id")):
        t = pq.read_table(f"{small}/{name}.parquet")
        rows = [r for r in t.to_pylist() if r[key] is not None and str(r[key]).strip() and r["snapshot_ts"] is not None]
        at = lambda r: int(r["snapshot_ts"].timestamp() if r["snapshot_ts"].tzinfo else (r["snapshot_ts"] - EPOCH).total_seconds())
        deliveries, last = sorted({at(r) for r in rows}), defaultdict(list)
        for r in rows:
            last[f"{name}:{str(r[key]).strip().lower()}", at(r)].append(r)
        attributes = [c for c in t.schema.names if c not in (key, "snapshot_ts", "loaded_at")]
        for entity in {e for e, _ in last}:
            for a in attributes:
                want_keys.add((entity, a))
                for s in deliveries:
                    now = [v for f, to, v in held[entity, a] if f <= s and (to == -1 or s < to)]
                    assert len(now) == ((entity, s) in last), (entity, a, s)
                    if now and str(t.schema.field(a).type) in ("int32", "int64", "bool"):
                        latest = max(r["loaded_at"] for r in last[entity, s])
                        values = {r[a] for r in last[entity, s] if r["loaded_at"] == latest}
                        assert now[0] in {None if v is None else str(v).lower() for v in values}, (entity, a, s)
    assert {k for k, v in held.items() if v} == want_keys
