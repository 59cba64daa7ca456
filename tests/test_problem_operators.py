import json
import random
from collections import defaultdict
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorumlake.functions.clean import norm_id
from quorumlake.operators import drift, orphans, skew, snapshots, variants, versions

LOG = "entity_id string, attribute string, at bigint, old_value string, new_value string"


# ---- versions -----------------------------------------------------------------------------------


def brute_versions(rows):
    log = defaultdict(lambda: defaultdict(set))
    for e, a, t, o, n in rows:
        if e is not None and a is not None and t is not None:
            log[e, a][t].add((o, n))
    out = set()
    for key, instants in log.items():
        value, starts = None, []
        for i, t in enumerate(sorted(instants)):
            before, now = versions.in_force(sorted(instants[t], key=str))
            if i == 0:
                value = before
            if now != value:
                starts.append((t, now))
            value = now
        for i, (t, v) in enumerate(starts):
            out.add((*key, t, starts[i + 1][0] if i + 1 < len(starts) else None, v))
    return out


def test_in_force():
    assert versions.in_force([("1", "2"), ("2", "3")]) == ("1", "3")
    assert versions.in_force([("2", "3"), ("1", "2")]) == ("1", "3")
    assert versions.in_force([(None, "2")]) == (None, "2")
    assert versions.in_force([("1", "2"), ("2", "2")]) == ("1", "2")
    assert versions.in_force([("1", None), (None, "4")]) == ("1", "4")


def test_versions_by_rule(spark):
    rows = [
        ("e", "a", 10, "1", "2"), ("e", "a", 10, "1", "2"), ("e", "a", 20, "9", "2"), ("e", "a", 30, "2", None), ("e", "a", 40, None, None), ("e", "a", 50, "7", "3"),
        ("f", "a", 10, "x", "x"), ("f", "a", 20, "x", "y"), (None, "a", 1, "1", "2"), ("g", None, 1, "1", "2"), ("g", "a", None, "1", "2"),
    ]
    got = {tuple(r) for r in versions.build_versions(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {("e", "a", 10, 30, "2"), ("e", "a", 30, 50, None), ("e", "a", 50, None, "3"), ("f", "a", 20, None, "y")}


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_random_versions_over_many_ranges(spark, ranges):
    rnd = random.Random(ranges)
    rows = []
    for i in range(1500):  # one key holds most rows and so spans many ranges
        e = "hot" if i % 3 else f"e{rnd.randrange(30)}"
        rows.append((e, rnd.choice("ab"), rnd.randrange(600), rnd.choice(["1", "2", None]), rnd.choice(["1", "2", "3", None])))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in versions.build_versions(spark.createDataFrame(rows, LOG)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_versions(rows)


def test_several_logs_and_none(spark):
    a, b = spark.createDataFrame([("e", "a", 1, "0", "1")], LOG), spark.createDataFrame([("e", "a", 2, "1", "0")], LOG)
    assert versions.build_versions(a, b).count() == 2
    assert versions.build_versions(a.limit(0)).count() == 0


def test_versions_from_snapshots(spark):
    rows = [("x", 1, "red", 5), ("x", 2, "red", 6), ("x", 3, "blue", 6)]
    df = spark.createDataFrame(rows, "k string, t bigint, colour string, size int")
    log = versions.snapshots_as_log(df, F.col("k"), F.col("t"), {"colour": F.col("colour"), "size": F.col("size")})
    got = {tuple(r) for r in versions.build_versions(log).collect()}
    assert got == {("x", "colour", 1, 3, "red"), ("x", "colour", 3, None, "blue"), ("x", "size", 1, 2, "5"), ("x", "size", 2, None, "6")}


# ---- snapshots ----------------------------------------------------------------------------------


def changes(spark, rows, schema="k string, s int, l int, v string, record_key string"):
    df = spark.createDataFrame(rows, schema)
    last = snapshots.last_loaded(df, norm_id(df["k"]), df["s"], df["l"], {"v": df["v"]})
    return {tuple(r) for r in snapshots.snapshot_changes(last).collect()}


def test_snapshot_changes(spark):
    rows = [
        ("a", 1, 1, "x", "clash"), ("A ", 2, 1, "x", ""), ("b", 1, 1, "x", ""), ("b", 2, 1, "x", ""), ("b", 2, 5, "y", ""), ("b", 2, 5, "y", ""), ("c", 1, None, None, ""),
        ("d", 2, 1, None, ""), ("c", 3, 1, "back", ""), ("d", 3, 1, None, ""), (None, 3, 1, "x", ""), (" ", 3, 1, "x", ""),
    ]
    assert changes(spark, rows) == {(2, "b", "changed"), (2, "c", "removed"), (2, "d", "added"), (3, "a", "removed"), (3, "b", "removed"), (3, "c", "added")}
    assert changes(spark, rows[:1]) == set()
    assert changes(spark, [("a", 1, 1, "x", "")][:0]) == set()


def test_late_row_of_an_old_snapshot_counts_there(spark):
    assert changes(spark, [("a", 1, 1, "x", ""), ("a", 2, 1, "y", ""), ("a", 1, 9, "y", "")]) == set()


def test_keyed_diff(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "c", 5)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "a", 4), (2, None, 5), (4, "d", 1)], "k int, v string, n int")
    got = {tuple(r) for r in snapshots.keyed_diff(old, new, "k", ["v", "n"]).collect()}
    assert got == {("1", "n", None, "4"), ("2", "v", "b", None), ("4", "entity_created", None, "4")}
    assert snapshots.keyed_diff(new, new, "k", ["v", "n"]).count() == 0


# ---- orphans ------------------------------------------------------------------------------------

REF = "period int, record_key string, ref_period int, ref string"


def test_direct_orphans(spark):
    rows = [(2, "r1", 2, "here"), (2, "r2", 2, "old"), (2, "r3", 2, "new"), (2, "r4", 2, "never"), (2, "r5", 2, None), (2, "r2", 2, "old"), (3, "r2", 3, "old"), (2, "r6", 2, "both")]
    parents = [(2, "here"), (1, "old"), (3, "new"), (1, "both"), (3, "both"), (None, "never"), (2, None)]
    got = {(r.period, r.record_key, r.orphan_kind) for r in orphans.direct_orphans(spark.createDataFrame(rows, REF), spark.createDataFrame(parents, "period int, key string")).collect()}
    assert got == {(2, "r2", "deleted"), (3, "r2", "deleted"), (2, "r3", "late"), (2, "r4", "missing"), (2, "r6", "deleted")}
    none = spark.createDataFrame([], "period int, key string")
    assert {r.orphan_kind for r in orphans.direct_orphans(spark.createDataFrame(rows, REF), none).collect()} == {"missing"}
    assert orphans.direct_orphans(spark.createDataFrame([], REF), none).count() == 0


def test_cascade_reaches_a_fixpoint_on_a_cycle(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), REF)
    a = df((1, "a1", 1, "gone"), (1, "a2", 1, "root"))
    b = df((1, "b1", 1, "a1"), (1, "b2", 1, "a2"), (1, "b3", 1, "c1"))
    c = df((1, "c1", 1, "b1"), (1, "c2", 1, "b2"))
    keys = lambda *ks: spark.createDataFrame([(1, k) for k in ks], "period int, key string")
    refs = [orphans.Reference("a", "roots", a), orphans.Reference("b", "a", b.filter("ref <> 'c1'")), orphans.Reference("c", "b", c), orphans.Reference("b", "c", b.filter("ref = 'c1'"))]
    got = orphans.cascade(refs, {"roots": keys("root"), "a": keys("a1", "a2"), "b": keys("b1", "b2", "b3"), "c": keys("c1", "c2")})
    assert {(r.table_name, r.record_key, r.orphan_kind, r.depth) for r in got.collect()} == {
        ("a", "a1", "missing", 0), ("b", "b1", "inherited", 1), ("c", "c1", "inherited", 2), ("b", "b3", "inherited", 3),
    }


# ---- nested records -----------------------------------------------------------------------------


def rows_of(endpoint, doc):
    return {(k, p, c): (v, x) for k, v, p, c, x in variants.FILES[endpoint](doc)}


def test_states():
    s = variants.state_of
    assert [s(x) for x in (None, True, 1, "1", "3-5", "x", [1, 2], [1, "2"], [{}], [1], {"min": 1}, {"value": 3}, {"English": "a"}, {"a": [1]})] == [
        "null", "bool", "number", "number_text", "range_text", "text", "pair", "pair", "objects", "list", "bounds", "boxed", "labels", "object",
    ]


def test_every_way_of_writing_a_range():
    def bounds(**fields):
        got = rows_of("raidboss", {"currentList": {"t": [{"id": "x", **fields}]}})
        return {c: x for (k, p, c), (_, x) in got.items() if k == "boss_cp"}

    assert bounds(cpRange=[1, 2], cpRangeBoost=[3, 4]) == {"min": 1, "max": 2, "boosted_min": 3, "boosted_max": 4}
    assert bounds(cp_range={"min": 1, "max": None}, boostedCpRange="3-4") == {"min": 1, "boosted_min": "3", "boosted_max": "4"}
    assert bounds(cpRange=None) == bounds(cpRange=[]) == bounds(cpRange={}) == bounds() == {}


def test_names_weather_and_stats():
    got = rows_of("raidboss", {"currentList": {"t": [None, {"id": None, "names": {"English": "A", "German": None}}], "u": None}})
    assert set(got) == {("boss", "t", "1"), ("boss_name", "t/1", "English")}
    got = rows_of("types", [{"type": "F", "weatherBoost": {"names": "Fog", "assetName": "fog"}}, {"type": "G", "weatherBoost": None}, {"type": "H", "weatherBoost": {"names": {"French": "x"}}}])
    assert set(got) == {("weather_name", "F", "English"), ("weather_name", "H", "French")}
    got = rows_of("mega_pokemon", [{"stats": {"baseAttack": "12", "base_hp": {"value": 3}, "base_defense": None}}, {"stats": None}])
    assert {k: v[1] for k, v in got.items()} == {("mega_stat", "0", "base_attack"): "12", ("mega_stat", "0", "base_stamina"): 3}
    assert rows_of("raidboss", {"currentList": []}) == rows_of("raidboss", []) == rows_of("types", {}) == {}


def deep(n):
    return '{"a": ' * n + "1" + "}" * n


def test_deep_payloads_beside_good_ones(spark):
    """A payload nested thousands of levels deep parses; neither problem fails on it."""
    good = '{"currentList": {"t": [{"id": "a", "cpRange": [1, 2]}]}}'
    bad = f'{{"currentList": {{"t": [{{"id": {deep(3000)}, "names": {deep(3000)}, "cpRange": {deep(2500)}}}]}}}}'
    rows = [(1, "m", "raidboss", 1, good), (2, "m", "raidboss", 2, bad), (3, "m", "raidboss", 3, good), (4, "m", "x", 1, f'[{{"x": {deep(3000)}}}]'), (5, "m", "x", 2, '[{"y": 1}]')]
    files = spark.createDataFrame(rows, FILES)
    got = {(r.payload_id, r.child_kind, r.child_key) for r in variants.nested_tables(files).collect()}
    assert {(1, "boss_cp", "min"), (2, "boss", "0"), (3, "boss_cp", "max")} <= got
    changes = {(r.payload_id, r.field_path, r.change_kind) for r in drift.schema_changes(files).collect()}
    assert (2, "currentList.t.id", "retyped") in changes and (5, "x", "removed") in changes
    assert drift.unified_records(files, drift.name_versions(drift.schema_changes(files))).count() > 5


def test_json_text_of_any_depth():
    for v in ({"b": [1, {"c": None}, []], "a": "é\"", "d": {}}, [], "x", 1.5, [[["y"]]]):
        text = variants.json_text(v)
        real = json.dumps
        json.dumps = lambda x, **k: (_ for _ in ()).throw(RecursionError) if isinstance(x, (dict, list)) and x else real(x, **k)  # noqa: B023
        try:
            assert variants.json_text(v) == text
        finally:
            json.dumps = real


def test_subtypes_are_typed_tables_with_their_parents_keys(spark, tmp_path):
    doc = {"currentList": {"t": [{"id": "x", "cpRange": [1, 2], "cpRangeBoost": "3-4"}, {"id": "y", "names": {"English": "Y"}, "cp_range": {"min": 5}}]}}
    rows = variants.nested_tables(spark.createDataFrame([(1, "raidboss", json.dumps(doc))], "payload_id bigint, endpoint string, payload string"))
    tables = variants.subtype_tables(rows, f"{tmp_path}/t")
    assert set(tables) == {"boss_cpRange", "boss_cp_range_names", "boss_cp_pair", "boss_cp_range_text", "boss_cp_bounds", "boss_name_labels"}
    assert {tuple(r) for r in tables["boss_cp_range_text"].collect()} == {(1, "t/0", "boosted_min", 3), (1, "t/0", "boosted_max", 4)}
    assert dict(tables["boss_cp_pair"].dtypes)["value"] == "bigint" and dict(tables["boss_name_labels"].dtypes)["value"] == "string"
    assert {tuple(r) for r in variants.subtype(rows, "boss_cp", "boss_cp_bounds").collect()} == {(1, "t/1", "min", 5)}


def test_nested_tables_skip_what_does_not_parse(spark):
    deep = "[" * 200_000
    rows = [(1, "raidboss", '{"currentList": {"t": [{"id": "a"}]}}'), (2, "raidboss", '{"currentList": {"t": [{"id"'), (3, None, "[]"), (4, "mega_pokemon", None), (5, "types", ""), (6, "types", deep)]
    df = spark.createDataFrame(rows, "payload_id bigint, endpoint string, payload string").withColumn("child_kind", F.lit("clash"))
    assert [(r.payload_id, r.child_kind, r.parent_key, r.child_key) for r in variants.nested_tables(df).collect()] == [(1, "boss", "t", "0")]
    assert variants.nested_tables(df.limit(0)).count() == 0


def test_whole_table_equals_a_plain_walk(spark, small):
    """Every row again by a second way of reading: a plain walk over the parsed files."""
    from quorumlake.plans.problems import p6_found

    def number(v):
        return v["value"] if isinstance(v, dict) and "value" in v else v

    want = set()
    for r in spark.read.parquet(f"{small}/raw_payloads.parquet").collect():
        try:
            doc = json.loads(r.payload)
        except ValueError:
            continue
        add = lambda *x: want.add((r.payload_id, *x))  # noqa: B023, E731
        if r.endpoint == "raidboss" and isinstance(doc["currentList"], dict):
            for tier, bosses in doc["currentList"].items():
                for i, b in enumerate(bosses):
                    add("boss", tier, str(i))
                    for lang, name in (b.get("names") or {}).items():
                        if name is not None:
                            add("boss_name", f"{tier}/{i}", lang)
                    for fields, ends in ((("cpRange", "cp_range"), ("min", "max")), (("cpRangeBoost", "boostedCpRange"), ("boosted_min", "boosted_max"))):
                        v = next((b[f] for f in fields if b.get(f)), None)
                        v = v.split("-") if isinstance(v, str) else [v.get("min"), v.get("max")] if isinstance(v, dict) else v or [None, None]
                        for e, x in zip(ends, v):
                            if x is not None:
                                add("boss_cp", f"{tier}/{i}", e)
        elif r.endpoint == "types":
            for t in doc:
                names = (t.get("weatherBoost") or {}).get("names")
                for lang, name in ({"English": names} if isinstance(names, str) else names or {}).items():
                    if name is not None:
                        add("weather_name", t["type"], lang)
        elif r.endpoint == "mega_pokemon":
            for i, m in enumerate(doc):
                s = m.get("stats") or {}
                for stat, names in (("base_attack", ("base_attack", "baseAttack")), ("base_defense", ("base_defense",)), ("base_stamina", ("base_stamina", "base_hp"))):
                    if any(number(s.get(n)) is not None for n in names):
                        add("mega_stat", str(i), stat)
    got = [tuple(r) for r in p6_found(spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == want


# ---- drift --------------------------------------------------------------------------------------


def compared(endpoint, old, new):
    return set(drift.compare(drift.File(endpoint, old), drift.File(endpoint, new)))


def test_rename_needs_values_that_carry_over():
    old = [{"id": i, "power": i * 7, "gone": f"g{i}"} for i in range(9)]
    new = [{"id": i, "strength": i * 7, "fresh": i % 2 == 0} for i in range(9)]
    assert compared("x", old, new) == {("power", "renamed", "strength"), ("gone", "removed", ""), ("fresh", "added", "")}


def test_rename_with_changed_values_by_name_and_type():
    old, new = [{"id": 1, "cpRange": [1, 2]}], [{"id": 1, "cp_range": [3, 4]}]
    assert compared("x", old, new) == {("cpRange", "renamed", "cp_range")}


def test_retyped_and_what_lies_below():
    old = [{"id": 1, "s": {"a": 1, "b": {"c": 1}}, "n": None, "m": 1, "o": {"x": 1}}]
    new = [{"id": 1, "s": {"a": "1", "b": 5}, "n": {"q": 1}, "m": None, "o": None}]
    assert compared("x", old, new) == {("s.a", "retyped", ""), ("s.b", "retyped", "")}
    assert compared("x", [{"a": 1}, {"a": 1.5}], [{"a": 2}]) == set()


def test_tiers_and_data_maps():
    boss = lambda **x: {"id": "b", "names": {"English": "x"}, **x}
    old = {"currentList": {"t1": [boss(f=1)], "t2": [boss(f=1)], "t3": []}}
    new = {"currentList": {"t1": [boss(names={"French": "x"})], "t2": [], "t3": [boss(f=1)]}}
    assert compared("raidboss", old, new) == {("currentList.t1.f", "removed", "")}
    assert compared("raidboss", {"currentList": []}, new) == set()


def test_assignment_is_optimal():
    import itertools

    rnd = random.Random(3)
    for n, m in ((1, 1), (2, 3), (4, 2), (4, 4), (0, 3)):
        for _ in range(30):
            score = [[rnd.random() for _ in range(m)] for _ in range(n)]
            got = drift.assign(score)
            best = max((sum(score[i][j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), min(n, m)) for cols in itertools.permutations(range(m), min(n, m))), default=0)
            assert abs(sum(score[i][j] for i, j in got) - best) < 1e-9
            assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) == min(n, m)


FILES = "payload_id bigint, mirror string, endpoint string, snapshot int, payload string"


def test_schema_changes_of_deliveries(spark):
    j = json.dumps
    rows = [
        (1, "m", "x", 1, j([{"id": 1, "a": 1}])), (2, "m", "x", 2, "{broken"), (3, "m", "x", 3, j([{"id": 1, "b": 1}])), (4, "m", "x", 3, j([{"id": 1, "zzz": 9}])),
        (5, "m", "x", 4, j([])), (6, "m", "x", 5, j([{"id": 1, "b": "1"}])), (7, "other", "x", 4, j([{"id": 1}])), (8, "m", "y", 4, None), (9, None, "x", 9, j([{"id": 2}])),
    ]
    found = drift.schema_changes(spark.createDataFrame(rows, FILES))
    got = {(r.payload_id, r.field_path, r.change_kind, r.new_path) for r in found.collect()}
    assert got == {(3, "a", "renamed", "b"), (5, "id", "removed", ""), (5, "b", "removed", ""), (6, "id", "added", ""), (6, "b", "added", "")}
    assert drift.schema_changes(spark.createDataFrame([], FILES)).count() == 0


def unified(spark, rows):
    files = spark.createDataFrame(rows, FILES)
    out = drift.unified_records(files, drift.name_versions(drift.schema_changes(files))).collect()
    keys = [(r.payload_id, r.record_key, r.field) for r in out]
    assert len(keys) == len(set(keys))
    return out


def test_unified_records_use_one_name(spark):
    j = json.dumps
    rows = [(1, "m", "x", 1, j([{"id": i, "power": i * 7} for i in range(5)])), (2, "m", "x", 2, j([{"id": i, "strength": i * 7} for i in range(5)]))]
    out = unified(spark, rows)
    assert {r["field"] for r in out} == {"id", "power"} and len(out) == 20


def test_a_rename_holds_for_its_own_series_and_time(spark):
    j = json.dumps
    named = lambda **f: j([{"id": i, **{k: f"{v}{i}" for k, v in f.items()}} for i in range(6)])
    rows = [
        (1, "m", "x", 1, named(zlabel="a")), (2, "m", "x", 2, named(code="a")), (3, "m", "x", 3, named(code="a", zlabel="q")),  # the old name comes back for something else
        (4, "m", "types", 1, named(zlabel="b", code="c")), (5, "o", "x", 2, named(code="a")), (6, "m", "x", 2, "{"), (7, None, "x", 1, named(code="n")),
    ]
    got = {}
    for r in unified(spark, rows):
        got.setdefault(r.payload_id, set()).add((r.field, r.value and r.value[0]) if r.field != "id" else ("id", ""))
    assert got[1] == got[2] == {("id", ""), ("zlabel", "a")}
    assert got[3] == {("id", ""), ("zlabel", "a"), ("zlabel@3", "q")}
    assert got[4] == {("id", ""), ("zlabel", "b"), ("code", "c")}
    assert got[5] == {("id", ""), ("code", "a")} and got[7] == {("id", ""), ("code", "n")}


def test_a_swap_of_two_names(spark):
    j = json.dumps
    rows = [(1, "m", "x", 1, j([{"id": i, "a": f"p{i}", "c": i} for i in range(6)])), (2, "m", "x", 2, j([{"id": i, "b": f"p{i}", "c": i} for i in range(6)])), (3, "m", "x", 3, j([{"id": i, "a": i, "d": f"p{i}"} for i in range(6)]))]
    got = {(r.payload_id, r.field, r.value) for r in unified(spark, rows) if r.record_key == "1"}
    assert {x for x in got if x[0] == 3} == {(3, "id", "1"), (3, "a", "p1"), (3, "c", "1")}


def test_one_type_per_field_and_misfits(spark):
    rows = [(1, "m", "x", 1, json.dumps([{"n": 1, "s": "a"}, {"n": 2.5, "s": "b"}, {"n": " 3 ", "s": 4}, {"n": "many", "s": ["c"]}, {"n": None, "s": True}, {"n": 7, "s": "z"}]))]
    got = {(r.record_key, r.field): (r.json_type, r.unified_type, r.value, r.misfit) for r in unified(spark, rows)}
    assert got["0", "n"] == ("number", "number", "1", False) and got["2", "n"] == ("string", "number", "3", False) and got["3", "n"] == ("string", "number", None, True)
    assert got["4", "n"] == (None, "number", None, False)
    assert got["2", "s"] == ("number", "string", "4", False) and got["3", "s"] == ("array", "string", None, True) and got["4", "s"] == ("boolean", "string", "true", False)


def test_unified_table_against_a_plain_walk(spark, small):
    """The whole table: every record and field once, and the values the files have."""
    from quorumlake.plans.problems import p7_unified

    want = defaultdict(int)
    for r in spark.read.parquet(f"{small}/raw_payloads.parquet").collect():
        try:
            doc = json.loads(r.payload)
        except ValueError:
            continue
        groups = [(f"currentList.{t}/", bs) for t, bs in doc["currentList"].items()] if r.endpoint == "raidboss" and isinstance(doc.get("currentList"), dict) else [("", doc)] if isinstance(doc, list) else []
        for at, records in groups:
            for i, rec in enumerate(records or ()):
                stack = [rec]
                while stack:
                    for k, v in stack.pop().items():
                        if isinstance(v, dict) and k not in ("names", "counter", "counters"):
                            stack.append(v)
                        else:
                            want[r.payload_id, f"{at}{i}"] += 1
    rows = p7_unified(spark, small).collect()
    got = defaultdict(int)
    for r in rows:
        got[r.payload_id, r.record_key] += 1
    assert got == want and len({(r.payload_id, r.record_key, r.field) for r in rows}) == len(rows)
    types = defaultdict(set)
    for r in rows:
        types[r.endpoint, r.field].add(r.unified_type)
        assert r.misfit == (r.json_type is not None and r.value is None)
    assert all(len(t) == 1 for t in types.values())
    assert sum(r.misfit for r in rows) < 0.2 * len(rows)


@pytest.mark.parametrize("ranges", [1, 2, 30])
def test_changes_across_the_borders_of_ranges(spark, ranges):
    """One series holds most files and so spans many ranges; every file meets the one before it."""
    rows = [(s, "hot", "x", s, json.dumps([{"id": 1, f"f{s // 2}": s // 2}])) for s in range(40)] + [(100 + s, f"m{s}", "x", 1, "[]") for s in range(5)]
    want = {(s, f"f{s // 2 - 1}", "removed") for s in range(2, 40, 2)} | {(s, f"f{s // 2}", "added") for s in range(2, 40, 2)}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = drift.schema_changes(spark.createDataFrame(rows, FILES)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.payload_id, r.field_path, r.change_kind) for r in found} == want and len(found) == len(want)


# ---- skew helpers -------------------------------------------------------------------------------


def test_salted_rank_and_lag(spark):
    df = spark.range(2000).select((F.col("id") % 3 % 2).alias("k"), "id", (F.col("id") * 7).alias("v"))
    got = skew.salted_rank(df, ["k"], ["id"], "r", salts=7)
    for k in (0, 1):
        ranks = sorted(r.r for r in got.filter(F.col("k") == k).collect())
        assert ranks == list(range(len(ranks)))
    lagged = {(r.k, r.id): r.p for r in skew.lag_in_order(df, ["k"], ["id"], "v", "p").collect()}
    last = {}
    for i in range(2000):
        k = i % 3 % 2
        assert lagged[k, i] == last.get(k)
        last[k] = i * 7


@pytest.mark.parametrize("least", [1, 10, 1000])
def test_salted_join_kinds(spark, least):
    large = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99), (None, 98)], "k int, i int")
    small = spark.createDataFrame([(1, "one"), (3, "three")], "k int, n string")
    assert skew.salted_join(large, small, ["k"], F.col("i"), least=least).count() == 50
    assert skew.salted_join(large, small, ["k"], F.col("i"), "left", least).count() == 52
    assert skew.salted_join(large, small.select("k"), ["k"], F.col("i"), "left_semi", least).count() == 50
    assert skew.salted_join(large, small.select("k"), ["k"], F.col("i"), "left_anti", least).count() == 2
    assert skew.salted_join(large.limit(0), small, ["k"], F.col("i"), least=least).count() == 0


def test_only_heavy_keys_are_spread(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    heavy = skew.heavy_keys(df, ["k"], 100).collect()
    assert [r.k for r in heavy] == [0] and heavy[0]._n > 1  # a third of all rows under one key
    assert skew.heavy_keys(df, ["k"]) is None


def test_carry_forward(spark):
    rows = [(i % 2, i, f"v{i}" if i % 7 == 3 else None) for i in range(1000)]
    got = {(r.k, r.t): r.c for r in skew.carry_forward(spark.createDataFrame(rows, "k int, t int, v string"), ["k"], ["t"], "v", "c").collect()}
    last = {}
    for k, t, v in rows:
        last[k] = v or last.get(k)
        assert got[k, t] == last[k]


def test_range_merge_without_input():
    assert sum(b.num_rows for b in versions.merge_range(iter([]))) == 0
    empty = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())], names=list("rabcde"))
    assert sum(b.num_rows for b in versions.merge_range(versions.sorted_blocks(iter([empty])))) == 0


@pytest.mark.parametrize("runs", [1, 2, 40])
def test_merge_of_sorted_inputs_reads_them_in_order(runs):
    """Any number of sorted inputs come out as one, with one block of each open at a time."""
    rnd = random.Random(runs)
    rows = [(f"r{i % runs}", f"e{rnd.randrange(40)}", "a", rnd.randrange(50), None, str(i)) for i in range(4000)]
    ordered = sorted(rows, key=lambda r: r[:4])
    names, types = list("rabcde"), [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ordered[at : at + 700]), types)], names=names) for at in range(0, 4000, 700)]
    blocks = [r for b in versions.sorted_blocks(iter(batches)) for r in b.to_pylist()]
    assert len(blocks) >= runs and max(pa.ipc.open_stream(b["block"]).read_all().num_rows for b in blocks) <= versions.BLOCK_ROWS
    blocks.sort(key=lambda b: (b["entity_id"], b["attribute"], b["at"]))
    got = list(versions.merged(iter([pa.RecordBatch.from_pylist(blocks)])))
    assert [g[:3] for g in got] == sorted(r[1:4] for r in rows)
    assert sorted(g[4] for g in got) == sorted(r[5] for r in rows)


def test_found_queries_on_empty_tables(spark, small, tmp_path):
    from quorumlake.plans.problems import QUERIES

    for t in ("species", "forms", "moves", "raid_bosses", "community_days", "change_history", "raw_payloads"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, q in QUERIES.items():
        assert q(spark, str(tmp_path)).count() == 0, name


def test_period_is_the_day(spark):
    from quorumlake.functions.clean import period_of

    df = spark.createDataFrame([(datetime(2031, 2, 3, 6),)], "t timestamp_ntz")
    assert df.select(period_of(F.col("t")).alias("p")).first().p == "2031-02-03"
