import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import audit, joins, profiling
from quorumlake.sources import documents as D
from quorumlake.sources import registry, sinks, templates
from quorumlake.streaming import claims as S


def records(spark, *items):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "pos bigint, j string")
    return df.select("pos", F.parse_json("j").alias("record"))


LEDGER = "entity_id string, attribute string, source string, value_json string, priority int, seq bigint"


def test_replay_buckets(spark):
    led = spark.createDataFrame(
        [
            ("e", "a", "high", "118", 2, 0), ("e", "a", "low", "999", 6, 1), ("e", "b", "s", "1", 2, 2), ("e", "b", "s", "2", 2, 3), ("e", "types", "s", '"Fire"', 2, 4),
            ("e", "generation", "s", "3", 2, 5), ("e", "gap", "s", "1", 2, 6), ("x", "a", "s", "1", 2, 7), ("e", "a", "s", None, 1, 8),
        ],
        LEDGER,
    )
    stored = spark.createDataFrame([("e", "a", "118"), ("e", "b", "1"), ("e", "types", '["Fire","Ice"]'), ("e", "gen", "3"), ("e", "gap", "2")], "entity_id string, attribute string, value_json string")
    out = audit.replay(led, stored, F.col("entity_id") != "x", {"generation": "gen"})
    assert {r.seq: r.bucket for r in out.collect()} == {0: "matched", 1: "overridden", 2: "matched", 3: "collision", 4: "matched", 5: "matched", 6: "gap", 7: "unmapped"}
    report = {r.source: r.asDict() for r in audit.replay_report(out).collect()}
    assert report["s"] == {"source": "s", "matched": 3, "overridden": 0, "collision": 1, "gap": 1, "unmapped": 1}
    assert "| source |" in audit.markdown(list(report.values()), "Replay") and "(none)" in audit.markdown([], "x")


def test_coverage_tiers(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    fields = t([("name",), ("raw_id",), ("internal_debug_id",)], "path string")
    mapped = t([("name", "name"), ("raw_id", "source_id")], "path string, attribute string")
    got = audit.coverage_tiers(fields, mapped, t([("name",)], "attribute string"), t([("source_id",)], "attribute string"))
    assert {r.path: r.tier for r in got.collect()} == {"name": "CANONICAL", "raw_id": "CLAIMS_ONLY", "internal_debug_id": "MISSING"}
    strict = audit.coverage_tiers(fields, mapped, t([("name",)], "attribute string"), t([("source_id",)], "attribute string"), strict_names=True)
    assert {r.path: r.tier for r in strict.collect()}["raw_id"] == "CLAIMS_ONLY"
    assert {r.tier: r.n for r in audit.tier_counts(got).collect()} == {"CANONICAL": 1, "CLAIMS_ONLY": 1, "MISSING": 1}


def test_prefix_exclusion(spark):
    p = lambda *x: spark.createDataFrame([(i,) for i in x], "path string")
    assert {r.path for r in joins.not_beneath(p("a", "a.b", "ab", "c.d.e", "c"), p("a", "c.d")).collect()} == {"ab", "c"}


def test_shape():
    assert profiling.detect_shape({"currentList": {"lvl1": [{"a": 1}], "lvl2": [{"a": 1}]}, "graphics": {}}) == {"path": ["currentList"], "mode": "dict_of_lists", "n_records": 2}
    assert profiling.detect_shape({"pokemon": [{"a": 1}], "meta": {}, "x": 1}) == {"path": ["pokemon"], "mode": "top_level_list", "n_records": 1}
    assert profiling.detect_shape([1, 2]) is None and profiling.detect_shape(None) is None


def test_profile_and_template(spark):
    rows = [{"zid": f"z{i}", "grp": i % 2, "isFemale": i % 2 == 0, "form": "Female X" if i else "y", "cp": [i, i + 1], "n": {"English": "a"}, **({"late": 1} if i == 3 else {})} for i in range(4)]
    r = records(spark, *rows)
    catalog = {x.path: (x.n_present, x.types) for x in profiling.catalog_fields(r).collect()}
    assert catalog["zid"] == (4, ["string"]) and catalog["late"] == (1, ["number"]) and catalog["n.English"] == (4, ["string"])
    assert [x.path for x in profiling.rank_identities(r).orderBy("rank").collect()][:2] == ["zid", "form"]
    assert {tuple(x) for x in profiling.gender_signals(r).collect()} == {("boolean_field", "isFemale"), ("value_pattern", "form")}
    assert [x.path for x in profiling.range_pairs(profiling.catalog_fields(r)).collect()] == ["cp"]
    assert profiling.all_paths(r) == {"zid", "grp", "isFemale", "form", "cp", "n", "n.English", "late"}
    before = {"overrides": {"old": {"source_field": "vanished"}, "kept": {"source_field": "zid"}}, "entity_id_prefix": "own", "sub_records": [{"list_field": "x"}], "record_extraction": {"key_becomes_field": "tier"}}
    draft = profiling.draft_template(r, "src", "e", {"path": [], "mode": "top_level_list"}, before)
    assert draft["identity_field"] == "zid" and draft["overrides"] == before["overrides"] and len(draft["needs_review"]) == 1
    assert draft["entity_id_prefix"] == "own" and draft["record_extraction"]["key_becomes_field"] == "tier"
    assert draft["field_mappings"]["min_cp"] == {"source_field": "cp", "transform": "list_index", "index": 0}
    assert templates.template_from(draft).prefix == "own"
    assert draft["source_fingerprint"].startswith("sha256:") and len(draft["source_fingerprint"]) == 23


def test_late_field_is_found_unsampled(spark):
    df = spark.range(25_000).select("id", F.when(F.col("id") == 24_999, '{"a":1,"extra":{"x":[{"y":1}]}}').otherwise('{"a":1}').alias("j"))
    r = df.select(F.col("id").alias("pos"), F.parse_json("j").alias("record"))
    assert profiling.all_paths(r) == {"a", "extra", "extra.x", "extra.x.y"}
    assert {x.path for x in profiling.catalog_fields(r, 200).collect()} == {"a"}


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, "utf-8")


def test_documents(spark, tmp_path):
    write(tmp_path / "s/2026-01-01T000000Z/data.json", "[1]")
    write(tmp_path / "s/2026-02-01T000000Z/data.json", '[{"a": 1}]')
    write(tmp_path / "s/2026-02-01T000000Z/plain", "no json")
    assert D.latest_snapshot(tmp_path, "s") == "2026-02-01T000000Z" and D.latest_snapshot(tmp_path, "none") is None
    assert D.latest_snapshot(tmp_path, "s", exclude="2026-02-01T000000Z") == "2026-01-01T000000Z"
    assert [r.text for r in D.read_document(spark, tmp_path, "s", "data").collect()] == ['[{"a": 1}]']
    assert D.read_document(spark, tmp_path, "s", "missing").count() == D.read_document(spark, tmp_path, "t", "data").count() == 0
    raw = D.read_raw(spark, tmp_path / "s/2026-02-01T000000Z", "plain").first()
    assert raw.doc is None and raw.text == "no json" and D.read_raw(spark, tmp_path, "nothing").count() == 0
    first = D.folder_hash(spark, str(tmp_path / "s/2026-02-01T000000Z"))
    write(tmp_path / "s/2026-02-01T000000Z/.meta.json", "{}")
    assert D.folder_hash(spark, str(tmp_path / "s/2026-02-01T000000Z")) == first
    write(tmp_path / "s/2026-02-01T000000Z/plain", "other")
    assert D.folder_hash(spark, str(tmp_path / "s/2026-02-01T000000Z")) != first


def test_inferred_flat_and_heterogeneous(spark, tmp_path):
    write(tmp_path / "a.json", '[{"a": {"b": 1, "c": [1]}, "d": 2}]')
    df = D.read_json_inferred(spark, str(tmp_path / "a.json"))
    assert D.flattened(df).columns == ["a.b", "a.c", "d"]
    assert D.field_paths(df.schema)[0] == {"a", "a.b", "a.c", "d"}
    gm = [{"templateId": "T1", "data": {"stat": {"atk": 1, "in": {"x": "y"}}}}, {"templateId": "T2", "data": {"stat": {"atk": 2}, "note": 5}}, {"templateId": "T3"}, 7]
    docs = spark.createDataFrame([(json.dumps(gm),)], "t string").select(F.parse_json("t").alias("doc"))
    found = D.heterogeneous_records(docs)
    assert {(r.template_id, r.record_id) for r in found.collect()} == {("T1", "stat"), ("T2", "stat")}
    flat = D.records_of_kind(found, "stat")
    assert set(flat.columns) == {"template_id", "atk", "in.x"} and flat.count() == 2
    assert D.records_of_kind(found, "none").columns == ["template_id"]
    shim = spark.createDataFrame([('{"species": [{"a": 1}], "formMoves": [1, 2], "empty": [], "n": 1}',)], "t string").select(F.parse_json("t").alias("doc"))
    counts = {r.table_name: r.n for r in D.top_level_arrays(shim).groupBy("table_name").agg(F.count("record").alias("n")).collect()}
    assert counts == {"refjson_species": 1, "refjson_form_moves": 2, "refjson_empty": 0}


def test_registry(tmp_path):
    @registry.register("demo")
    class Demo(registry.Connector):
        def fetch(self, force=False):
            folder = self.new_snapshot(datetime(2026, 1, 2, 3, 4, 5))
            self.write_meta(folder, "tag-1")
            return folder

    c = registry.connector("demo")("demo", tmp_path)
    assert c.stored_etag() is None and c.fetch().name == "2026-01-02T030405Z" and c.stored_etag() == "tag-1"
    assert "demo" in registry.registered()
    with pytest.raises(KeyError):
        registry.connector("unknown")
    assert registry.is_unchanged({"ETag": "tag-1"}, "tag-1") and not registry.is_unchanged({"ETag": "tag-1"}, "tag-1", force=True)
    assert registry.remote_tag({"Last-Modified": "x"}) == "x" and not registry.is_unchanged({}, None)
    assert set(templates.enabled_sources({"sources": {"a": {}, "b": {"enabled": False}}})) == {"a"}


def test_changed_endpoints(spark):
    s = "source string, endpoint string, etag string"
    out = D.changed_endpoints(spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("a", "z", None)], s), spark.createDataFrame([("a", "x", "1"), ("a", "y", "1")], s))
    assert {r.endpoint for r in out.collect()} == {"y", "z"}


def test_export_and_history(spark, tmp_path):
    db, out = tmp_path / "db", tmp_path / "out"
    with pytest.raises(FileNotFoundError):
        sinks.export_parquet(spark, db, out)
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    sinks.write_tables({"t": df, "empty": df.limit(0), "_hidden": df}, db)
    write(out / "stale.parquet", "old")
    assert sinks.export_parquet(spark, db, out) == {"empty": 0, "t": 1}
    assert sorted(p.name for p in out.glob("*.parquet")) == ["empty.parquet", "t.parquet"]
    change = spark.createDataFrame([("k", "a", "1", "2")], "record_key string, attribute string, old_value string, new_value string")
    for _ in range(2):
        sinks.append_history(change, "moves", "engine", tmp_path / "h", "2026-01-01T00:00:00")
    assert [r.entity_id for r in spark.read.parquet(str(tmp_path / "h")).collect()] == ["moves:k"] * 2


def test_custom_tables_and_inventory(spark):
    inv = sinks.schema_inventory({"big": spark.range(5), "small": spark.range(1)})
    assert [r.table_name for r in inv.collect()] == ["big", "small"]
    ok, inv = sinks.register_custom_table(spark, "ql_test", [{"id": "a", "v": "1"}, {"id": "b", "v": "2"}], inventory=inv)
    assert ok and spark.table("ql_test").count() == 2 and inv.filter("table_name = 'ql_test'").first().row_count == 2
    assert sinks.register_custom_table(spark, "ql_sql", "SELECT count(*) AS n FROM ql_test")[0] and spark.table("ql_sql").first().n == 2
    assert sinks.register_custom_table(spark, "bad", 5) == (False, None)
    for name in ("", None, " "):
        with pytest.raises(ValueError):
            sinks.register_custom_table(spark, name, [])
    assert sinks.largest_tables(inv, 1).first().fields == ["id"]
    assert {r.source for r in sinks.meta_rows(spark, {"a": "t"}).collect()} == {"a", "__build__"}


def test_declared_schema_and_submissions(spark, tmp_path):
    df = spark.createDataFrame([("1", "x")], "level string, other string")
    assert sinks.conform(df, "level double, cp double").first().asDict() == {"level": 1.0, "cp": None}
    write(tmp_path / "c.csv", 'entity,field,value\ne1,name,"a, b"\n,name,x\n')
    rows = sinks.submissions_as_claims(D.read_csv(spark, str(tmp_path / "c.csv"))).collect()
    assert [tuple(r) for r in rows] == [("e1", "name", "a, b", "confirmed_owner_submission")]
    assert sinks.dump_claims(spark.createDataFrame(rows), tmp_path, "s", "t").endswith("s/t/claims.jsonl")


def test_stream_folds_to_what_a_batch_gives(spark, tmp_path):
    schema = S.CLAIM_STREAM_SCHEMA
    at = datetime(2026, 1, 1)
    parts = [
        [("e", "a", "low", "1", 6, 1, at), ("e", "b", "x", "9", 3, 2, at)],
        [("e", "a", "high", "2", 2, 3, at), ("e", "a", "low", "1", 6, 1, at), ("e", "b", "x", None, 1, 4, at)],
    ]
    store = str(tmp_path / "store")
    versions = []

    def read():
        return spark.read.parquet(versions[-1]) if versions else None

    def save(df):
        path = f"{store}/{len(versions)}"
        df.write.parquet(path)
        versions.append(path)

    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = S.start(S.claim_stream(spark, str(tmp_path / "in")), S.fold_into(read, save), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert not q.isActive, i
        time.sleep(0.1)
    got = {(r.attribute, r.value_json, r.source) for r in read().collect()}
    assert got == {("a", "2", "high"), ("b", "9", "x")}
    rates = S.claim_rates(spark.createDataFrame(parts[0], schema))
    assert {(r.source, r.n) for r in rates.collect()} == {("low", 1), ("x", 1)}


def test_core_does_not_import_the_text_subpackage():
    import pathlib

    import quorumlake

    root = pathlib.Path(quorumlake.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quorumlake.llm" not in p.read_text("utf-8"), p


def test_coverage_report_and_method_mismatch(spark):
    r = records(spark, {"name": "a", "id": 1, "debug": {"x": 1}}, {"name": "b", "id": 2})
    t = templates.template_from({"source_key": "s", "endpoint": "e", "field_mappings": {"title": {"source_field": "name"}, "n": {"source_field": "id"}}})
    a = lambda *x: spark.createDataFrame([(i,) for i in x], "attribute string")
    (row,) = audit.coverage_report({"s/e": (r, t)}, a("title"), a("n"))
    assert row == {"endpoint": "s/e", "canonical": 1, "claims_only": 1, "missing": 2, "missing_fields": "debug, debug.x"}
    assert audit.method_mismatch({"a", "a.b", "c", "m.x.y", "m"}, {"a", "m"}, {"m"}) == ["a.b", "c"]


def test_profile_of_a_whole_source(spark, tmp_path):
    write(tmp_path / "s/2026-01-01T000000Z/one.json", '[{"k": 1, "v": "x"}, {"k": 2, "v": "x"}]')
    write(tmp_path / "s/2026-01-01T000000Z/two.json", '{"list": {"a": [{"k": 1}], "b": [{"k": 2}]}}')
    write(tmp_path / "s/2026-01-01T000000Z/none.json", "[1, 2]")
    write(tmp_path / "s/2026-01-01T000000Z/broken.json", "[")
    drafts = profiling.profile_source(spark, tmp_path, "s", {"one": {"identity_field": "v"}})
    assert set(drafts) == {"one", "two"} and drafts["one"]["identity_field"] == "v" and drafts["two"]["identity_field"] == "k"
    assert drafts["two"]["record_extraction"] == {"unwrap_path": ["list"], "iterate_mode": "dict_of_lists"}
    assert profiling.profile_source(spark, tmp_path, "unknown") == {}


def test_paths_where_records_disagree_on_a_type(spark):
    """A field that is a number here and an object there: the walk has what lies below, the schema doesn't."""
    from quorumlake.operators import audit, profiling

    df = spark.createDataFrame([('{"a": 1, "b": [{"c": {"d": 1}}]}',), ('{"a": {"x": {"y": 2}}, "e": "t"}',)], "j string").select(F.parse_json("j").alias("record"))
    walked = profiling.all_paths(df)
    assert walked == {"a", "a.x", "a.x.y", "b", "b.c", "b.c.d", "e"}
    paths, dynamic = profiling.schema_paths(df)
    assert paths == {"a", "b", "b.c", "b.c.d", "e"} and dynamic == {"a"}
    assert audit.method_mismatch(walked, paths, dynamic) == [] and audit.method_mismatch(walked, paths, set()) == ["a.x", "a.x.y"]
    assert profiling.all_paths(df.limit(0)) == set()
