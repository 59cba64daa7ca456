import json

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import variant as V
from quorumlake.operators import claims, extract, resolve
from quorumlake.plans import domains
from quorumlake.sources.templates import template_from


def documents(spark, *payloads):
    df = spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p),) for p in payloads], "text string")
    return df.select(F.try_parse_json("text").alias("doc"), "text")


def template(mode="top_level_list", **how):
    extra = {k: how.pop(k) for k in ("identity_field", "entity_id_prefix", "field_mappings", "overrides", "gender_signals", "sub_records") if k in how}
    return template_from({"source_key": "src", "endpoint": "data", "record_extraction": {"iterate_mode": mode, **how}, **extra})


def records(spark, payload, t):
    out = extract.unwrap(documents(spark, payload), t).orderBy("pos").select(F.to_json("record").alias("r")).collect()
    return [json.loads(x.r) for x in out]


def test_modes(spark):
    assert records(spark, [{"a": 1}, 5, None, {"a": 2}], template()) == [{"a": 1}, {"a": 2}]
    assert records(spark, {"x": {"y": [{"a": 1}]}}, template(unwrap_path=["x", "y"])) == [{"a": 1}]
    assert records(spark, {"x": 1}, template(unwrap_path=["x", "y"])) == []
    tiers = {"list": {"z": [{"id": 1, "tier": "old"}, 3], "a": [{"id": 2}], "no": 5}}
    t = template("dict_of_lists", unwrap_path=["list"], key_becomes_field="tier")
    assert records(spark, tiers, t) == [{"id": 1, "tier": "z"}, {"id": 2, "tier": "a"}]  # in the order of the file
    gm = [{"templateId": "T1", "data": {"s": {"p": 1}}}, {"templateId": "T2", "data": {"s": {}}}, {"templateId": "T3"}]
    t = template("list_of_dicts_with_subkey", unwrap_path=["data", "s"], key_becomes_field="templateId")
    assert records(spark, gm, t) == [{"p": 1, "templateId": "T1"}]
    assert records(spark, {"a": 1}, template("single_object")) == [{"a": 1}]
    t = template("dict_of_scalars", dict_key_field="token", dict_value_field="name")
    assert records(spark, {"b": "x", "a": ""}, t) == [{"token": "b", "name": "x"}, {"token": "a", "name": ""}]
    for broken in ("{", "null", "[]", "{}"):
        assert records(spark, broken, template()) == []


def test_unknown_mode():
    with pytest.raises(ValueError):
        template("sideways")


def claim_rows(df):
    return {(r.entity_id, r.attribute): json.loads(r.value_json) for r in df.collect()}


def test_claims_overrides_and_prefix(spark):
    payload = [{"id": 1, "name": "Nudge", "power": 40}, {"id": 2, "name": "Spark Jab", "power": None}, {"id": None, "name": "x"}]
    mapped = {"name": {"source_field": "name"}, "power": {"source_field": "power"}}
    t = template(identity_field="id", field_mappings=mapped)
    found = claims.record_claims(extract.unwrap(documents(spark, payload), t), t)
    assert claim_rows(found) == {("src_1", "name"): "Nudge", ("src_1", "power"): 40, ("src_2", "name"): "Spark Jab"}
    assert {r.priority for r in found.collect()} == {99}
    t = template(identity_field="id", field_mappings=mapped, overrides={"power": {"source_field": "name"}}, entity_id_prefix="own")
    assert claim_rows(claims.record_claims(extract.unwrap(documents(spark, payload), t), t))[("own_1", "power")] == "Nudge"


def test_sub_records_collapse_to_one_variant(spark):
    payload = [
        {"id": 712, "name": "Glimmer Eel", "regionForms": {"GLIMMER_EEL_FEMALE": {"names": {"English": "Glimmer Eel Female"}}},
         "assetForms": [{"form": "FEMALE", "isFemale": False}, {"form": None, "isFemale": False}]},
        {"id": 1, "name": "Other", "assetForms": [{"form": "STRAW_CROWN", "isFemale": False}]},
    ]
    t = template(
        identity_field="id", entity_id_prefix="dex", field_mappings={"name": {"source_field": "name"}},
        sub_records=[
            {"list_field": "regionForms", "container_type": "dict", "field_mappings": {"form_name": {"source_field": "names.English", "transform": "nested_path"}},
             "gender_signals": [{"signal_type": "key_pattern", "key_pattern": "(?i)_female$", "value": "female"}]},
            {"list_field": "assetForms", "field_mappings": {"form_name": {"source_field": "form"}},
             "gender_signals": [{"signal_type": "boolean_field", "source_field": "isFemale"}, {"signal_type": "value_pattern", "source_field": "form", "pattern": "(?i)female", "value": "female"}]},
        ],
    )
    found = claims.record_claims(extract.unwrap(documents(spark, payload), t), t)
    forms = {e for e, _ in claim_rows(found) if "_form_" in e}
    assert forms == {"dex_712_form_female", "dex_1_form_straw-crown"}
    won = {(r.entity_id, r.attribute): json.loads(r.value_json) for r in resolve.resolve(found).collect()}
    assert won["dex_712_form_female", "form_name"] == "Glimmer Eel Female"  # the earlier sub_records entry wins
    assert won["dex_712_form_female", "dex_number"] == 712
    assert won["dex_1_form_straw-crown", "gender"] == "unknown"


def ledger(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, attribute string, source string, value_json string, priority int, seq bigint")


def test_resolution(spark):
    led = ledger(
        spark,
        [
            ("e", "a", "low", "999", 6, 0), ("e", "a", "high", "118", 2, 1), ("e", "b", "x", "1", 3, 2), ("e", "b", "y", "2", 3, 3),
            ("e", "c", "x", None, 1, 4), ("e", "c", "y", "5", 9, 5), ("e", "d", "x", "7", 1, 6), ("e", "d", "x", "7", 1, 7), ("n", "c", "x", None, 1, 8),
        ],
    )
    got = {(r.entity_id, r.attribute): (r.value_json, r.winning_source, r.n_claims, r.n_distinct) for r in resolve.resolve(led).collect()}
    assert got == {("e", "a"): ("118", "high", 2, 2), ("e", "b"): ("1", "x", 2, 2), ("e", "c"): ("5", "y", 1, 1), ("e", "d"): ("7", "x", 2, 1)}
    torn = {r.attribute: ([tuple(c) for c in r.claims], r.kind) for r in resolve.discrepancies(led).collect()}
    assert torn == {"a": ([("low", "999"), ("high", "118")], "cross_source"), "b": ([("x", "1"), ("y", "2")], "cross_source")}
    assert resolve.resolve(led.limit(0)).count() == 0


def test_random_ledgers_equal_brute_force(spark):
    import random

    rnd = random.Random(7)
    rows = [(f"e{rnd.randrange(5)}", f"a{rnd.randrange(3)}", f"s{rnd.randrange(4)}", rnd.choice(["1", "2", "3", None]), rnd.randrange(1, 4), i) for i in range(400)]
    best, values = {}, {}
    for e, a, s, v, p, q in rows:
        if v is not None:
            values.setdefault((e, a), set()).add(v)
            best[e, a] = min(best.get((e, a), (p, q, v, s)), (p, q, v, s))
    got = {(r.entity_id, r.attribute): (r.value_json, r.winning_source, r.n_distinct) for r in resolve.resolve(ledger(spark, rows)).collect()}
    assert got == {k: (b[2], b[3], len(values[k])) for k, b in best.items()}


def test_last_wins_keeps_the_first_place(spark):
    led = ledger(spark, [("e", "a", "s", "1", 2, 5), ("e", "a", "s", "2", 2, 9), ("e", "a", "t", "3", 2, 7)])
    assert {(r.source, r.value_json, r.seq) for r in claims.last_wins(led).collect()} == {("s", "2", 5), ("t", "3", 7)}


def test_claim_filters(spark):
    led = ledger(spark, [("pokemon_dex_pm007", "d", "s", '""', 1, 0), ("pokemon_dex_pm1.f", "d", "s", '"x"', 1, 1), ("pokemon_dex_pm12", "d", "s", '"2018/03/25"', 1, 2)])
    assert [r.entity_id for r in claims.truthy_claims(led).orderBy("seq").collect()] == ["pokemon_dex_pm1.f", "pokemon_dex_pm12"]
    assert {r.entity_id for r in claims.renamed_entities(led, r"pokemon_dex_pm(\d+)", "dex_").collect()} == {"dex_7", "dex_12"}


def test_upsert_overwrites_only_what_is_resolved(spark):
    rows = spark.createDataFrame([("e", 1, "keep"), ("f", 2, "own")], "id string, power int, extra string")
    won = ledger(spark, [("e", "strength", "s", "7", 1, 0), ("e", "other", "s", '"x"', 1, 1)])
    out = resolve.upsert(rows, "id", won, {"power": ("strength", "int")})
    assert {tuple(r) for r in out.collect()} == {("e", 7, "keep"), ("f", 2, "own")}
    assert out.columns == rows.columns


def test_other_shapes(spark):
    doc = documents(spark, {"Fire": {"Grass": 1.6, "Rock": 0.6}})
    assert {tuple(r) for r in domains.type_table(doc).collect()} == {("Fire", "Grass", 1.6), ("Fire", "Rock", 0.6)}
    assert [tuple(r) for r in domains.weather_table(documents(spark, {"Fog": ["Dark", "Ghost"]})).collect()] == [("Fog", ["Dark", "Ghost"])]
    one = extract.unwrap(documents(spark, {"cpMultiplier": [0.1, 0.2]}), template("single_object"))
    assert [tuple(r) for r in domains.progression_table(one).collect()] == [(1.0, 0.1), (2.0, 0.2)]
    keyed, listed = {"103": {"id": 103, "name": "Exo"}, "7": {"name": "Squ"}}, [{"id": 103, "name": "Exo"}]
    assert {tuple(r) for r in domains.marked_species(documents(spark, keyed), "nesting_species").collect()} == {(103, "Exo", None), (7, "Squ", None)}
    assert [tuple(r) for r in domains.marked_species(documents(spark, listed), "nesting_species").collect()] == [(103, "Exo", None)]
    text = spark.createDataFrame([('{"templateId": "T", "zeta": 1, "alpha": 2}',), ('{"templateId": "U"}',)], "t string")
    assert {(r.template_id, r.record_type) for r in extract.passthrough(text, "t").collect()} == {("T", "zeta"), ("U", None)}


def test_moves_by_name_or_fast_name(spark):
    move = "move_id bigint, name string, type string, power int, duration int, energy_delta int"
    fast = spark.createDataFrame([(301, "Nudge", "normal", 5, 500, 5), (302, "Spark Jab", "fire", 10, 1000, 10)], move)
    charged = spark.createDataFrame([(999, "Tidal Burst", "water", 130, 3300, -100), (998, "Odd", "water", 1, 1, -1)], move)
    pvp = spark.createDataFrame(
        [("NUDGE", 3, 0, 1, None, 0), ("SPARK_JAB_FAST", 4, 6, 2, None, 1), ("TIDAL_BURST", 80, 75, None, '{"b":1}', 2), ("ODD_FAST", 9, 9, 9, None, 3)],
        "moveId string, power int, energy int, turns int, buffs string, seq int",
    )
    got = {r.move_id: (r.pvp_power, r.pvp_energy_cost, r.pvp_cooldown_turns, r.stat_buffs) for r in domains.moves_table(fast, charged, pvp).collect()}
    assert got == {"move_301": (3, 0, 1, None), "move_302": (4, 6, 2, None), "move_999": (80, 75, None, '{"b":1}'), "move_998": (None, None, None, None)}


def test_species_and_forms(spark):
    drafts = spark.createDataFrame([("1", "Alpha", "10"), ("2", "Beta", None)], "dex_number string, name string, base_attack string")
    led = ledger(
        spark,
        [
            ("pokemon_dex_1", "base_attack", "s", "118", 2, 0), ("pokemon_dex_1", "primary_type_raw", "s", '"POKEMON_TYPE_FIRE"', 2, 1),
            ("pokemon_dex_1_form_hat", "dex_number", "s", "1", 2, 2), ("pokemon_dex_1_form_hat", "costume_name", "s", '"HAT"', 2, 3),
        ],
    )
    won = resolve.resolve(led)
    species = domains.species_table(drafts, won)
    rows = {r.dex_number: r for r in species.collect()}
    assert (rows[1].base_attack, rows[1].slug, rows[1].types, rows[2].base_attack, rows[2].types) == (118, "1-alpha", ["Fire"], None, None)
    curated = spark.createDataFrame([("HAT", "A hat")], "token string, display_name string")
    forms = {r.slug: r for r in domains.forms_table(won, species, curated).collect()}
    assert set(forms) == {"1-alpha-standard", "2-beta-standard", "pokemon_dex_1_form_hat"}
    assert (forms["pokemon_dex_1_form_hat"].base_attack, forms["pokemon_dex_1_form_hat"].costume_display_name, forms["pokemon_dex_1_form_hat"].gender) == (118, "A hat", "unknown")


def test_variant_kinds(spark):
    rows = [("null", "null"), ("1", "number"), ("1.5", "number"), ("true", "boolean"), ('"x"', "string"), ("[1]", "array"), ('{"a":1}', "object"), ("{}", "object")]
    df = spark.createDataFrame(rows, "j string, want string").withColumn("got", V.kind(F.parse_json("j")))
    assert df.filter("got <> want").count() == 0


def test_documents_of_any_size_keep_their_order(spark):
    """A document of 100,000 keys: no place runs into another, and the order is the document's."""
    n = 100_000
    payload = {f"k{i}": [{"id": i, "name": "x"}] for i in range(n)} | {"last": [{"id": j} for j in range(3)]}
    t = template("dict_of_lists", identity_field="id", field_mappings={"name": {"source_field": "name"}, "id": {"source_field": "id"}})
    found = claims.record_claims(extract.unwrap(documents(spark, payload), t), t).filter("attribute = 'id'")
    rows = found.orderBy("seq").select(F.col("value_json").cast("int").alias("v")).collect()
    assert [r.v for r in rows] == [*range(n), 0, 1, 2]


def test_members_beyond_ten_thousand_come_after_the_record(spark):
    """Sub-records keep their order among themselves and stay before the next record, however many they are."""
    payload = [{"id": 1, "own": "a", "forms": [{"form": f"f{i}"} for i in range(10_050)], "more": [{"form": "f3"}]}, {"id": 2, "own": "b", "forms": []}]
    sub = {"field_mappings": {"form_name": {"source_field": "form"}}}
    t = template(identity_field="id", entity_id_prefix="d", field_mappings={"own": {"source_field": "own"}}, sub_records=[{"list_field": "forms", **sub}, {"list_field": "more", **sub}])
    rows = claims.record_claims(extract.unwrap(documents(spark, payload), t), t).collect()
    assert len({r.seq for r in rows}) == len(rows)
    names = [r.value_json for r in sorted(rows, key=lambda r: r.seq) if r.attribute in ("own", "form_name")]
    assert names == ['"a"', *[f'"F{i}"' for i in range(10_050)], '"F3"', '"b"']
