import json

from quorumlake.__main__ import main
from quorumlake.plans import domains
from quorumlake.plans.build import build
from quorumlake.sources import sinks
from quorumlake.sources.templates import load_templates

TEMPLATE = {
    "source_key": "pokeapi", "endpoint": "moves", "record_extraction": {"iterate_mode": "top_level_list"}, "identity_field": "id", "entity_id_prefix": "move",
    "field_mappings": {"name": {"source_field": "name"}, "power": {"source_field": "power"}},
}


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data), "utf-8")


def prepare(tmp_path):
    write(tmp_path / "t/a.yml", TEMPLATE)
    write(tmp_path / "t/b.yml", TEMPLATE | {"source_key": "pvpoke"})
    write(tmp_path / "raw/pokeapi/2026-01-01T000000Z/moves.json", [{"id": 1, "name": "Nudge", "power": 40}, {"id": 2, "name": "Spark Jab", "power": 1}, {"id": 2, "name": "Spark Jab", "power": 2}])
    write(tmp_path / "raw/pvpoke/2026-01-01T000000Z/moves.json", [{"id": 1, "name": "Nudge", "power": 35}])
    return domains.Source(tmp_path / "raw", load_templates(tmp_path / "t"))


def test_build_twice_changes_nothing(spark, tmp_path):
    source = prepare(tmp_path)
    keys = sorted(source.templates)
    assert keys == ["pokeapi/moves", "pvpoke/moves"]

    def moves():
        return sinks.conform(source.rows(spark, "pokeapi/moves").withColumnRenamed("power", "pve_power").selectExpr("name as move_id", "name", "pve_power").dropDuplicates(["move_id"]), domains.SCHEMAS["moves"])

    db = tmp_path / "db"
    counts = build(spark, source, keys, db, {"moves": moves()}, tmp_path / "out")
    assert counts["resolved"] == 4 and counts["discrepancies"] == 1 and counts["_claims_ledger"] == 6
    won = {(r.entity_id, r.attribute): json.loads(r.value_json) for r in spark.read.parquet(str(db / "resolved.parquet")).collect()}
    assert won["move_1", "power"] == 35 and won["move_2", "power"] == 2  # better trust, and the last word of one source
    build(spark, source, keys, db, {"moves": moves()})
    assert spark.read.parquet(str(db / "change_history.parquet")).count() == 0
    assert sorted(p.name for p in (tmp_path / "out").glob("*")) == ["discrepancies.parquet", "moves.parquet", "resolved.parquet"]
    write(tmp_path / "raw/pokeapi/2026-02-01T000000Z/moves.json", [{"id": 1, "name": "Nudge", "power": 41}, {"id": 3, "name": "Cut", "power": 9}])
    build(spark, source, keys, db, {"moves": moves()})
    changes = {(r.entity_id, r.attribute, r.old_value, r.new_value) for r in spark.read.parquet(str(db / "change_history.parquet")).collect()}
    assert changes == {("moves:Nudge", "pve_power", "40", "41"), ("moves:Cut", "entity_created", None, "Cut")}


def test_template_table_and_command_line(spark, tmp_path, capsys):
    from pyspark.sql import functions as F

    source = prepare(tmp_path)
    t = domains.template_table(spark, source, "pokeapi/moves", "name string, power int, shiny boolean", {"shiny": F.lit(False)})
    assert {tuple(r) for r in t.collect()} == {("Nudge", 40, False), ("Spark Jab", 1, False), ("Spark Jab", 2, False)}
    assert main(["build", "--root", str(tmp_path / "raw"), "--templates", str(tmp_path / "t"), "--database", str(tmp_path / "db")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["resolved"] == 4
    assert main(["profile", "--root", str(tmp_path / "raw"), "--source", "pokeapi", "--endpoint", "moves"]) == 0
    assert json.loads(capsys.readouterr().out)["field_mappings"]["power"] == {"source_field": "power", "transform": "direct"}
    assert main(["profile", "--root", str(tmp_path / "raw"), "--source", "pokeapi", "--endpoint", "none"]) == 1
    assert main(["sql", "--database", str(tmp_path / "db"), "select count(*) as n from resolved"]) == 0
    assert "4" in capsys.readouterr().out


def test_leagues(spark):
    rows = [("pvp_league_Great League", "cp_limit", "1500"), ("pvp_league_Great League", "meta", '"great"'), ("other", "meta", '"x"')]
    won = spark.createDataFrame(rows, "entity_id string, attribute string, value_json string")
    assert [tuple(r) for r in domains.leagues_table(won).collect()] == [("pvp_league_Great League", 1500, "great")]


def everything(tmp_path):
    write(tmp_path / "t/pokedex.yml", {
        "source_key": "pokemon_go_api", "endpoint": "pokedex", "record_extraction": {"iterate_mode": "top_level_list"}, "identity_field": "id", "entity_id_prefix": "pokemon_dex",
        "field_mappings": {"dex_number": {"source_field": "id"}, "name": {"source_field": "names.English", "transform": "nested_path"}, "base_attack": {"source_field": "stats.attack", "transform": "nested_path"}},
        "sub_records": [{"list_field": "forms", "field_mappings": {"form_name": {"source_field": "form"}}}],
    })
    write(tmp_path / "t/stats.yml", {"source_key": "authoritative_game_master", "endpoint": "stats", "identity_field": "id", "entity_id_prefix": "pokemon_dex", "field_mappings": {"base_attack": {"source_field": "atk"}}})
    write(tmp_path / "t/fast.yml", {"source_key": "pogoapi_net", "endpoint": "fast_moves", "field_mappings": {n: {"source_field": n} for n in ("move_id", "name", "type", "power", "duration", "energy_delta")}})
    write(tmp_path / "t/pvp.yml", {"source_key": "pvpoke", "endpoint": "moves", "field_mappings": {n: {"source_field": n} for n in ("moveId", "power", "energy", "turns", "buffs")}})
    at = "2026-01-01T000000Z"
    dex = [{"id": 1, "names": {"English": "Sproutling"}, "stats": {"attack": 10}, "forms": [{"form": "WINTER"}], "unused": 1}, {"id": 2, "names": {"English": "Mudkin"}}]
    write(tmp_path / f"raw/pokemon_go_api/{at}/pokedex.json", dex)
    write(tmp_path / f"raw/pokemon_go_api/{at}/other.json", [{"x": 1}])
    write(tmp_path / f"raw/authoritative_game_master/{at}/stats.json", [{"id": 1, "atk": 12}])
    write(tmp_path / f"raw/pogoapi_net/{at}/fast_moves.json", [{"move_id": 7, "name": "Nudge", "type": "normal", "power": 5, "duration": 500, "energy_delta": 5}])
    write(tmp_path / f"raw/pogoapi_net/{at}/weather_boosts.json", {"Fog": ["Dark"]})
    write(tmp_path / f"raw/pogoapi_net/{at}/nesting_pokemon.json", {"2": {"id": 2, "name": "Mudkin"}})
    write(tmp_path / f"raw/pvpoke/{at}/moves.json", [{"moveId": "NUDGE", "power": 3, "energy": 0, "turns": 1}])
    (tmp_path / f"raw/pvpoke/{at}/broken.json").write_text("{")


def test_everything_from_the_command_line(spark, tmp_path, capsys):
    """Snapshots to all tables, twice: the second build changes nothing; then one value changes."""
    everything(tmp_path)
    args = ["build", "--root", str(tmp_path / "raw"), "--templates", str(tmp_path / "t"), "--database", str(tmp_path / "db"), "--test", "--test-coverage"]
    assert main(args) == 0
    out = capsys.readouterr().out
    assert "Ledger replay" in out and "| pokemon_go_api |" in out and "other: no template" in out and "broken: not readable" in out and "unused" in out
    read = lambda n: spark.read.parquet(str(tmp_path / f"db/{n}.parquet"))
    species = {r.dex_number: r for r in read("species").collect()}
    assert (species[1].base_attack, species[1].slug, species[2].base_attack) == (12, "1-sproutling", None)  # the better source wins
    assert {r.slug for r in read("forms").collect()} == {"1-sproutling-standard", "2-mudkin-standard", "pokemon_dex_1_form_winter"}
    assert [(r.move_id, r.pvp_power, r.is_fast) for r in read("moves").collect()] == [("move_7", 3, True)]
    assert [tuple(r) for r in read("weather_boosts").collect()] == [("Fog", ["Dark"])] and read("nesting_species").first().is_nesting is True
    assert read("quests").columns == [x.split()[0] for x in domains.SCHEMAS["quests"].split(", ")] and read("quests").count() == 0
    assert read("discrepancies").count() == 1
    assert main(args[:-2]) == 0
    assert not (tmp_path / "db/change_history.parquet").exists() or read("change_history").count() == 0
    write(tmp_path / "raw/authoritative_game_master/2026-02-01T000000Z/stats.json", [{"id": 1, "atk": 13}])
    assert main(args[:-2]) == 0
    changes = {(r.entity_id, r.attribute, r.old_value, r.new_value) for r in read("change_history").collect()}
    assert changes == {("species:1-sproutling", "base_attack", "12", "13"), ("forms:1-sproutling-standard", "base_attack", "12", "13"), ("forms:pokemon_dex_1_form_winter", "base_attack", "12", "13")}


def test_other_commands(spark, tmp_path, capsys):
    write(tmp_path / "in/d.json", {"itemList": [{"a": {"b": 1}}, {"a": None}], "words": ["x"], "none": [], "n": 1})
    assert main(["load-arrays", "--document", str(tmp_path / "in/d.json"), "--database", str(tmp_path / "db")]) == 0
    assert json.loads(capsys.readouterr().out) == {"refjson_item_list": 2, "refjson_none": 0, "refjson_words": 1}
    assert spark.read.parquet(str(tmp_path / "db/refjson_item_list.parquet")).columns == ["position", "a.b"]
    assert spark.read.parquet(str(tmp_path / "db/refjson_none.parquet")).columns == ["placeholder"]
    (tmp_path / "s.csv").write_text("entity,field,new_value\ne1,power,3\n,power,4\n")
    for n in (1, 2):
        assert main(["submit", "--csv", str(tmp_path / "s.csv"), "--folder", str(tmp_path / "subs")]) == 0
        assert json.loads(capsys.readouterr().out) == {"submissions": n}
    write(tmp_path / "f/one.json", [1])
    write(tmp_path / "c.yml", {"sources": {"local_authoring": {"files": [str(tmp_path / "f/one.json")]}}})
    assert main(["fetch", "--config", str(tmp_path / "c.yml"), "--root", str(tmp_path / "raw")]) == 0
    assert main(["profile", "--root", str(tmp_path / "raw"), "--source", "local_authoring"]) == 0
    text = sinks.with_counts("| species | 1,024 |\n| other | 5 |\nspecies 9", {"species": 2000})
    assert text == "| species | 2,000 |\n| other | 5 |\nspecies 9"
