"""A whole build: snapshots and templates to tables, change history, audit and export."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators import audit
from quorumlake.operators.claims import claims_as_text
from quorumlake.operators.snapshots import keyed_diff
from quorumlake.plans import domains
from quorumlake.session import cut
from quorumlake.sources import sinks
from quorumlake.sources.documents import latest_snapshot, read_document


#: Fixed: the documents and templates (source/endpoint) that the domain tables come from.
TEMPLATE_TABLES = {
    "raid_bosses": "pokemon_go_api/raidboss", "max_battles": "pokemon_go_api/maxbattles", "quests": "pokemon_go_api/quests", "community_days": "pogoapi_net/community_days",
}
MARKED = {
    "regional_species": ("alolan_pokemon", {"region": "Alola"}), "nesting_species": ("nesting_pokemon", {"is_nesting": True}),
    "baby_species": ("baby_pokemon", {"is_baby": True}), "shadow_species": ("shadow_pokemon", {"is_shadow": True}), "mega_species": ("mega_pokemon", {}),
}
DRAFTS, MOVES, PVP_MOVES = "pokemon_go_api/pokedex", ("pogoapi_net/fast_moves", "pogoapi_net/charged_moves"), "pvpoke/moves"


def drafted(spark: SparkSession, source: domains.Source, key: str, schema: str) -> DataFrame:
    """A template's records in the columns of a schema; none without the template."""
    if key not in source.templates:
        return spark.createDataFrame([], schema)
    return sinks.conform(source.rows(spark, key), schema)


def assemble(spark: SparkSession, source: domains.Source, resolved: DataFrame) -> dict[str, DataFrame]:
    """All domain tables, each with its declared schema; what isn't delivered makes an empty table."""

    def document(endpoint: str) -> DataFrame:
        return read_document(spark, source.root, "pogoapi_net", endpoint)

    columns = "dex_number string, name string, generation string, base_attack string, base_defense string, base_stamina string, localized_names string"
    drafts = drafted(spark, source, DRAFTS, columns).filter("dex_number is not null").dropDuplicates(["dex_number"])
    species = domains.species_table(drafts, resolved)
    move = "move_id bigint, name string, type string, power int, duration int, energy_delta int"
    pvp = drafted(spark, source, PVP_MOVES, "pos struct<at: bigint, member: bigint>, moveId string, power int, energy int, turns int, buffs string").withColumnRenamed("pos", "seq")
    out = {
        "species": species,
        "forms": domains.forms_table(resolved, species),
        "moves": domains.moves_table(*[drafted(spark, source, k, move) for k in MOVES], pvp),
        "type_effectiveness": domains.type_table(document("type_effectiveness")),
        "weather_boosts": domains.weather_table(document("weather_boosts")),
        "badges": domains.badges_table(document("badges")),
        "pvp_leagues": domains.leagues_table(resolved),
    }
    for name, (endpoint, marks) in MARKED.items():
        out[name] = domains.marked_species(document(endpoint), name, {k: F.lit(v) for k, v in marks.items()})
    for name, key in TEMPLATE_TABLES.items():
        out[name] = drafted(spark, source, key, domains.SCHEMAS[name])
    return out


def build_all(spark: SparkSession, source: domains.Source, database: str | Path, only: list[str] | None = None, export: str | Path | None = None) -> dict[str, int]:
    """Everything: the ledger of all templates that have an identity, the domain tables, history, export."""
    keys = [k for k, t in source.templates.items() if t.identity_field and (not only or t.source_key in only)]
    return build(spark, source, keys, database, lambda resolved: assemble(spark, source, resolved), export)


def replay_build(spark: SparkSession, database: str | Path) -> DataFrame:
    """Claims per source and bucket: the stored ledger against the tables that were built from it.

    A claim is looked up among species, then forms, then moves by the entity its id names.
    """
    read = lambda n: spark.read.parquet(f"{database}/{n}.parquet")
    ledger = read("_claims_ledger").withColumn("value_json", F.to_json(F.coalesce(F.try_parse_json("value"), F.col("value").cast("variant"))))
    parts = []
    for name, key in (("species", F.concat(F.lit("pokemon_dex_"), F.col("dex_number").cast("string"))), ("forms", F.col("slug")), ("moves", F.col("move_id"))):
        df = read(name)
        cells = F.array(*[F.struct(F.lit(c).alias("attribute"), F.to_json(F.col(f"`{c}`").cast("variant")).alias("value_json")) for c in df.columns])
        parts.append(df.select(F.lit(name).alias("table_name"), key.alias("entity_id"), F.explode(cells).alias("_c")).select("table_name", "entity_id", "_c.*"))
    stored = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("value_json is not null")
    known = F.col("entity_id").rlike("^(pokemon_dex_|move_)")
    return audit.replay_report(audit.replay(ledger, stored, known, candidates=[(n, F.col("entity_id")) for n in ("species", "forms", "moves")]))


def build(
    spark: SparkSession, source: domains.Source, keys: list[str], database: str | Path,
    tables: dict[str, DataFrame] | Callable[[DataFrame], dict[str, DataFrame]] | None = None, export: str | Path | None = None
) -> dict[str, int]:
    """Reconciles the templates named and writes all tables; returns rows per table.

    The ledger is written once and feeds resolution, discrepancies and the stored ledger. `tables` are
    domain tables to store beside them, or a function of the resolved values that gives them; those with a key in sinks.DIFFED are compared with the build
    before, whose changes go to change_history: none on the first build, none if nothing changed.
    """
    database = Path(database)
    ledger = cut(domains.build_ledger(spark, source, keys))
    resolved, torn = domains.reconcile(ledger)
    resolved = cut(resolved)
    out = dict(tables(resolved) if callable(tables) else tables or {})
    for name, df in out.items():
        key, before = sinks.DIFFED.get(name), database / f"{name}.parquet"
        if key and before.is_dir():
            changes = keyed_diff(spark.read.parquet(str(before)), df, key, [c for c in df.columns if c != key])
            sinks.append_history(cut(changes), name, "build", database / "change_history.parquet")
    pulled = {s: latest_snapshot(source.root, s) or "" for s in sorted({source.templates[k].source_key for k in keys})}
    out |= {
        "resolved": resolved,
        "discrepancies": torn,
        "_claims_ledger": claims_as_text(ledger).withColumn("seq", F.to_json("seq")),
        "_meta": sinks.meta_rows(spark, pulled),
    }
    # a table may be read from the build it replaces, so all are computed before the first is written
    ready = {n: cut(df) for n, df in out.items()}
    sinks.write_tables(ready, database)
    if export:
        sinks.export_parquet(spark, database, export)
    return {n: df.count() for n, df in ready.items()}
