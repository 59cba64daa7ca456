"""Domain tables from transformed records and resolved claims: drafts first, resolved values over them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import variant as V
from quorumlake.functions.transforms import compact_list, join_key, species_slug, strict_join_key, title_case, without_prefix
from quorumlake.operators.claims import last_wins, ledger, record_claims
from quorumlake.operators.extract import array_rows, crosstab_rows, keyed_lists, list_or_object, transformed_records, unwrap
from quorumlake.operators.joins import fallback_join
from quorumlake.operators.resolve import discrepancies, resolve, upsert
from quorumlake.sources.documents import read_document
from quorumlake.sources.sinks import conform
from quorumlake.sources.templates import Template

#: Fixed: the declared columns of the domain tables.
SCHEMAS = {
    "species": "dex_number int, slug string, name string, gen int, can_mega_evolve boolean, can_gigantamax boolean, buddy_distance_km int, base_attack int, base_defense int, base_stamina int, max_cp_lvl40 int, localized_names string, types array<string>",
    "forms": "slug string, species_slug string, dex_number int, form_name string, costume_name string, costume_display_name string, gender string, shiny_available boolean, shiny_release_date string, shadow_available boolean, buddy_distance_km int, base_attack int, base_defense int, base_stamina int, max_cp_lvl40 int, image_url string, shiny_image_url string",
    "moves": "move_id string, name string, type string, is_fast boolean, pve_power int, pve_duration_ms int, pve_energy_delta int, pvp_power int, pvp_energy_cost int, pvp_cooldown_turns int, stat_buffs string",
    "progression": "level double, cp_multiplier double",
    "type_effectiveness": "attacking_type string, defending_type string, multiplier double",
    "weather_boosts": "weather string, boosted_types array<string>",
    "community_days": "event_id string, name string, date string, featured_pokemon string",
    "raid_bosses": "tier string, pokemon_id string, name string, form string, costume string, min_cp int, max_cp int, min_boosted_cp int, max_boosted_cp int, shiny_available boolean, image_url string, shiny_image_url string",
    "max_battles": "tier string, pokemon_id string, name string, form string, costume string, max_particles_cost int, shiny_available boolean, image_url string, shiny_image_url string",
    "quests": "quest_id string, type string, text string, target int, reward_type string, reward_detail string",
    "regional_species": "dex_number int, name string, region string",
    "nesting_species": "dex_number int, name string, is_nesting boolean",
    "baby_species": "dex_number int, name string, form string, is_baby boolean",
    "shadow_species": "dex_number int, name string, is_shadow boolean",
    "mega_species": "dex_number int, name string, mega_name string, first_evolution_energy int, subsequent_evolution_energy int",
    "badges": "badge_id string, name string, is_event_badge boolean, description string, rank bigint, targets string",
    "pvp_leagues": "league_id string, cp_limit int, meta string",
}


@dataclass(frozen=True)
class Source:
    """A snapshot folder tree and the templates that read it."""

    root: str | Path
    templates: Mapping[str, Template]

    def records(self, spark: SparkSession, key: str) -> DataFrame:
        t = self.templates[key]
        return unwrap(read_document(spark, self.root, t.source_key, t.endpoint), t)

    def claims(self, spark: SparkSession, key: str) -> DataFrame:
        return record_claims(self.records(spark, key), self.templates[key])

    def rows(self, spark: SparkSession, key: str) -> DataFrame:
        """Transformed records with scalars as text, arrays and objects as JSON."""
        t = self.templates[key]
        wide = transformed_records(self.records(spark, key), t)
        return wide.select(*[V.as_text(F.col(f"`{c}`")).alias(c) if k == "variant" else F.col(f"`{c}`") for c, k in wide.dtypes])


def build_ledger(spark: SparkSession, source: Source, keys: list[str]) -> DataFrame:
    """All claims of the templates named, each source's repeats collapsed to its last word."""
    return ledger([last_wins(source.claims(spark, k)) for k in keys])


def reconcile(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved values, discrepancies) of a ledger that is written already."""
    return resolve(claims), discrepancies(claims, written=True)


def species_table(drafts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Species rows: drafts (dex_number, name, ... as text) with resolved values over them, in file order.

    types come from the claims on the two raw types where there are any.
    """
    rows = drafts.withColumn("_e", F.concat(F.lit("pokemon_dex_"), "dex_number")).withColumn(
        "slug", species_slug(F.col("dex_number").try_cast("int"), F.col("name"))
    )
    over = {
        "name": ("name", "string"), "gen": ("generation", "int"), "can_mega_evolve": ("can_mega_evolve", "boolean"),
        "can_gigantamax": ("can_gigantamax", "boolean"), "buddy_distance_km": ("buddy_distance_km", "int"), "base_attack": ("base_attack", "int"),
        "base_defense": ("base_defense", "int"), "base_stamina": ("base_stamina", "int"), "max_cp_lvl40": ("max_cp_lvl40", "int"),
        "_t1": ("primary_type_raw", "string"), "_t2": ("secondary_type_raw", "string"),
    }
    for c in over:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    done = upsert(rows, "_e", resolved, over)
    types = compact_list(*[without_prefix(F.col(c), "POKEMON_TYPE_") for c in ("_t1", "_t2")])
    given = F.col("types") if "types" in done.columns else F.lit(None).cast("array<string>")
    return conform(done.withColumn("types", F.when(F.size(types) > 0, types).otherwise(given)), SCHEMAS["species"])


def forms_table(resolved: DataFrame, species: DataFrame, costume_names: DataFrame | None = None) -> DataFrame:
    """A standard form per species and a row per form entity; variants take their species' numbers.

    costume_names: (token, display_name) of curated costumes.
    """
    standard = species.select(
        F.concat("slug", F.lit("-standard")).alias("slug"), F.col("slug").alias("species_slug"), "dex_number", F.lit("Standard").alias("form_name"),
        F.lit("unknown").alias("gender"), "buddy_distance_km", "base_attack", "base_defense", "base_stamina", "max_cp_lvl40",
    )
    named = ["dex_number", "form_name", "costume_name", "gender", "image_url", "shiny_image_url"]
    entities = resolved.filter(F.col("entity_id").contains("_form_"))
    wide = entities.groupBy("entity_id").pivot("attribute", named).agg(F.first("value_json", ignorenulls=True))
    text = lambda c: V.as_text(F.try_parse_json(F.col(c))).alias(c)
    variants = wide.select(F.col("entity_id").alias("slug"), *[text(c) for c in named]).withColumn("dex_number", F.col("dex_number").try_cast("int"))
    variants = variants.withColumn("gender", F.coalesce("gender", F.lit("unknown"))).withColumn("shadow_available", F.lit(False))
    context = species.select("dex_number", F.col("slug").alias("species_slug"), "buddy_distance_km", "base_attack", "base_defense", "base_stamina", "max_cp_lvl40")
    variants = variants.join(context, "dex_number", "left")
    if costume_names is not None:
        curated = costume_names.select(F.col("token").alias("costume_name"), F.col("display_name").alias("costume_display_name"))
        variants = variants.join(curated, "costume_name", "left")
    return conform(standard, SCHEMAS["forms"]).unionByName(conform(variants, SCHEMAS["forms"]))


def moves_table(fast: DataFrame, charged: DataFrame, pvp: DataFrame) -> DataFrame:
    """Fast and charged moves with PvP values joined by name; fast ones also match a name ending in _FAST.

    fast and charged: move_id, name, type, power, duration, energy_delta; pvp: moveId, power, energy,
    turns, buffs (JSON text or null), seq.
    """
    tagged = fast.withColumn("is_fast", F.lit(True)).unionByName(charged.withColumn("is_fast", F.lit(False)))
    exact = strict_join_key(F.col("name"))
    keys = [exact, F.when(F.col("is_fast"), F.concat(exact, F.lit("_FAST")))]
    joined = fallback_join(
        tagged, pvp.select("moveId", F.col("power").alias("pvp_power"), F.col("energy").alias("pvp_energy_cost"), "turns", "buffs", "seq"),
        keys, strict_join_key(F.col("moveId")), F.col("seq"), ["pvp_power", "pvp_energy_cost", "turns", "buffs"],
    )
    rows = joined.select(
        F.concat(F.lit("move_"), F.col("move_id").cast("string")).alias("move_id"), "name", title_case("type").alias("type"), "is_fast", F.col("power").alias("pve_power"),
        F.col("duration").alias("pve_duration_ms"), F.col("energy_delta").alias("pve_energy_delta"), "pvp_power", "pvp_energy_cost",
        F.when(F.col("is_fast"), F.col("turns")).alias("pvp_cooldown_turns"), F.when(~F.col("is_fast"), F.col("buffs")).alias("stat_buffs"),
    )
    return conform(rows, SCHEMAS["moves"])


def progression_table(records: DataFrame, field: str = "cpMultiplier") -> DataFrame:
    return conform(array_rows(records, field, "level", "cp_multiplier"), SCHEMAS["progression"])


def type_table(documents: DataFrame) -> DataFrame:
    return conform(crosstab_rows(documents, "attacking_type", "defending_type", "multiplier"), SCHEMAS["type_effectiveness"])


def weather_table(documents: DataFrame) -> DataFrame:
    return conform(keyed_lists(documents, "weather", "boosted_types"), SCHEMAS["weather_boosts"])


def marked_species(documents: DataFrame, schema: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """(dex_number, name, ...) of a list or an object keyed by number whose members have id and name."""
    number = F.coalesce(V.field(F.col("record"), "id"), V.field(F.col("record"), "pokemon_id"))
    members = list_or_object(documents).select(
        F.coalesce(F.try_variant_get(number, "$", "int"), F.col("record_key").try_cast("int")).alias("dex_number"),
        V.as_text(F.coalesce(V.field(F.col("record"), "name"), V.field(F.col("record"), "pokemon_name"))).alias("name"),
        V.as_text(V.field(F.col("record"), "form")).alias("form"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    return conform(members, SCHEMAS[schema])


def badges_table(documents: DataFrame) -> DataFrame:
    """One row per raw badge; the id comes from name and description, which tell badges apart."""
    name, text = V.as_text(V.field(F.col("record"), "name")), V.as_text(V.field(F.col("record"), "description"))
    rows = list_or_object(documents).select(
        F.concat_ws("|", join_key(name), join_key(text)).alias("badge_id"), name.alias("name"), text.alias("description"),
        F.coalesce(V.truthy(V.field(F.col("record"), "is_event_badge")), F.lit(False)).alias("is_event_badge"),
        F.try_variant_get("record", "$.rank", "bigint").alias("rank"), F.to_json(V.field(F.col("record"), "targets")).alias("targets"),
    )
    return conform(rows, SCHEMAS["badges"])


def template_table(spark: SparkSession, source: Source, key: str, schema: str, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """A domain table whose columns are just a template's attributes (bosses, battles, quests, days, items).

    Missing attributes are null, given defaults fill nulls; one row per record, keys may be null.
    """
    rows = conform(source.rows(spark, key), SCHEMAS.get(schema, schema))
    for c, value in (defaults or {}).items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), value))
    return rows


def leagues_table(resolved: DataFrame) -> DataFrame:
    """One row per league entity, from resolved values."""
    wide = resolved.filter(F.col("entity_id").startswith("pvp_league_")).groupBy("entity_id").pivot("attribute", ["cp_limit", "meta"]).agg(F.first("value_json", ignorenulls=True))
    text = lambda c: V.as_text(F.try_parse_json(F.col(c))).alias(c)
    return conform(wide.select(F.col("entity_id").alias("league_id"), text("cp_limit"), text("meta")), SCHEMAS["pvp_leagues"])
