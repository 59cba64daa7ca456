"""Queries pN_... of the problems on texts and matching, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions.clean import blank_to_null, norm_id, trimmed
from quorumlake.llm import consensus, contamination, languages, linkage, packing
from quorumlake.operators.skew import salted_join
from quorumlake.session import cut, table

#: Where the tokenizers' vocabulary files are; a parameter of the packing queries.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048

#: Fixed: values that stand for no value.
PLACEHOLDERS = ["-", "--", "?", "??", "n/a", "na", "nan", "none", "null", "tba", "tbd", "unknown"]
#: Rank of a source that the registry doesn't list.
UNLISTED_RANK = 99


def usual(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the value that most rows of a key have, the smallest of equals; nulls don't count."""
    counted = rows.dropna(subset=[key, value]).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def p2_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The form each raid boss describes, with the label model's confidence.

    Single rows of species and forms carry a wrong or no number, so the usual number of a slug counts;
    a form without any belongs to the species its species_slug names, or else its own slug.
    """
    b, f, s = (table(spark, d, n) for n in ("raid_bosses", "forms", "species"))
    species = s.select(norm_id(s["slug"]).alias("_species"), F.col("dex_number").alias("_dex"), "name", "localized_names")
    numbers = usual(species, "_species", "_dex")
    bosses = b.select(
        b["boss_id"].cast("bigint").alias("boss_id"), "name", "form", "costume", b["pokemon_id"].alias("reference"),
        "min_cp", "max_cp", "min_boosted_cp", "max_boosted_cp", b["snapshot_ts"].alias("snapshot"), b["loaded_at"].alias("loaded"),
    )
    forms = f.select(
        norm_id(f["slug"]).alias("slug"), f["dex_number"].alias("_own"), norm_id(f["species_slug"]).alias("_species"),
        f["form_name"].alias("variant"), f["costume_name"].alias("costume"), f["snapshot_ts"].alias("snapshot"),
        f["base_attack"].alias("attack"), f["base_defense"].alias("defence"), f["base_stamina"].alias("stamina"),
    )
    from_slug = F.regexp_extract("slug", r"_dex_([0-9]+)_", 1).try_cast("int")
    owners = (
        forms.groupBy("slug")
        .agg(F.max("_species").alias("_species"))
        .withColumn("_species", F.coalesce("_species", F.regexp_replace("slug", "-standard$", "")))
        .join(usual(forms, "slug", "_own"), "slug", "left")
    )
    owners = salted_join(owners, numbers, ["_species"], F.col("slug"), "left").select("slug", F.coalesce("_own", "_dex", from_slug).alias("dex"))
    forms = forms.drop("_own", "_species").join(owners, "slug")
    localized = F.map_values(F.from_json("localized_names", "map<string,string>"))
    spellings = F.explode(F.concat(F.array("name", "_species"), F.coalesce(localized, F.array().cast("array<string>"))))
    names = species.select("_species", spellings.alias("name")).distinct().join(numbers, "_species").select(F.col("_dex").alias("dex"), "name")
    return linkage.match_forms(bosses, forms, names)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The form each raid boss describes."""
    return p2_confidence(spark, d).select("boss_id", "form_slug")


def source_key(c):
    return F.translate(norm_id(c), "- ", "__")


def claims_of(spark: SparkSession, d: str) -> DataFrame:
    """Each claim once: dex_number, attribute, claim_id, source, value, rank, at (microseconds, null is the oldest)."""
    t = table(spark, d, "discrepancies")
    rows = t.select(
        F.regexp_extract(trimmed(t["entity_id"]), r"([0-9]+)$", 1).try_cast("bigint").alias("dex_number"),
        norm_id(t["attribute"]).alias("attribute"),
        F.explode("claims").alias("_c"),
    )
    value = blank_to_null(F.col("_c.value"))
    claims = rows.select(
        "dex_number",
        "attribute",
        F.col("_c.claim_id").alias("claim_id"),
        source_key(F.col("_c.source")).alias("source"),
        F.when(~F.lower(value).isin(PLACEHOLDERS), value).alias("value"),
        F.unix_micros(F.col("_c.claimed_at").cast("timestamp")).alias("at"),
    ).filter("value is not null and dex_number is not null and attribute is not null and claim_id is not null")
    registry = table(spark, d, "source_registry").groupBy(source_key(F.col("source_key")).alias("source")).agg(F.min("trust_rank").alias("rank"))
    return (
        claims.distinct()
        .join(registry, "source", "left")
        .withColumn("rank", F.coalesce(F.col("rank"), F.lit(UNLISTED_RANK)).cast("bigint"))
    )


def priority() -> list:
    """Smaller is better: trust rank, then the latest claim (null is the oldest), then the lowest id."""
    return [F.col("rank"), F.coalesce(-F.col("at"), F.lit(2**62)), F.col("claim_id")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The surviving claim of every species' attribute: consensus in which the best claims of a group
    outweigh all others together.

    The best are those of the lowest rank and, of these, the latest instant. Only their values may
    survive; where they differ, the tokens decide, on which the other claims vote too.
    """
    keys = ["dex_number", "attribute"]
    level = F.struct("rank", priority()[1].alias("age"))
    claims = cut(claims_of(spark, d))
    first = claims.groupBy(*keys).agg(F.min(level).alias("_first"))
    ranked = salted_join(claims, first, keys, F.col("claim_id")).withColumn("_best", level == F.col("_first"))
    best = consensus.best_representatives(
        ranked, keys, [F.col("_best").cast("int"), (~F.col("_best")).cast("int")], priority(), "claim_id", F.col("_best")
    )
    return best.select(*keys, "claim_id")


def p5_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The same with weights that add up (one over the trust rank), where many weak claims can win."""
    return consensus.best_representatives(claims_of(spark, d), ["dex_number", "attribute"], [F.lit(1.0) / F.col("rank")], priority(), "claim_id")


def p5_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows with the surviving value and source beside what they had, and whether that was right."""
    t = table(spark, d, "discrepancies")
    won = cut(p5_found(spark, d)).join(
        claims_of(spark, d).select("claim_id", F.col("value").alias("true_value"), F.col("source").alias("true_source")).distinct(), "claim_id"
    )
    stored = t.select(
        "row_id",
        F.regexp_extract(trimmed(t["entity_id"]), r"([0-9]+)$", 1).try_cast("bigint").alias("dex_number"),
        norm_id(t["attribute"]).alias("attribute"),
        blank_to_null(t["resolved_value"]).alias("stored_value"),
        source_key(t["winning_source"]).alias("stored_source"),
    ).distinct()
    right = F.col("stored_value").eqNullSafe(F.col("true_value")) & F.col("stored_source").eqNullSafe(F.col("true_source"))
    return salted_join(stored, won, ["dex_number", "attribute"], F.col("row_id")).select(
        "row_id", "dex_number", "attribute", "stored_value", "stored_source", "true_value", "true_source", right.alias("was_right")
    )


def p8_sequences(spark: SparkSession, d: str, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Every text's place in the sequences of fixed capacity."""
    sizes = packing.token_counts(table(spark, d, "documents"), "doc_id", "text", vocabulary)
    return packing.pack(sizes, "doc_id", capacity)


def p8_fill(spark: SparkSession, d: str, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """How well the sequences are filled."""
    s = p8_sequences(spark, d, vocabulary, capacity).groupBy("sequence_id").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("n"))
    return s.agg(
        F.count(F.lit(1)).alias("n_sequences"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"),
        (F.sum("n") / (F.count(F.lit(1)) * F.lit(capacity))).alias("fill"),
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the benchmark items whose passages they hold."""
    return contamination.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: how many documents hold it, and the longest passage."""
    leaks = contamination.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("longest"))


def p10_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p10_found with their confidence: one pass in which each text carries its label along."""
    t = table(spark, d, "documents").select("doc_id", "text", languages.label_code(F.col("lang")).alias("code"))
    found = languages.detect(t, languages.fit(t))
    wrong = (F.col("segment_no") >= 0) | (F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(F.col("label")))
    return found.filter(wrong).drop("label")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a missing or wrong label, and the lines of documents in several languages."""
    return p10_confidence(spark, d).select("doc_id", "segment_no", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p2_found, p2_confidence, p5_found, p5_consensus, p5_corrections, p8_sequences, p8_fill, p9_found, p9_items, p10_found, p10_confidence)
}
