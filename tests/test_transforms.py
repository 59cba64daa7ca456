import json

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import transforms as T
from quorumlake.functions import variant as V
from quorumlake.functions.clean import canonical_json, canonical_value, instant_micros, norm_id
from quorumlake.sources.templates import template_from


def apply(spark, record, mapping):
    df = spark.createDataFrame([(json.dumps(record),)], "j string").select(F.parse_json("j").alias("record"))
    out = df.select(F.to_json(T.compiled(mapping)(F.col("record"), mapping)).alias("x")).first()["x"]
    return None if out is None else json.loads(out)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("record", "mapping", "want"),
    [
        ({"a": 5}, {"source_field": "a"}, 5),
        ({"a": {"b": [1]}}, {"source_field": "a"}, {"b": [1]}),
        ({}, {"source_field": "a"}, None),
        ({"a": None}, {"source_field": "a"}, None),
        ({"a": {"b": "x"}}, {"source_field": "a.b", "transform": "nested_path"}, "x"),
        ({"a": {"b": None}, "c": 7}, {"source_field": "a.b", "transform": "nested_path", "fallback_field": "c"}, 7),
        ({"a": "flat", "c": 7}, {"source_field": "a.b", "transform": "nested_path"}, None),
        ({"a": 0}, {"source_field": "a", "transform": "boolean"}, False),
        ({"a": ""}, {"source_field": "a", "transform": "boolean"}, False),
        ({"a": "false"}, {"source_field": "a", "transform": "boolean"}, True),
        ({"a": []}, {"source_field": "a", "transform": "boolean"}, False),
        ({"a": {}}, {"source_field": "a", "transform": "boolean"}, False),
        ({"a": 0.5}, {"source_field": "a", "transform": "boolean"}, True),
        ({}, {"source_field": "a", "transform": "boolean"}, None),
        ({"a": [3, 4]}, {"source_field": "a", "transform": "list_index", "index": 1}, 4),
        ({"a": [3, 4]}, {"source_field": "a", "transform": "list_index", "index": 2}, None),
        ({"a": "no"}, {"source_field": "a", "transform": "list_index"}, None),
        ({"a": "Mr_Mime Jr"}, {"source_field": "a", "transform": "slugify"}, "mr-mime-jr"),
        ({"a": 12}, {"source_field": "a", "transform": "slugify"}, "12"),
        ({"a": "V0001_X"}, {"source_field": "a", "transform": "regex_extract", "pattern": r"V(\d+)_"}, 1),
        ({"a": "kind_x"}, {"source_field": "a", "transform": "regex_extract", "pattern": r"kind_(\w+)"}, "x"),
        ({"a": "other"}, {"source_field": "a", "transform": "regex_extract", "pattern": r"V(\d+)_"}, None),
        ({"a": 5}, {"source_field": "a", "transform": "regex_extract", "pattern": r"(\d+)"}, None),
    ],
)
def test_template_transforms(spark, record, mapping, want):
    assert apply(spark, record, mapping) == want


def test_unknown_transform_fails_when_compiled():
    with pytest.raises(ValueError):
        template_from({"source_key": "s", "endpoint": "e", "field_mappings": {"x": {"transform": "magic"}}})


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (T.title_case, "mr-mime x oNEIL_a", "Mr-Mime X Oneil_A"),
        (T.title_case, "élan vital", "Élan Vital"),
        (T.display_name, "ALOLA_FORM", "Alola Form"),
        (T.display_name, None, "Standard"),
        (T.identity_slug, " Mr. Mime! ", "mr-mime"),
        (T.table_name, "A--b c__D_", "a_b_c_d"),
        (T.snake_case, "formMoves", "form_moves"),
        (T.join_key, "Tidal Burst", "tidal_burst"),
        (T.strict_join_key, "X-Scissor (new)", "X_SCISSOR_NEW"),
        (lambda c: T.without_prefix(c, "POKEMON_TYPE_"), "POKEMON_TYPE_FIRE", "Fire"),
        (norm_id, " \tAb ", "ab"),
        (norm_id, " ", None),
        (canonical_value, " NaN ", None),
        (canonical_value, "None", None),
        (canonical_value, "294.0", "294"),
        (canonical_value, "-0.0", "0"),
        (canonical_value, "0.50", "0.5"),
        (canonical_value, "100", "100"),
        (canonical_value, "True", "true"),
        (canonical_value, " Stone Lash ", "Stone Lash"),
        (canonical_json, '{"b": 1.0, "a": "\\u00e9"}', '{"a":"é","b":1}'),
        (canonical_json, "not json ", "not json"),
    ],
)
def test_text_functions(spark, function, text, want):
    assert one(spark, text, function) == want


@pytest.mark.parametrize(
    ("text", "seconds"),
    [
        ("1970-01-01T00:01:00+00:00", 60),
        ("1970-01-01T00:01:00Z", 60),
        ("1970-01-01T000100Z", 60),
        ("1970-01-01 00:01:00", 60),
        ("1970-01-01T05:31:00+05:30", 60),
        ("1969-12-31T19:01:00-05:00", 60),
        ("1970-01-01T00:01:00.500000+00:00", 60.5),
        ("60000", 60),
    ],
)
def test_instants(spark, text, seconds):
    assert one(spark, text, instant_micros) == seconds * 1_000_000


@pytest.mark.parametrize("text", [None, "", "soon", "2028-13-01T00:00:00Z"])
def test_no_instant(spark, text):
    assert one(spark, text, instant_micros) is None


def identity(spark, slug, form, costume, gender):
    df = spark.createDataFrame([(slug, form, costume, gender)], "s string, f string, c string, g string")
    who = T.form_identity(F.col("s"), F.col("f"), F.col("c"), F.col("g"))
    return df.select(T.form_entity_id("p", F.lit("712"), who).alias("x")).first()["x"]


def test_spellings_of_one_variant_share_an_id(spark):
    ids = {identity(spark, "712-glimmer-eel", f, None, "female") for f in ("Glimmer Eel (Female)", "Female", "Female glimmer eel", "GLIMMER_EEL_FEMALE")}
    assert ids == {"p_712_form_female"}
    assert identity(spark, "712-glimmer-eel", "Standard", None, "unknown") == "p_712_form_standard"
    assert identity(spark, "712-glimmer-eel", None, "Glimmer Eel Straw Crown", "unknown") == "p_712_form_straw-crown"


def test_gender_signals_fire_in_order(spark):
    signals = [
        {"signal_type": "boolean_field", "source_field": "isFemale"},
        {"signal_type": "value_pattern", "source_field": "form", "pattern": "(?i)female", "value": "f2"},
        {"signal_type": "key_pattern", "key_pattern": "_FEMALE$", "value": "f3"},
    ]
    rows = [('{"isFemale": true, "form": "FEMALE"}', None), ('{"isFemale": false, "form": "Female"}', None), ('{"form": 1}', "X_FEMALE"), ("{}", "X"), ("{}", None)]
    df = spark.createDataFrame(rows, "j string, k string").select(T.gender_of(F.parse_json("j"), signals, F.col("k")).alias("g"))
    assert [r.g for r in df.collect()] == ["female", "f2", "f3", "unknown", "unknown"]


def test_small_helpers(spark):
    df = spark.createDataFrame([(True, None, 7)], "a boolean, b boolean, n int")
    row = df.select(
        T.flags_as_list({"x": F.col("a"), "y": F.col("b")}).alias("flags"), T.compact_list(F.col("n"), F.lit(None)).alias("l"), T.padded_number(F.col("n")).alias("p"),
        V.as_text(V.first_truthy(F.lit("").cast("variant"), F.lit(3).cast("variant"))).alias("first"), T.integer_only(F.parse_json(F.lit("1.5"))).alias("i"),
    ).first()
    assert (row.flags, row.l, row.p, row.first, row.i) == ('["x"]', [7], "#007", "3", None)


def test_identity_whatever_the_spelling(spark):
    """Case, separators, gender words and the species' own name don't matter; other words do."""
    import itertools

    parts = {"red moon": ("red-moon", "x-ray"), "winter coat 2": ("winter-coat-2", "x-ray"), "standard": (None, "x-ray"), "": (None, "x-ray")}
    rows, want = [], []
    for (said, (token, _)), sep, own, gender in itertools.product(parts.items(), (" ", "_", "--", " / "), ("", "before", "after"), ("", "female", "(male)")):
        words = said.split()
        words = ["X", "Ray", *words] if own == "before" else [*words, "x", "RAY"] if own == "after" else words
        rows.append((sep.join([*words, gender]).strip(),))
        want.append(token)
    df = spark.createDataFrame(rows, "f string")
    who = T.form_identity(F.lit("9-x-ray"), F.col("f"), F.lit(None).cast("string"), F.lit("unknown"))
    assert [r.t for r in df.select(who["form_token"].alias("t")).collect()] == want
    assert identity(spark, "7", "seven", None, "unknown") == "p_712_form_seven" and identity(spark, "9-x-ray", "x", "ray", "male") == "p_712_form_x_ray_male"
