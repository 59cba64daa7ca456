"""Field transforms of templates and the text functions behind keys, each as one Column expression."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlake.functions import variant as V

# ---- text functions -----------------------------------------------------------------------------


def capitalised(c: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def title_case(c: Column) -> Column:
    """Every run of letters capitalised, whatever parts the runs (`mr-mime` gives `Mr-Mime`)."""
    return F.array_join(F.transform(F.split(c, r"(?<=[^\p{L}])"), capitalised), "")


def display_name(c: Column, default: str = "Standard") -> Column:
    """A token as shown to people: blanks for underscores, title case; the default for no text."""
    return F.coalesce(F.when(c != "", title_case(F.replace(c, F.lit("_"), F.lit(" ")))), F.lit(default))


def slugify(c: Column) -> Column:
    """Lower case with hyphens for underscores and blanks."""
    return F.translate(F.lower(c), "_ ", "--")


def identity_slug(c: Column) -> Column:
    """Lower case; every run of other signs than a-z and 0-9 is one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def species_slug(dex: Column, name: Column) -> Column:
    """`<number>-<name>` with hyphens for blanks and letters for the two gender signs."""
    n = F.coalesce(name, F.concat(F.lit("Pokemon #"), dex.cast("string")))
    n = F.replace(F.replace(F.replace(F.lower(n), F.lit(" "), F.lit("-")), F.lit("♀"), F.lit("-f")), F.lit("♂"), F.lit("-m"))
    return F.concat(dex.cast("string"), F.lit("-"), n)


def table_name(c: Column) -> Column:
    """A name that is safe in SQL: letters, digits and single underscores in lower case."""
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(c, "[^0-9A-Za-z_]", "_"), "_+", "_"), F.lit("_")))


def snake_case(c: Column) -> Column:
    """camelCase to snake_case."""
    return F.lower(F.regexp_replace(c, "(?<!^)(?=[A-Z])", "_"))


def join_key(c: Column) -> Column:
    """Key for names: lower case, underscores for blanks."""
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def strict_join_key(c: Column) -> Column:
    """Key for names: upper case, every other run of signs one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_"), F.lit("_"))


def without_prefix(c: Column, prefix: str) -> Column:
    """A shouted constant such as TYPE_FIRE without its prefix, capitalised."""
    return capitalised(F.when(c.startswith(prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c))


def regex_text(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without a match; digits lose leading zeros."""
    found = F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))
    return F.when(found.rlike("^[0-9]+$"), F.regexp_replace(found, "^0+(?=[0-9])", "")).otherwise(found)


def shape_fingerprint(paths: Column) -> Column:
    """`sha256:` and 16 hex digits over the sorted distinct paths, written as a JSON list."""
    listed = F.concat(F.lit('["'), F.array_join(F.array_sort(F.array_distinct(paths)), '", "'), F.lit('"]'))
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.when(F.size(paths) == 0, F.lit("[]")).otherwise(listed), 256), 1, 16))


def padded_number(c: Column, width: int = 3) -> Column:
    """`#007`."""
    return F.concat(F.lit("#"), F.lpad(c.cast("string"), width, "0"))


def flags_as_list(flags: Mapping[str, Column]) -> Column:
    """JSON list of the names whose flag is true, in the order given."""
    return F.to_json(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])))


def compact_list(*values: Column) -> Column:
    """An array of the values that aren't null."""
    return F.array_compact(F.array(*values))


def integer_only(v: Column) -> Column:
    """The variant as bigint if it is a whole number written as such, else null."""
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def iso_now() -> Column:
    """The query's instant as ISO text in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


# ---- template transforms: (record, mapping) -> variant ------------------------------------------

Transform = Callable[[Column, Mapping[str, Any]], Column]
TRANSFORMS: dict[str, Transform] = {}


def transform(name: str) -> Callable[[Transform], Transform]:
    """Registers a transform; templates then know it by name."""

    def add(f: Transform) -> Transform:
        TRANSFORMS[name] = f
        return f

    return add


def as_variant(c: Column) -> Column:
    return F.when(c.isNotNull(), c.cast("variant"))


@transform("direct")
def _direct(record: Column, m: Mapping[str, Any]) -> Column:
    return V.field(record, m["source_field"])


@transform("nested_path")
def _nested_path(record: Column, m: Mapping[str, Any]) -> Column:
    found = V.nested(record, m["source_field"])
    return F.coalesce(found, V.field(record, m["fallback_field"])) if m.get("fallback_field") else found


@transform("boolean")
def _boolean(record: Column, m: Mapping[str, Any]) -> Column:
    return as_variant(V.truthy(V.field(record, m["source_field"])))


@transform("list_index")
def _list_index(record: Column, m: Mapping[str, Any]) -> Column:
    return V.present(F.get(V.items(V.field(record, m["source_field"])), F.lit(int(m.get("index", 0)))))


@transform("slugify")
def _slugify(record: Column, m: Mapping[str, Any]) -> Column:
    return as_variant(slugify(V.as_text(V.field(record, m["source_field"]))))


@transform("regex_extract")
def _regex_extract(record: Column, m: Mapping[str, Any]) -> Column:
    v = V.field(record, m["source_field"])
    found = regex_text(F.when(V.kind(v) == "string", V.as_text(v)), m["pattern"], int(m.get("group", 1)))
    number = found.try_cast("bigint")
    return F.when(found.rlike("^[0-9]{1,18}$"), as_variant(number)).otherwise(as_variant(found))


def compiled(mapping: Mapping[str, Any]) -> Transform:
    """The transform a mapping names; an unknown name is an error when the template is compiled."""
    name = mapping.get("transform", "direct")
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name!r}")
    return TRANSFORMS[name]


# ---- identity of variants -----------------------------------------------------------------------


def gender_of(record: Column, signals: list[Mapping[str, Any]], record_key: Column | None = None) -> Column:
    """The label of the first signal that fires, else `unknown`.

    Signals look at a field's truth (boolean_field), a text field's pattern (value_pattern) or the
    pattern of the key under which the record stands (key_pattern).
    """
    out = F.lit("unknown")
    for s in reversed(signals):
        if s["signal_type"] == "boolean_field":
            fires, label = V.truthy(V.field(record, s["source_field"])), s.get("when_true", "female")
        elif s["signal_type"] == "value_pattern":
            v = V.field(record, s["source_field"])
            fires, label = (V.kind(v) == "string") & V.as_text(v).rlike(s["pattern"]), s.get("value", "female")
        elif s["signal_type"] == "key_pattern":
            fires = F.coalesce(record_key if record_key is not None else F.lit(""), F.lit("")).rlike(s["key_pattern"])
            label = s.get("value", "female")
        else:
            continue
        out = F.when(F.coalesce(fires, F.lit(False)), F.lit(label)).otherwise(out)
    return out


#: Fixed: words of a variant's name that say its gender, which has a place of its own.
GENDER_WORDS = ["female", "male"]


def variant_words(text: Column, species: Column) -> Column:
    """The words of a variant's name that tell it apart: without gender words, and without the words of
    its species where they open or close it."""
    spoken = F.regexp_replace(F.lower(text), r"\((" + "|".join(GENDER_WORDS) + r")\)", "")
    words = F.filter(F.split(spoken, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(GENDER_WORDS))
    own = F.split(species, "-")
    n, k = F.size(words), F.size(own)
    opens = F.slice(words, F.lit(1), k) == own
    closes = F.slice(words, F.greatest(n - k + 1, F.lit(1)), k) == own
    return F.when(opens, F.slice(words, k + 1, n)).when(closes, F.slice(words, F.lit(1), n - k)).otherwise(words)


def form_identity(slug: Column, form: Column, costume: Column, gender: Column) -> Column:
    """struct(form_token, costume_token, gender), equal for all spellings of one variant.

    slug is `<number>-<name>`, or the name alone. A token is a text's telling words with hyphens, null if
    there are none; a form that is just called standard has none either.
    """
    parts = F.split(slug, "-")
    species = F.coalesce(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "-"), F.lit(""))
    species = F.when(species == "", slug).otherwise(species)
    forms, costumes = variant_words(form, species), variant_words(costume, species)
    token = lambda words: F.when(F.size(words) > 0, F.array_join(words, "-"))
    return F.struct(
        token(F.when(forms != F.array(F.lit("standard")), forms)).alias("form_token"), token(costumes).alias("costume_token"), gender.alias("gender")
    )


def form_entity_id(prefix: str, raw_id: Column, identity: Column) -> Column:
    """`<prefix>_<id>_form_` and what the identity says, or `standard` if it says nothing."""
    known = F.array_compact(F.array(identity["form_token"], identity["costume_token"], F.nullif(identity["gender"], F.lit("unknown"))))
    return F.concat(F.lit(f"{prefix}_"), raw_id, F.lit("_form_"), F.array_join(F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("standard"))), "_"))
