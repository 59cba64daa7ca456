"""Deeply nested records as related flat tables, routed by the shape of each object.

A bottom-up tree automaton reads values: leaves get a state by their type, arrays and objects by the
states of their children. The labels on the way (field names, reduced to symbols) and the states decide
in one routing table which subtype table a value goes to and how it is read: a range may be a pair, an
object of two bounds or a text. Rows of all subtypes keep the same supertype keys (payload_id,
parent_key, child_key), so every row is linked to its parent, and each subtype has one type of value.
The automaton walks with a stack of its own: no depth that parses is too deep for it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_SCHEMA = "payload_id bigint, child_kind string, variant string, parent_key string, child_key string, text_value string, number_value double"

RANGE_TEXT = re.compile(r"^\s*(-?\d+(?:\.\d+)?)\s*(?:-|–|\.\.|to)\s*(-?\d+(?:\.\d+)?)\s*$")
NUMBER_TEXT = re.compile(r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)\s*$")


def parse_json(text: str | None) -> Any:
    """The document, or ValueError if the text is null, truncated or no JSON."""
    if text is None:
        raise ValueError("no text")
    try:
        return json.loads(text)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def remembered(f: Callable[[str], Any], most: int = 10_000) -> Callable[[str], Any]:
    """f with its last results kept; unlike functools' cache it travels to workers by value."""
    known: dict[str, Any] = {}

    def get(x: str) -> Any:
        if x not in known:
            if len(known) >= most:
                known.clear()
            known[x] = f(x)
        return known[x]

    return get


def json_text(v: Any) -> str:
    """JSON text with sorted keys, however deep the value is."""
    try:
        return json.dumps(v, sort_keys=True, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    stack: list[Any] = [v]
    mark = object()  # what follows on the stack is text as it is
    while stack:
        x = stack.pop()
        if x is mark:
            out.append(stack.pop())
        elif isinstance(x, (dict, list)) and x:
            parts: list[Any] = []
            for i, (k, c) in enumerate(sorted(x.items()) if isinstance(x, dict) else [(None, c) for c in x]):
                parts += [mark, (", " if i else "{" if isinstance(x, dict) else "[") + ("" if k is None else json.dumps(k, ensure_ascii=False) + ": "), c]
            parts += [mark, "}" if isinstance(x, dict) else "]"]
            # pairs of mark and text are popped in this order
            stack += reversed(parts)
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


@remembered
def words_of(name: str) -> frozenset[str]:
    """Lower-case words of a snake, kebab or camel case field name."""
    return frozenset(w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name))


#: Fixed: words by which files name the three stats.
STAT_WORDS = {"base_attack": {"attack", "atk"}, "base_defense": {"defense", "defence", "def"}, "base_stamina": {"stamina", "sta", "hp"}}


@remembered
def symbols_of(label: str) -> tuple[str, ...]:
    """The symbols of the automaton's alphabet that a field name stands for."""
    words = words_of(label)
    found = [s for s, known in STAT_WORDS.items() if words & known]
    if label == "currentList":
        found.append("tiers")
    if words in ({"names"}, {"name"}):
        found.append("names")
    if words & {"names", "name"} and "asset" not in words:
        found.append("label_of")
    if "cp" in words:
        found.append("boosted_cp" if any(w.startswith("boost") for w in words) else "cp")
    if "weather" in words:
        found.append("weather")
    if "stats" in words:
        found.append("stats")
    return tuple(found)


NUMERIC, SCALAR = {"number", "number_text", "null"}, {"null", "bool", "number", "number_text", "range_text", "text"}


def leaf_state(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float)):
        return "number"
    return "number_text" if NUMBER_TEXT.match(v) else "range_text" if RANGE_TEXT.match(v) else "text"


def array_state(children: list[str], elements: list) -> str:
    """Arrays: pair (two numbers, texts of numbers or nulls), objects, list."""
    if len(children) == 2 and set(children) <= NUMERIC:
        return "pair"
    return "objects" if elements and all(isinstance(x, dict) for x in elements) else "list"


def object_state(children: dict[str, str]) -> str:
    """Objects: bounds (min and max), boxed (one scalar in a wrapper), labels (texts only), object."""
    states = set(children.values())
    if children and set(children) <= {"min", "max"} and states <= NUMERIC:
        return "bounds"
    if len(children) == 1 and set(children) <= {"value", "id", "val"} and states <= SCALAR - {"range_text"}:
        return "boxed"
    if children and states <= {"text", "number_text", "range_text", "null"}:
        return "labels"
    return "object"


def state_of(v: Any) -> str:
    """The automaton: a state per value, from the states of its children, without recursion."""
    if not isinstance(v, (dict, list)):
        return leaf_state(v)
    done: dict[int, str] = {}
    stack = [(v, False)]
    while stack:
        x, children_done = stack.pop()
        if not children_done:
            stack.append((x, True))
            stack += [(c, False) for c in (x.values() if isinstance(x, dict) else x) if isinstance(c, (dict, list))]
            continue
        state = lambda c: done[id(c)] if isinstance(c, (dict, list)) else leaf_state(c)
        done[id(x)] = object_state({k: state(c) for k, c in x.items()}) if isinstance(x, dict) else array_state([state(c) for c in x], x)
    return done[id(v)]


Row = tuple[str, str, str, str, Any]
#: What a reader gives: the child's key (None: the one of the route) and its value.
Read = Iterator[tuple[str | None, Any]]


def as_it_is(v: Any) -> Read:
    yield None, v


def unboxed(v: Any) -> Read:
    yield None, next(iter(v.values()))


def two_ends(v: Any) -> Read:
    yield from zip(("min", "max"), v)


def bounds(v: Any) -> Read:
    yield from ((k, v.get(k)) for k in ("min", "max"))


def ends_in_text(v: Any) -> Read:
    yield from zip(("min", "max"), RANGE_TEXT.match(v).groups())


def both_ends(v: Any) -> Read:
    yield from (("min", v), ("max", v))


def members(v: Any) -> Read:
    yield from v.items()


def english(v: Any) -> Read:
    yield "English", v


RANGES = {"pair": two_ends, "bounds": bounds, "range_text": ends_in_text, "number": both_ends, "number_text": both_ends}
LABELS = {s: members for s in ("labels", "object", "bounds", "boxed")} | {s: english for s in SCALAR - {"null"}}
SCALARS = {s: as_it_is for s in SCALAR - {"null"}} | {"boxed": unboxed}
#: Where a value goes: (what its parent is, symbol of its label) -> (supertype table, state -> reader).
#: A state that isn't listed has no place there.
ROUTES: dict[tuple[str, str], tuple[str, dict[str, Callable[[Any], Read]]]] = {
    ("boss", "names"): ("boss_name", LABELS),
    ("boss", "cp"): ("boss_cp", RANGES),
    ("boss", "boosted_cp"): ("boss_cp", RANGES),
    ("weather", "label_of"): ("weather_name", LABELS),
    ("type", "weather"): ("weather_name", {s: english for s in SCALAR - {"null"}}),
    **{("stats", s): ("mega_stat", SCALARS) for s in STAT_WORDS},
}
#: Type of the values of each supertype table and so of all its subtypes.
VALUE_TYPES = {"boss": "string", "boss_name": "string", "boss_cp": "bigint", "weather_name": "string", "mega_stat": "bigint"}


def routed(parent: str, holder: dict, parent_key: str) -> Iterator[Row]:
    """Rows of all members of an object that have a route from `parent`."""
    for label, v in holder.items():
        for symbol in symbols_of(label):
            table, readers = ROUTES.get((parent, symbol), (None, {}))
            if table is None:
                continue
            state = state_of(v)
            for child, x in readers[state](v) if state in readers else ():
                if x is not None:
                    if symbol in ("cp", "boosted_cp"):
                        child = f"boosted_{child}" if symbol == "boosted_cp" else child
                    yield table, f"{table}_{state}", parent_key, symbol if child is None else child, x


def shape_of(boss: dict) -> str:
    """The structural variant of a boss: which of its fields hold objects or arrays."""
    return "boss_" + "_".join(sorted(k for k, v in boss.items() if isinstance(v, (dict, list))))


def raid_file(doc: Any) -> Iterator[Row]:
    """Bosses, their names and CP bounds of a raid file."""
    for label, tiers in doc.items() if isinstance(doc, dict) else ():
        if "tiers" not in symbols_of(label) or not isinstance(tiers, dict):
            continue
        for tier, bosses in tiers.items():
            for i, boss in enumerate(bosses if isinstance(bosses, list) else ()):
                if isinstance(boss, dict):
                    yield "boss", shape_of(boss), tier, str(i), boss.get("id")
                    yield from routed("boss", boss, f"{tier}/{i}")


def type_file(doc: Any) -> Iterator[Row]:
    """Names of the weather that boosts each type."""
    for record in doc if isinstance(doc, list) else ():
        if isinstance(record, dict):
            key = str(record.get("type"))
            for label, v in record.items():
                if isinstance(v, dict) and "weather" in symbols_of(label):
                    yield from routed("weather", v, key)
            yield from routed("type", record, key)


def mega_file(doc: Any) -> Iterator[Row]:
    """Base stats of each mega record, nested under stats or beside it."""
    for i, record in enumerate(doc if isinstance(doc, list) else ()):
        if isinstance(record, dict):
            nested = [v for k, v in record.items() if isinstance(v, dict) and "stats" in symbols_of(k)]
            for group in nested or [record]:
                yield from routed("stats", group, str(i))


#: What the root of a file is, by its endpoint.
FILES: dict[str, Callable[[Any], Iterator[Row]]] = {"raidboss": raid_file, "types": type_file, "mega_pokemon": mega_file}


def as_number(v: Any) -> float | None:
    if isinstance(v, bool) or v is None or isinstance(v, (list, dict)):
        return None
    try:
        return float(v)
    except (ValueError, OverflowError):
        return None


def flatten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(payload_id, endpoint, payload) to rows of all subtype tables."""
    names = [x.split()[0] for x in ROW_SCHEMA.split(", ")]
    types = [pa.int64(), *[pa.string()] * 5, pa.float64()]
    for batch in batches:
        out = []
        for pid, endpoint, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            route = FILES.get((endpoint or "").strip().lower())
            try:
                doc = parse_json(text) if route else None
            except ValueError:
                continue
            if route:
                # a field may appear under two names in one record; the first one given counts
                seen = set()
                for kind, variant, parent, child, v in route(doc):
                    if (kind, parent, child) not in seen:
                        seen.add((kind, parent, child))
                        shown = v if isinstance(v, str) else None if v is None else json_text(v)
                        out.append((pid, kind, variant, parent, child, shown, as_number(v)))
        columns = zip(*out) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def nested_tables(payloads: DataFrame) -> DataFrame:
    """Rows (payload_id, child_kind, variant, parent_key, child_key, text_value, number_value).

    One map over (payload_id, endpoint, payload), without any shuffle. Payloads that don't parse, are
    null or belong to an unknown endpoint give nothing; optional parts that are missing or null give
    no row. Use `subtype` for one of the flat tables.
    """
    return payloads.select("payload_id", "endpoint", "payload").mapInArrow(flatten, ROW_SCHEMA)


def supertype(rows: DataFrame, child_kind: str) -> DataFrame:
    """(payload_id, parent_key, child_key, variant, value): one flat table with its value in its type.

    A value that isn't of the type (a text among numbers) is null.
    """
    kept = rows.filter(F.col("child_kind") == child_kind)
    value = F.col("text_value") if VALUE_TYPES[child_kind] == "string" else F.col("number_value").try_cast(VALUE_TYPES[child_kind])
    return kept.select("payload_id", "parent_key", "child_key", "variant", value.alias("value"))


def subtype(rows: DataFrame, child_kind: str, variant: str) -> DataFrame:
    """The typed table of one structural variant; its keys are those of its supertype table."""
    return supertype(rows, child_kind).filter(F.col("variant") == variant).drop("variant")


def subtype_tables(rows: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Every subtype as a typed table of its own, written under `folder` in one pass and read from there.

    The variants are as many as the readers of the routing table and the shapes of bosses.
    """
    out = {}
    for kind in VALUE_TYPES:
        supertype(rows, kind).write.mode("overwrite").partitionBy("variant").parquet(f"{folder}/{kind}")
        spark = rows.sparkSession
        try:
            table = spark.read.parquet(f"{folder}/{kind}")
        except AnalysisException:  # no row of this kind
            continue
        for r in table.select("variant").distinct().collect():
            out[r.variant] = table.filter(F.col("variant") == r.variant).drop("variant")
    return out
