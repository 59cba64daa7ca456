"""Schemas that drift between files: changes per file, and one consistent table of all files.

Deliveries are range-partitioned by mirror, endpoint and snapshot, so a task reads consecutive files and
holds two of them. Each file is profiled into a record per field: types, counts, and, for fields that
come or go, sketches of their values. Removed and added fields of one parent are matched by the best
bipartite assignment over value and name similarity.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.operators.skew import carry_forward, salted_join
from quorumlake.operators.variants import json_text, parse_json, remembered
from quorumlake.session import cut

#: Size of a value sketch: the smallest hashes of the smaller of two sets, and the other set's up to
#: the same hash.
SKETCH_SIZE = 256
#: Least score of a rename, and the share of value similarity in it.
RENAME_SCORE, VALUE_SHARE = 0.5, 0.7
#: Pairs whose score by sketches is this far below a rename's, or better, are compared value by value.
UNDECIDED = 0.2


def json_type(v: Any) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    return {int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(v)]


@remembered
def is_data_map(field: str) -> bool:
    """Objects whose keys are data: names, and counter by either of its names."""
    return re.sub(r"[^a-z]", "", field.lower()) in ("names", "counter", "counters")


def value_hash(v: Any) -> int:
    """Hash of a value by its JSON text; only hashes of one process are compared."""
    return hash(v) if isinstance(v, str) else hash(("json", json_text(v)))


def record_groups(endpoint: str, doc: Any) -> Iterator[tuple[str, str, list[dict]]]:
    """(path prefix, prefix with the tier left open, records) of a file."""
    if endpoint == "raidboss":
        tiers = doc.get("currentList") if isinstance(doc, dict) else None
        for tier, records in (tiers.items() if isinstance(tiers, dict) else ()):
            records = [r for r in records if isinstance(r, dict)] if isinstance(records, list) else []
            if records:
                yield f"currentList.{tier}", "currentList.*", records
    elif isinstance(doc, list):
        yield "", "", [r for r in doc if isinstance(r, dict)]
    elif isinstance(doc, dict):
        yield "", "", [doc]


class Field:
    """Profile of one field of a file: where it stands, its types, and the values of its records."""

    def __init__(self, parent: str, field: str, pooled: str) -> None:
        self.parent, self.field, self.pooled = parent, field, pooled
        self.path = f"{parent}.{field}" if parent else field
        self.types: set[str] = set()
        self.values: list[tuple[int, Any]] = []  # (number of the record, value that isn't null)
        self.hashed: dict[str, set[int]] = {}

    @property
    def filled(self) -> int:
        return len(self.values)


class File:
    """A profiled file: its fields by path, and what may identify its records."""

    def __init__(self, endpoint: str, doc: Any) -> None:
        self.fields: dict[str, Field] = {}
        self.records: list[dict] = []
        for prefix, pooled_prefix, records in record_groups(endpoint, doc):
            for r in records:
                number = len(self.records)
                self.records.append(r)
                stack = [(prefix, pooled_prefix, r)]
                while stack:
                    parent, pooled, holder = stack.pop()
                    for k, v in holder.items():
                        path = f"{parent}.{k}" if parent else k
                        f = self.fields.get(path)
                        if f is None:
                            f = self.fields[path] = Field(parent, k, pooled)
                        if v is None:
                            continue
                        f.types.add(json_type(v))
                        f.values.append((number, v))
                        if isinstance(v, dict) and not is_data_map(k):
                            stack.append((path, f"{pooled}.{k}" if pooled else k, v))
        self._identities: set[str] | None = None
        self._who: dict[str, list[int]] = {}

    def identities(self) -> set[str]:
        """Text or number fields that every record has and that tell at least every other one apart."""
        if self._identities is None:
            shared = set.intersection(*(set(r) for r in self.records)) if self.records else set()
            scalar = lambda v: isinstance(v, (str, int, float)) and not isinstance(v, bool)
            self._identities = {
                f for f in shared if all(scalar(r[f]) for r in self.records) and 2 * len({value_hash(r[f]) for r in self.records}) >= len(self.records)
            }
        return self._identities

    def values_of(self, f: Field, identity: str | None) -> set[int]:
        """Hashes of a field's values, each with its record's identity if one is given."""
        key = identity or ""
        if key not in f.hashed:
            if identity is None:
                f.hashed[key] = {value_hash(v) for _, v in f.values}
            else:
                if identity not in self._who:
                    self._who[identity] = [value_hash(r[identity]) for r in self.records]
                who = self._who[identity]
                f.hashed[key] = {hash((who[n], value_hash(v))) for n, v in f.values}
        return f.hashed[key]


def common(a: set[int], b: set[int], exact: bool) -> float:
    """How many values two sets share. By sketches: the smaller set's SKETCH_SIZE smallest hashes, and of
    the other set all up to the largest of them, so that both are complete below one threshold."""
    if len(b) < len(a):
        a, b = b, a
    if exact or len(a) <= SKETCH_SIZE:
        return len(a & b)
    sketch = heapq.nsmallest(SKETCH_SIZE, a)
    return sum(h in b for h in sketch) / SKETCH_SIZE * len(a)


def value_similarity(pairs: list[tuple[Field, Field]], before: File, after: File, exact: bool = False) -> float:
    """How far the values carry over, over all places in which the pair of fields occurs.

    By record wherever both files have an identity field in common; else by the plain values.
    """
    names = sorted(before.identities() & after.identities()) or [None]
    shared = total = 0.0
    for old, new in pairs:
        sides = [(before.values_of(old, n), after.values_of(new, n)) for n in names]
        best = max((common(a, b, exact), min(len(a), len(b))) for a, b in sides)
        shared, total = shared + best[0], total + best[1]
    return shared / total if total else 0.0


def rename_score(old: Field, new: Field, value: float) -> float:
    """Value and name similarity together; names equal but for case and separators are enough if the types are equal."""
    name = name_similarity(old.field, new.field)
    score = VALUE_SHARE * value + (1 - VALUE_SHARE) * name
    same_types = old.types == new.types or not (old.filled and new.filled)
    return max(score, RENAME_SCORE) if name == 1 and same_types else score


def assign(score: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the largest sum of scores.

    Shortest augmenting paths with potentials, cubic in the number of fields of one parent.
    """
    if not score or not score[0]:
        return []
    n, m = len(score), len(score[0])
    if n > m:
        return [(i, j) for j, i in assign([list(c) for c in zip(*score)])]
    inf = float("inf")
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, used = [inf] * (m + 1), [False] * (m + 1)
        while True:
            used[j] = True
            row, delta, nxt = match[j], inf, 0
            for k in range(1, m + 1):
                if not used[k]:
                    cost = -score[row - 1][k - 1] - u[row] - v[k]
                    if cost < least[k]:
                        least[k], way[k] = cost, j
                    if least[k] < delta:
                        delta, nxt = least[k], k
            for k in range(m + 1):
                if used[k]:
                    u[match[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    return [(match[k] - 1, k - 1) for k in range(1, m + 1) if match[k]]


def name_similarity(a: str, b: str) -> float:
    """1 for names equal but for case and separators, else the ratio of matching characters."""
    x, y = (re.sub(r"[^a-z0-9]", "", s.lower()) for s in (a, b))
    return SequenceMatcher(None, x, y, autojunk=False).ratio()


def compare(before: File, after: File) -> list[tuple[str, str, str]]:
    """(field_path, change_kind, new_path) between two profiled files."""

    def tiers(fields: dict[str, Field]) -> set[str]:
        return {".".join(p.split(".")[:2]) for p, f in fields.items() if f.pooled.startswith("currentList.*")}

    old, new = before.fields, after.fields
    skipped = tiers(old) ^ tiers(new)
    keep = lambda fields: {p: f for p, f in fields.items() if ".".join(p.split(".")[:2]) not in skipped}
    old, new = keep(old), keep(new)
    children: dict[str, set[str]] = defaultdict(set)
    for fields in (old, new):
        for f in fields.values():
            children[f.parent].add(f.path)
    roots = {p for p in children if p == "" or re.fullmatch(r"currentList\.[^.]*", p)}
    # top-down, level by level; a reported or empty field closes everything below it
    level, gone_at, changes = sorted(roots), {}, []
    while level:
        gone: dict[str, tuple[list, list]] = {}
        deeper = []
        for parent in level:
            gone[parent] = ([], [])
            for path in sorted(children[parent]):
                a, b = old.get(path), new.get(path)
                if a is None or b is None:
                    gone[parent][0 if b is None else 1].append(path)
                elif a.filled and b.filled:
                    if a.types != b.types:
                        changes.append((path, "retyped", ""))
                    elif path in children:
                        deeper.append(path)
        gone_at |= gone
        level = deeper
    # evidence for a pair of names is pooled over the tiers of one file
    evidence: dict[tuple, list] = defaultdict(list)
    for removed, added in gone_at.values():
        for r in removed:
            for a in added:
                evidence[old[r].pooled, old[r].field, new[a].field].append((old[r], new[a]))
    for removed, added in gone_at.values():
        scores = []
        for r in removed:
            row = []
            for a in added:
                pairs = evidence[old[r].pooled, old[r].field, new[a].field]
                score = rename_score(old[r], new[a], value_similarity(pairs, before, after))
                if score >= RENAME_SCORE - UNDECIDED:
                    score = rename_score(old[r], new[a], value_similarity(pairs, before, after, exact=True))
                row.append(score)
            scores.append(row)
        renamed = {removed[i]: added[j] for i, j in assign(scores) if scores[i][j] >= RENAME_SCORE}
        for r in removed:
            changes.append((r, "renamed", renamed[r]) if r in renamed else (r, "removed", ""))
        changes += [(a, "added", "") for a in added if a not in renamed.values()]
    return changes


CHANGE_SCHEMA = "payload_id bigint, field_path string, change_kind string, new_path string, pooled string, mirror string, endpoint string, snapshot {t}"
#: Changes and, with a place in `edge`, the first and the last file of a range.
RANGE_SCHEMA = CHANGE_SCHEMA + ", edge int, payload string"


def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose last column, a JSON text, parses."""
    for batch in batches:
        keep = []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            try:
                parse_json(text)
                keep.append(True)
            except ValueError:
                keep.append(False)
        yield batch.filter(pa.array(keep, pa.bool_()))


def change_rows(before: File, after: File, payload_id: int, series: tuple) -> list[tuple]:
    pooled = lambda path: (before.fields.get(path) or after.fields[path]).pooled
    return [(payload_id, *c, pooled(c[0]), *series) for c in compare(before, after)]


def compare_range(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(payload_id, mirror, endpoint, snapshot, payload) in the order of deliveries: the changes of every
    file against the one before it in this range, and the range's first and last file."""
    last: tuple | None = None
    before: File | None = None
    for batch in batches:
        kind, out = batch.schema.field(3).type, []
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            pid, mirror, endpoint, snapshot, payload = row
            file = File(endpoint, parse_json(payload))
            if last is None:
                out.append((pid, *[None] * 4, mirror, endpoint, snapshot, 0, payload))
            elif last[1:3] == (mirror, endpoint):
                out += [(*c, None, None) for c in change_rows(before, file, pid, row[1:4])]
            last, before = row, file
        yield range_batch(out, kind)
    if last is not None:
        yield range_batch([(last[0], *[None] * 4, *last[1:4], 1, last[4])], kind)


def range_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [pa.int64(), *[pa.string()] * 6, kind, pa.int32(), pa.string()]
    names = [x.split()[0] for x in RANGE_SCHEMA.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def compare_edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for files beside the borders of ranges: (payload_id, mirror, endpoint, snapshot, payload, before)."""
    for batch in batches:
        out = []
        for *row, before in zip(*(batch.column(i).to_pylist() for i in range(6))):
            files = [File(row[2], parse_json(x)) for x in (before, row[4])]
            out += [(*c, None, None) for c in change_rows(*files, row[0], tuple(row[1:4]))]
        yield range_batch(out, batch.schema.field(3).type)


def schema_changes(files: DataFrame) -> DataFrame:
    """(payload_id, field_path, change_kind, new_path, pooled, mirror, endpoint, snapshot) between
    consecutive deliveries.

    files: payload_id, mirror, endpoint, snapshot, payload. Files that don't parse are skipped; of
    several of one snapshot the lowest payload_id counts (found by an aggregate that combines before it
    shuffles, as repeats may be many). The first delivery of a mirror and endpoint reports nothing.
    Rows with a null id, mirror, endpoint or snapshot are no delivery. One mirror and endpoint may span
    many ranges; of each range only its first and last file travel to meet their neighbours.
    """
    keys = ["mirror", "endpoint", "snapshot"]
    files = files.select("payload_id", *keys, "payload").dropna(subset=["payload_id", *keys])
    kind = dict(files.dtypes)["snapshot"]
    good = files.mapInArrow(parsed, files.schema)
    deliveries = cut(
        good.groupBy(*keys)
        .agg(F.min(F.struct("payload_id", "payload")).alias("_f"))
        .select("_f.payload_id", *keys, "_f.payload")
    )
    schema = RANGE_SCHEMA.format(t=kind)
    ranges = cut(deliveries.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(compare_range, schema))
    # a series that crosses a border has the last file of one range right before the first of the next
    by_time = Window.partitionBy("mirror", "endpoint").orderBy("snapshot", "edge")
    edges = ranges.filter("edge is not null").withColumn("before", F.lag("payload").over(by_time))
    met = edges.filter("edge = 0 and before is not null").select("payload_id", *keys, "payload", "before").mapInArrow(compare_edges, schema)
    return ranges.filter("edge is null").drop("edge", "payload").unionByName(met.drop("edge", "payload"))


# ---- one table of all files ---------------------------------------------------------------------

NAMES_SCHEMA = "mirror string, endpoint string, snapshot {t}, names string"


def follow_names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Renames and additions of fields, in the order of series and time, to the names in use after each
    snapshot: a JSON object of [pooled parent, field] texts to canonical names.

    A column keeps the first name it had. A field that appears under a name which a renamed column
    carries on as its canonical one is another column and is called `name@snapshot`.
    """
    series = moment = None
    live: dict[tuple[str, str], str] = {}
    renamed: dict[tuple[str, str], str] = {}  # (parent, new name) -> old name, of one snapshot
    added: set[tuple[str, str]] = set()
    out: list[tuple] = []

    def close() -> None:
        if moment is None or not (renamed or added):
            return
        old = dict(live)
        for parent, name in set(renamed) | {(p, o) for (p, _), o in renamed.items()}:
            live.pop((parent, name), None)
        for (parent, name), before in renamed.items():
            live[parent, name] = old.get((parent, before), before)
        taken = {(p, c) for (p, n), c in live.items() if n != c}
        for parent, name in added - set(renamed):
            if (parent, name) not in live and (parent, name) in taken:
                live[parent, name] = f"{name}@{moment}"
        out.append((*series, moment, json.dumps({PART.join(k): c for k, c in sorted(live.items()) if k[1] != c}, ensure_ascii=False)))

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        columns = zip(*out) if out else [[]] * 4
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), kind, pa.string()])], names=["mirror", "endpoint", "snapshot", "names"])
        out.clear()
        return batch

    kind = pa.timestamp("us")
    for batch in batches:
        kind = batch.schema.field(2).type
        for mirror, endpoint, at, pooled, change, a, b in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if (series, moment) != ((mirror, endpoint), at):
                close()
                renamed.clear()
                added.clear()
                if series != (mirror, endpoint):
                    live.clear()
                series, moment = (mirror, endpoint), at
            if change == "renamed":
                renamed.setdefault((pooled, b), a)
            else:
                added.add((pooled, a))
        yield flush(kind)
    close()
    yield flush(kind)


#: What parts a parent from a field in the keys of names.
PART = "\x1f"


def name_versions(changes: DataFrame) -> DataFrame:
    """(mirror, endpoint, snapshot, names): the canonical names of fields from each rename on.

    A rename holds for its own mirror and endpoint and from its file on. A series' changes pass through
    one task as a stream that holds the names in use only.
    """
    leaf = lambda c: F.element_at(F.split(c, r"\."), -1)
    keys = ["mirror", "endpoint", "snapshot"]
    events = changes.filter("change_kind in ('renamed', 'added')").select(*keys, "pooled", "change_kind", leaf("field_path").alias("a"), leaf("new_path").alias("b")).distinct()
    ordered = events.repartition("mirror", "endpoint").sortWithinPartitions(*keys, "pooled", "change_kind", "a", "b")
    return ordered.mapInArrow(follow_names, NAMES_SCHEMA.format(t=dict(changes.dtypes)["snapshot"]))


def record_rows(endpoint: str, doc: Any, names: dict[tuple[str, str], str]) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(record_key, field, json_type, text) of every field of every record under its canonical name.

    Should two fields of one object have one canonical name, the second keeps its own.
    """
    for prefix, pooled_prefix, records in record_groups(endpoint, doc):
        for i, r in enumerate(records):
            key = f"{prefix}/{i}" if prefix else str(i)
            stack = [("", pooled_prefix, r)]
            while stack:
                shown, pooled, holder = stack.pop()
                used = {k for k in holder if names.get((pooled, k), k) == k}
                for k, v in holder.items():
                    name = names.get((pooled, k), k)
                    if name != k:
                        while name in used:
                            name = f"{name}@{k}" if name != k else f"{name}@"
                        used.add(name)
                    path = f"{shown}.{name}" if shown else name
                    if isinstance(v, dict) and not is_data_map(k):
                        stack.append((path, f"{pooled}.{k}" if pooled else k, v))
                    else:
                        yield key, path, json_type(v), v if isinstance(v, str) or v is None else json_text(v)


def unify(batches: Iterable[pa.RecordBatch], counted: bool) -> Iterator[pa.RecordBatch]:
    """(payload_id, endpoint, payload, names) to records' fields, or to counts of (endpoint, field, json_type)."""
    columns = ["endpoint", "field", "json_type", "n"] if counted else ["payload_id", "endpoint", "record_key", "field", "json_type", "value"]
    types = [*[pa.string()] * 3, pa.int64()] if counted else [pa.int64(), *[pa.string()] * 5]
    for batch in batches:
        out: list[tuple] = []
        counts: dict[tuple, int] = defaultdict(int)
        for pid, endpoint, payload, names in zip(*(batch.column(i).to_pylist() for i in range(4))):
            try:
                doc = parse_json(payload)
            except ValueError:
                continue
            known = {tuple(k.split(PART)): c for k, c in json.loads(names).items()} if names else {}
            for row in record_rows(endpoint or "", doc, known):
                if counted:
                    if row[2] is not None:
                        counts[endpoint, row[1], row[2]] += 1
                else:
                    out.append((pid, endpoint, *row))
        out = out or [(*k, n) for k, n in counts.items()]
        cells = zip(*out) if out else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=columns)


#: Tables of field types up to so many rows are sent to every executor.
MOST_FIELDS = 50_000


def unified_records(files: DataFrame, names: DataFrame) -> DataFrame:
    """One consistent table of all files: (payload_id, endpoint, record_key, field, json_type,
    unified_type, value, misfit), a row per record and field.

    Fields have their canonical names (`name_versions`) as of the file's snapshot, nested ones with dots;
    arrays and maps of data are JSON text; record_key is the record's place in the file. A field of an
    endpoint has one type, the one most of its values have (the first by name of equals); value is the
    text of a value in that type. Numbers and booleans fit a text field, texts of numbers a number field;
    what doesn't fit has a null value and is a misfit. Files that don't parse give nothing.
    """
    keys = ["mirror", "endpoint", "snapshot"]
    seen = files.select(*keys).dropna().distinct().withColumn("names", F.lit(None).cast("string")).withColumn("_file", F.lit(1))
    events = names.select(*keys, "names", F.lit(0).alias("_file"))
    named = carry_forward(seen.unionByName(events), ["mirror", "endpoint"], ["snapshot", "_file"], "names", "_names")
    named = named.filter("_file = 1 and _names is not null").select(*keys, "_names")
    placed = salted_join(files, named, keys, F.col("payload_id"), "left").select("payload_id", "endpoint", "payload", "_names")
    rows = placed.mapInArrow(lambda b: unify(b, False), "payload_id bigint, endpoint string, record_key string, field string, json_type string, value string")
    counts = placed.mapInArrow(lambda b: unify(b, True), "endpoint string, field string, json_type string, n bigint")
    of_type = counts.groupBy("endpoint", "field", "json_type").agg(F.sum("n").alias("n"))
    types = cut(of_type.groupBy("endpoint", "field").agg(F.max_by("json_type", F.struct("n", F.col("json_type"))).alias("unified_type")))
    if types.count() <= MOST_FIELDS:
        typed = rows.join(F.broadcast(types), ["endpoint", "field"], "left")
    else:
        typed = salted_join(rows, types, ["endpoint", "field"], F.struct("payload_id", "record_key"), "left")
    same = F.col("json_type") == F.col("unified_type")
    number = F.trim("value").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,4})?$")
    fits = same | ((F.col("unified_type") == "string") & F.col("json_type").isin("number", "boolean"))
    fits = fits | ((F.col("unified_type") == "number") & (F.col("json_type") == "string") & number)
    text = F.when(same, F.col("value")).otherwise(F.trim("value"))
    misfit = F.col("json_type").isNotNull() & ~fits
    return typed.select("payload_id", "endpoint", "record_key", "field", "json_type", "unified_type", F.when(~misfit, text).alias("value"), misfit.alias("misfit"))
