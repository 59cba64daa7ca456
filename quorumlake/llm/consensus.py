"""Best representative of each duplicate group: token-level consensus by progressive alignment.

The tokens of a group's distinct values are aligned one value after the other into a profile of
columns; every value votes in each column with its weight, and the existing value closest to the
winning tokens survives. Profiles merge like values do, so a group of many values is aligned in parts
first and no task holds a whole group.

Weights are lists of numbers that add up place by place and compare place by place, the first first:
with one place many weak claims can outvote a strong one; with two, claims that count in the first place
outweigh all others together, whose votes then only decide where the first place is even.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.skew import salted_join, salts_of
from quorumlake.session import cut

GAP = ""
#: Alignment scores: equal winners, a shared token, nothing shared, and a column against nothing.
EQUAL, SHARED, OTHER, SKIP = 1.0, 0.25, -0.6, -0.4
#: Distinct values that one part of a group has, about; profiles that are merged at a time.
PART_VALUES, MERGED = 1_000, 64

Weight = list[float]
Profile = list[dict[str, Weight]]


def tokens_of(value: str) -> list[str]:
    """Words and numbers, every other sign by itself."""
    return re.findall(r"[^\W_]+(?:[.,]\d+)*|[^\w\s]|_", value)


def add(a: Weight | None, b: Weight | None) -> Weight:
    if a is None or b is None:
        return b if a is None else a
    return [x + y for x, y in zip(a, b)]


def winner(column: dict[str, Weight]) -> str:
    """The token with most weight; ties go to the smallest token."""
    if len(column) == 1:
        return next(iter(column))
    return min(column, key=lambda t: ([-x for x in column[t]], t))


def merge(a: Profile, wa: Weight, b: Profile, wb: Weight) -> Profile:
    """Needleman-Wunsch over the columns of two profiles of total weights wa and wb."""
    top_a, top_b = [winner(c) for c in a], [winner(c) for c in b]
    n, m = len(a), len(b)
    keys_a, keys_b = [c.keys() - {GAP} for c in a], [c.keys() - {GAP} for c in b]

    def fit(i: int, j: int) -> float:
        return EQUAL if top_a[i] == top_b[j] else SHARED if not keys_a[i].isdisjoint(keys_b[j]) else OTHER

    best = [[SKIP * j for j in range(m + 1)]]
    for i in range(1, n + 1):
        row, above = [SKIP * i], best[-1]
        for j in range(1, m + 1):
            row.append(max(above[j - 1] + fit(i - 1, j - 1), above[j] + SKIP, row[-1] + SKIP))
        best.append(row)
    out: Profile = []
    i, j = n, m
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + fit(i - 1, j - 1):
            i, j = i - 1, j - 1
            out.append({t: add(a[i].get(t), b[j].get(t)) for t in a[i].keys() | b[j].keys()})
        elif i and best[i][j] == best[i - 1][j] + SKIP:
            i -= 1
            out.append(a[i] | {GAP: add(a[i].get(GAP), wb)})
        else:
            j -= 1
            out.append(b[j] | {GAP: add(b[j].get(GAP), wa)})
    out.reverse()
    return out


def fold(parts: Iterable[tuple[Weight, Profile]]) -> tuple[Weight, Profile]:
    """All profiles merged one after the other, the heaviest first."""
    ordered = sorted(parts, key=lambda x: ([-v for v in x[0]], json.dumps(x[1], sort_keys=True)))
    total, profile = ordered[0]
    for w, p in ordered[1:]:
        profile = merge(profile, total, p, w)
        total = add(total, w)
    return total, profile


def consensus_of(profile: Profile) -> list[str]:
    return [t for t in map(winner, profile) if t != GAP]


def edit_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ordered(v: Any) -> Any:
    """A value that compares like SQL's: null first, structs field by field."""
    return tuple(ordered(x) for x in v.values()) if isinstance(v, dict) else (v is not None, v)


def best_representatives(
    claims: DataFrame, keys: list[str], weight: list[Column], order: list[Column], id_column: str, eligible: Column | None = None, part_values: int = PART_VALUES
) -> DataFrame:
    """keys, value, consensus, n_values, distance and the id of the surviving claim, one row per group.

    claims: keys, `value` and the columns that weight, order and eligible use. weight: numbers, compared
    in the order given, added up over the claims of a value. Among the values that are eligible for any of
    their claims (all without `eligible`; if none is, all are), those closest to the consensus survive; among equals,
    and among the claims of one value, the smallest `order` does. Rows with a null value or key don't
    compete; groups without any value give no row; repeated rows are claims like any other, so remove
    them before if they should count once. A group of up to `part_values` values is decided in one
    task, a larger one in parts whose profiles merge.
    """
    places = [f"_w{i}" for i in range(len(weight))]
    values = (
        claims.dropna(subset=[*keys, "value"])
        .groupBy(*keys, "value")
        .agg(
            *[F.sum(w.cast("double")).alias(p) for w, p in zip(weight, places)],
            F.max(F.lit(True) if eligible is None else eligible).alias("_ok"),
            F.min(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.col(id_column).alias("_id"))).alias("_best"),
        )
    )
    values = cut(values)
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    spread = salted_join(values, sizes, keys, F.col("value"))
    parts = F.ceil(F.col("_n") / F.lit(part_values)).cast("bigint")
    spread = spread.withColumn("_part", F.pmod(F.xxhash64("value"), parts)).withColumn("_parts", parts)
    names = [*keys, "_n", "_part", "_parts", "value", "_ok", "_best", *places]
    # by work, not by size: a number of partitions given is kept as it is
    spread = spread.select(*names).repartition(salts_of(claims), *keys, "_part").sortWithinPartitions(*keys, "_part", "value")
    schema = ", ".join(f"`{k}` {t}" for k, t in values.select(*keys).dtypes)
    id_type = dict(claims.dtypes)[id_column]
    schema += f", _n bigint, _part bigint, value string, consensus string, distance bigint, `{id_column}` {id_type}, _w string, _profile string"
    out_names = [*keys, "_n", "_part", "value", "consensus", "distance", id_column, "_w", "_profile"]
    k = len(keys)

    def batch_of(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
        best = like.field("_best").type
        types = [*[like.field(x).type for x in keys], pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), best.field(best.num_fields - 1).type, pa.string(), pa.string()]
        columns = zip(*rows) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=out_names)

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of groups to profiles, and groups of one part to their survivors."""

        def rows() -> Iterator[tuple]:
            for b in batches:
                like[0] = b.schema
                yield from zip(*(c.to_pylist() for c in b.columns))

        like: list[pa.Schema] = [None]
        out = []
        for key, group in groupby(rows(), lambda r: r[: k + 3]):
            group = list(group)
            *own, n, part, n_parts = key
            if len(group) == 1 and n_parts == 1:
                value, best = group[0][k + 3], group[0][k + 5]
                out.append((*own, n, 0, value, " ".join(tokens_of(value)), 0, best["_id"], None, None))
            else:
                total, profile = fold([(list(r[k + 6 :]), [{t: list(r[k + 6 :])} for t in tokens_of(r[k + 3])]) for r in group])
                if n_parts > 1:
                    out.append((*own, n, part, None, None, None, None, json.dumps(total), json.dumps(profile)))
                else:
                    top = consensus_of(profile)
                    far = [edit_distance(tokens_of(r[k + 3]), top) for r in group]
                    at = min(range(len(group)), key=lambda i: (not group[i][k + 4], far[i], ordered(group[i][k + 5]), group[i][k + 3]))  # noqa: B023
                    out.append((*own, n, 0, group[at][k + 3], " ".join(top), far[at], group[at][k + 5]["_id"], None, None))
            if len(out) >= 5_000:
                yield batch_of(out, like[0])
                out = []
        if like[0] is not None:
            yield batch_of(out, like[0])

    decided = cut(spread.mapInArrow(decide, schema))
    done = decided.filter("_profile is null").select(*keys, "value", "consensus", F.col("_n").alias("n_values"), "distance", id_column)
    profiles = decided.filter("_profile is not null").select(*keys, "_part", "_w", "_profile")
    if profiles.isEmpty():
        return done

    # the parts of large groups, merged in rounds of a few at a time
    profile_schema = ", ".join(f"`{x}` {t}" for x, t in profiles.dtypes)

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema_of: list[pa.Schema] = [None]

        def rows() -> Iterator[tuple]:
            for b in batches:
                schema_of[0] = b.schema
                yield from zip(*(c.to_pylist() for c in b.columns))

        for key, group in groupby(rows(), lambda r: r[: k + 1]):
            total, profile = fold([(json.loads(r[k + 1]), json.loads(r[k + 2])) for r in group])
            cells = [*key, json.dumps(total), json.dumps(profile)]
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema_of[0])], names=schema_of[0].names)

    most = sizes.agg(F.max("_n")).first()[0] / part_values
    while most > 1:
        most = most / MERGED
        grouped = profiles.withColumn("_part", F.floor(F.col("_part") / MERGED))
        grouped = grouped.repartition(salts_of(claims), *keys, "_part").sortWithinPartitions(*keys, "_part")
        profiles = cut(grouped.mapInArrow(combine, profile_schema))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, distances = [], []
            for v, p in zip(b.column(b.schema.get_field_index("value")).to_pylist(), b.column(b.schema.get_field_index("_profile")).to_pylist()):
                top = consensus_of(json.loads(p))
                texts.append(" ".join(top))
                distances.append(edit_distance(tokens_of(v), top))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(texts, pa.string()), pa.array(distances, pa.int64())], names=[*b.schema.names, "consensus", "distance"]
            )

    rows = salted_join(values.join(sizes.filter(F.col("_n") > part_values), keys, "left_semi"), profiles.select(*keys, "_profile"), keys, F.col("value"))
    rows = rows.select(*keys, "value", "_ok", "_best", "_profile")
    near = rows.mapInArrow(measure, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", consensus string, distance bigint")
    chosen = near.groupBy(*keys).agg(F.min(F.struct(~F.col("_ok"), "distance", "_best", "value", "consensus")).alias("_c"), F.count(F.lit(1)).alias("n_values"))
    large = chosen.select(*keys, "_c.value", "_c.consensus", "n_values", "_c.distance", F.col("_c._best._id").alias(id_column))
    return done.unionByName(large)
