"""Filling fixed-capacity sequences with texts: linear grouping, few-size configurations, best fit.

Lengths are integers up to the capacity, so the whole input is known from a histogram of at most
`capacity` rows. The plan is computed on it in runs (so many texts of one length, from one rank
on, go into so many sequences), and each text finds its sequence from its length and its rank among
the texts of that length: one join with a table bounded by the capacity, not by the corpus.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.operators.skew import salted_rank
from quorumlake.session import cut

#: Fixed: the split pattern that belongs to the byte-level vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text beyond about so many characters is counted in parts, cut where the pattern parts it anyway: between
#: a sign and a blank, or a letter and a digit.
PART_CHARS, PARTING = 1_000_000, r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, read where the query is written; workers get its bytes with the plan."""
    with open(path, "rb") as f:
        return f.read()


def parts_of(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about `size` characters that have the tokens of the whole text. A longer run
    without any place to cut is one part."""
    import regex

    parting, at = regex.compile(PARTING), 0
    while len(text) - at > size:
        cut_at = parting.search(text, at + size)
        if cut_at is None:
            break
        yield text[at : cut_at.start()]
        at = cut_at.start()
    yield text[at:]


def token_counts(texts: DataFrame, id_column: str, text_column: str, vocabulary: str, pattern: str = SPLIT_PATTERN) -> DataFrame:
    """(id, n_tokens) of every text, by a byte-level vocabulary file of ranks (its path is a parameter).

    Null and empty texts have 0 tokens. Texts are read whole.
    """
    data = read_vocabulary(vocabulary)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        encoding = tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = []
            for t in b.column(1).to_pylist():
                n.append(sum(len(encoding.encode_ordinary(part)) for part in parts_of(t)) if t else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[id_column, "n_tokens"])

    kind = dict(texts.dtypes)[id_column]
    return texts.select(id_column, text_column).mapInArrow(count, f"`{id_column}` {kind}, n_tokens bigint")


#: Plans of up to so many runs (32 bytes each) are sent to every executor.
MOST_RUNS = 200_000


@dataclass
class Plan:
    """Runs (size, rank_from, rank_to, first_bin, per_bin) and the number of sequences."""

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    n_bins: int = 0


def linear_groups(counts: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int, int]]]:
    """Large sizes, the largest first, in groups of equal cardinality: runs (size, rank_from, rank_to).

    A size that spans a border is split by rank. Every text of a group counts as the group's largest.
    """
    total = sum(n for _, n in counts)
    limit = max(1, -(-total // groups))
    out, room = [], 0
    for size, n in counts:
        at = 0
        while at < n:
            if room == 0:
                out.append([])
                room = limit
            take = min(room, n - at)
            out[-1].append((size, at, at + take))
            at, room = at + take, room - take
    return out


def best_configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each rounded size fill one sequence best, by bounded knapsack over the sizes.

    The largest size left is always part of it, so large texts aren't put off; among equal fill the
    configuration with the larger texts is taken.
    """
    first = next(i for i, n in enumerate(left) if n)
    reach: dict[int, tuple[int, ...]] = {sizes[first]: (first,)}
    for i in range(first, len(sizes)):
        have = left[i] - (i == first)
        if have <= 0:
            continue
        for total, used in list(reach.items()):
            t, u = total, used
            for _ in range(have):
                t += sizes[i]
                if t > capacity:
                    break
                u = (*u, i)
                if t not in reach:
                    reach[t] = u
    best = reach[max(reach)]
    return [best.count(i) for i in range(len(sizes))]


def make_plan(histogram: dict[int, int], capacity: int, groups: int = 24, small_share: int = 8) -> Plan:
    """A packing of `histogram` (size -> number of texts, sizes 1..capacity) into few sequences.

    Texts longer than capacity/small_share are large: grouped linearly, rounded up within their group,
    packed by configurations of the few rounded sizes, each repeated as often as texts are left for it;
    then the actual texts take the places, which leaves room the rounding had hidden. Small texts go,
    the longest first, to the fullest sequence that has room; a new one opens when none has.
    """
    plan = Plan()
    sizes = sorted((s for s, n in histogram.items() if n), reverse=True)
    if any(s < 1 or s > capacity for s in sizes):
        raise ValueError("sizes must be from 1 to the capacity")
    large = [(s, histogram[s]) for s in sizes if s * small_share > capacity]
    grouped = linear_groups(large, groups) if large else []
    rounded = [g[0][0] for g in grouped]
    left = [sum(b - a for _, a, b in g) for g in grouped]
    cursor = [(0, 0) for _ in grouped]  # run of the group, ranks taken of it
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first bin, number of bins)

    def take(g: int, n: int) -> list[tuple[int, int]]:
        """The next n texts of group g as (size, number), noting their ranks."""
        parts = []
        while n:
            run, used = cursor[g]
            size, a, b = grouped[g][run]
            k = min(n, b - a - used)
            parts.append((size, a + used, k))
            cursor[g] = (run, used + k) if a + used + k < b else (run + 1, 0)
            n -= k
        return parts

    while any(left):
        config = best_configuration(rounded, left, capacity)
        bins = min(n // c for n, c in zip(left, config) if c)
        edges: dict[int, int] = {}
        for g, c in enumerate(config):
            for _ in range(c):
                at = 0
                for size, rank, k in take(g, bins):
                    plan.runs.append((size, rank, rank + k, plan.n_bins + at, 1))
                    edges[at] = edges.get(at, 0) + size
                    edges[at + k] = edges.get(at + k, 0) - size
                    at += k
            left[g] -= c * bins
        load, points = 0, sorted(edges)
        for p, q in zip(points, points[1:]):
            load += edges[p]
            rooms.setdefault(capacity - load, []).append((plan.n_bins + p, q - p))
        plan.n_bins += bins

    order = sorted(r for r in rooms if r > 0)
    for s in sizes:
        if s * small_share > capacity:
            continue
        rank, n = 0, histogram[s]
        while rank < n:
            i = bisect_left(order, s)
            while i < len(order) and not rooms.get(order[i]):
                order.pop(i)
            if i < len(order):
                room = order[i]
                first, bins = rooms[room].pop()
            else:
                room, first = capacity, plan.n_bins
                bins = -(-(n - rank) // (capacity // s))
                plan.n_bins += bins
            per = min(room // s, n - rank)
            use = min(bins, (n - rank) // per)
            plan.runs.append((s, rank, rank + use * per, first, per))
            rank += use * per
            for r, f, b in ((room - per * s, first, use), (room, first + use, bins - use)):
                if b and r:
                    if not rooms.get(r):
                        rooms[r] = []
                        j = bisect_left(order, r)
                        if j == len(order) or order[j] != r:
                            order.insert(j, r)
                    rooms[r].append((f, b))
    return plan


def pack(items: DataFrame, id_column: str, capacity: int, make: Callable[[dict[int, int], int], Plan] = make_plan) -> DataFrame:
    """(id, piece_no, token_from, token_to, sequence_id): every text's place.

    items: id (unique, not null) and n_tokens. A text that exceeds the capacity alone is cut into
    full pieces, each a sequence of its own, and a rest that is packed like a text; no other text is
    cut. Texts without tokens need no room and get no row. Ids of sequences are 0, 1, ... without gaps.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    items = items.select(id_column, F.col("n_tokens").cast("bigint").alias("n_tokens")).filter("n_tokens > 0")
    pieces = cut(
        items.withColumn("piece_no", F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {capacity})"))).select(
            id_column,
            "piece_no",
            (F.col("piece_no") * capacity).alias("token_from"),
            F.least(F.col("n_tokens"), (F.col("piece_no") + 1) * capacity).alias("token_to"),
        )
    )
    pieces = pieces.withColumn("_size", F.col("token_to") - F.col("token_from"))
    # at most `capacity` rows, whatever the corpus
    histogram = {r["_size"]: r["n"] for r in pieces.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make(histogram, capacity)
    # one row a size with its runs in order of rank, so that no text meets more than one row
    by_size: dict[int, list[tuple]] = {}
    for size, *run in sorted(plan.runs):
        by_size.setdefault(size, []).append(tuple(run))
    runs = items.sparkSession.createDataFrame(list(by_size.items()), "_size bigint, _runs array<struct<_from: bigint, _to: bigint, _bin: bigint, _per: bigint>>")
    if len(plan.runs) <= MOST_RUNS:
        runs = F.broadcast(runs)
    ranked = salted_rank(pieces, ["_size"], [id_column, "piece_no"], "_rank")
    own = F.element_at(F.filter("_runs", lambda r: (F.col("_rank") >= r["_from"]) & (F.col("_rank") < r["_to"])), 1)
    placed = ranked.join(runs, "_size").withColumn("_run", own)
    return placed.select(
        id_column, "piece_no", "token_from", "token_to",
        (F.col("_run._bin") + F.floor((F.col("_rank") - F.col("_run._from")) / F.col("_run._per"))).cast("bigint").alias("sequence_id"),
    )
