"""History of changing entity attributes: closed versions from update logs or from snapshots.

Inputs (logs, the sources of a log, single snapshots) are co-partitioned by ranges of (entity,
attribute, instant) and each is sorted on its own within a range. A task then merges its k sorted
inputs: it reads them in blocks, holds at most one open block an input, takes the smallest key of all
of them, and emits a version when the value changes. No history is collected. A key of any size spans
as many ranges as it needs; what crosses a border is stitched from at most two rows a range.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.operators.snapshots import with_instants
from quorumlake.session import cut

#: What a range reports. version: true, false, or null where it depends on the range before.
RANGE_SCHEMA = (
    "entity_id string, attribute string, valid_from bigint, valid_to bigint, value string, "
    "value_before string, version boolean, edge boolean, part int"
)

#: Rows of a sorted input that are read at a time.
BLOCK_ROWS = 256
#: Blocks of the sorted inputs, under the key of their first row.
BLOCK_SCHEMA = "entity_id string, attribute string, at bigint, block binary"


def in_force(pairs: Sequence[tuple[str | None, str | None]]) -> tuple[str | None, str | None]:
    """(value before, value in force) of the distinct (old, new) rows of one instant.

    In force is the new value that is no other row's old value; before is the old value that is no
    other row's new value. Should several remain, the smallest counts (null first); should none
    (a cycle), all are candidates.
    """
    if len(pairs) == 1:
        return pairs[0]
    rank = lambda v: (v is not None, v or "")
    olds = {o for o, n in pairs if o != n}
    news = {n for o, n in pairs if o != n}
    every_new, every_old = {n for _, n in pairs}, {o for o, _ in pairs}
    return min((every_old - news) or every_old, key=rank), min((every_new - olds) or every_new, key=rank)


def sorted_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts sorted inputs, which follow one another (run, entity_id, attribute, at, old, new), into blocks.

    A block holds rows of one run only.
    """
    names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        run, rows = batch.column(0), batch.select(range(1, batch.num_columns))
        other = pc.fill_null(pc.not_equal(run[1:], run[:-1]), True).to_pylist() if batch.num_rows > 1 else []
        starts = [0, *[i + 1 for i, x in enumerate(other) if x]] if batch.num_rows else []
        out = []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            for at in range(a, b, BLOCK_ROWS):
                piece = rows.slice(at, min(BLOCK_ROWS, b - at))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema) as writer:
                    writer.write_batch(piece)
                out.append((*[piece.column(i)[0].as_py() for i in range(3)], sink.getvalue().to_pybytes()))
        columns = zip(*out) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (entity_id, attribute, at, old, new) of all inputs in the order of their keys.

    Blocks come in the order of their first keys, so whatever is smaller than the next block's key may
    go out; of each input at most one block is open at a time (and the next where keys are equal).
    """
    heap: list[tuple] = []  # (key, number, row, rest of the block)

    def out(limit: tuple | None) -> Iterator[tuple]:
        while heap and (limit is None or heap[0][0] < limit):
            key, number, row, rest = heap[0]
            yield row
            row = next(rest, None)
            if row is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (row[:3], number, row, rest))

    number = 0
    for batch in batches:
        for e, a, t, block in zip(*(batch.column(i).to_pylist() for i in range(4))):
            yield from out((e, a, t))
            with pa.ipc.open_stream(block) as reader:
                rest = iter(zip(*(c.to_pylist() for c in reader.read_all().columns)))
            row, number = next(rest), number + 1
            heapq.heappush(heap, (row[:3], number, row, rest))
    yield from out(None)


def merge_range(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the sorted inputs of one range (as blocks) into versions, in one pass."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    out: list[tuple] = []
    key = at = value = before = None
    pairs: set[tuple] = set()
    version: list | None = None  # valid_from, value, value_before, version, edge
    keys_seen = 0
    fresh = True  # no instant of this key was merged yet

    def emit(to: int | None, last: bool) -> None:
        if version is not None and (version[3] is not False or version[4] or last):
            out.append((*key, version[0], to, version[1], version[2], version[3], version[4] or last, part))

    def end_instant() -> None:
        nonlocal version, value, fresh
        old, new = in_force(sorted(pairs, key=str)) if len(pairs) > 1 else next(iter(pairs))
        if fresh:
            head = keys_seen == 1
            version = [at, new, old, None if head else new != old, head]
        elif new != value:
            emit(at, False)
            version = [at, new, value, True, False]
        value, fresh = new, False

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 9
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32()]
        names = [x.split()[0] for x in RANGE_SCHEMA.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        out.clear()
        return batch

    for e, a, t, old, new in merged(batches):
        if key is not None and t == at and key == (e, a):
            pairs.add((old, new))
            continue
        if key is not None:
            end_instant()
        if key != (e, a):
            if key is not None:
                emit(None, False)
            key, fresh, version = (e, a), True, None
            keys_seen += 1
        at, pairs = t, {(old, new)}
        if len(out) > 50_000:
            yield flush()
    if key is not None:
        end_instant()
        emit(None, True)
    yield flush()


def stitch(ranges: DataFrame) -> DataFrame:
    """Joins what ranges report at their borders; everything else passes unchanged."""
    inner = ranges.filter(~F.col("edge") & F.col("version")).select(
        "entity_id", "attribute", "valid_from", "valid_to", "value"
    )
    by_key = Window.partitionBy("entity_id", "attribute").orderBy("part", "valid_from")
    edges = (
        ranges.filter("edge")
        .withColumn("_has", F.lag(F.lit(True)).over(by_key))
        .withColumn("_prev", F.when(F.col("_has"), F.lag("value").over(by_key)).otherwise(F.col("value_before")))
        .withColumn("_starts", F.coalesce(F.col("version"), ~F.col("value").eqNullSafe(F.col("_prev"))))
        .withColumn("_run", F.sum(F.col("_starts").cast("int")).over(by_key))
        .filter("_run > 0")
        .groupBy("entity_id", "attribute", "_run")
        .agg(
            F.min("valid_from").alias("valid_from"),
            F.max("valid_to").alias("valid_to"),
            F.max(F.when(F.col("_starts"), F.col("value"))).alias("value"),
        )
    )
    by_run = Window.partitionBy("entity_id", "attribute").orderBy("_run")
    closed = edges.withColumn("valid_to", F.coalesce("valid_to", F.lead("valid_from").over(by_run)))
    return inner.unionByName(closed.drop("_run"))


def build_versions(*logs: DataFrame) -> DataFrame:
    """Versions (entity_id, attribute, valid_from, valid_to, value) of any number of update logs.

    Each log has entity_id, attribute, at (bigint instant), old_value, new_value; values are already
    canonical. A log may name in `run` which of several inputs a row comes from (a source, a snapshot);
    every run of every log is one sorted input of the merge. valid_to is null for the version still in
    force. Rows with a null entity, attribute
    or instant take no place in the order and give nothing; repeated rows count once; rows of one
    instant are resolved by `in_force`; empty logs give an empty history.

    A log may also have old_absent and new_absent: true where there is no record at all, which is
    another state than a record with a null value. Absence ends a version and is none itself.
    """
    cols = ["entity_id", "attribute", "at", "old_value", "new_value"]
    coded = any("new_absent" in log.columns for log in logs)
    merged_logs = None
    for i, log in enumerate(logs):
        one = log
        if coded:  # absence travels as the empty text, a value behind a sign
            for c in ("old", "new"):
                value = F.concat(F.lit("="), F.col(f"{c}_value"))
                one = one.withColumn(f"{c}_value", F.when(F.col(f"{c}_absent"), "").otherwise(value) if f"{c}_absent" in log.columns else value)
        run = F.col("run").cast("string") if "run" in log.columns else F.lit("")
        one = one.select(F.concat_ws(":", F.lit(str(i)), run).alias("_run"), *cols).dropna(subset=cols[:3])
        merged_logs = one if merged_logs is None else merged_logs.unionByName(one)
    # a repeated row counts once, in the first of its runs
    rows = merged_logs.groupBy(*cols).agg(F.min("_run").alias("_run"))
    ranged = rows.repartitionByRange(*cols[:3]).select("_run", *cols).sortWithinPartitions("_run", *cols)
    blocks = ranged.mapInArrow(sorted_blocks, BLOCK_SCHEMA).sortWithinPartitions(*cols[:3])
    out = stitch(cut(blocks.mapInArrow(merge_range, RANGE_SCHEMA)))
    return out.filter("not value <=> ''").withColumn("value", F.expr("substring(value, 2)")) if coded else out


def snapshots_as_log(snapshots: DataFrame, entity: Column, at: Column, attributes: dict[str, Column]) -> DataFrame:
    """Periodic full snapshots as an update log: a row per attribute for each snapshot that has the
    record, and one for the first snapshot after it that lacks the record (new_absent).

    Before its first snapshot and in a gap a record is absent, so what comes back begins new versions,
    and an attribute that is null from the start has a version. Every instant of `snapshots` is a
    delivery of all records. Each snapshot is a run of its own, so versions come out of a merge of the
    snapshots.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("attribute"), v.cast("string").alias("new_value")) for k, v in attributes.items()])
    rows = snapshots.select(entity.alias("entity_id"), at.cast("bigint").alias("at"), pairs.alias("_a"))
    # one row per delivery; the only window without a key, over as many rows as there are snapshots
    deliveries = rows.select("at").dropna().distinct().withColumn("_next", F.lead("at").over(Window.orderBy("at")))
    then = F.lead("at").over(Window.partitionBy("entity_id").orderBy("at"))
    seen = with_instants(rows.dropna(subset=["entity_id", "at"]), deliveries, "at", F.col("entity_id")).withColumn("_then", then)
    gone = F.when(F.col("_next").isNotNull() & (F.col("_then").isNull() | (F.col("_then") > F.col("_next"))), F.struct(F.col("_next").alias("at"), F.lit(True).alias("gone")))
    events = F.array_compact(F.array(F.struct("at", F.lit(False).alias("gone")), gone))
    return (
        seen.select("entity_id", F.col("at").alias("run"), F.explode(events).alias("_e"), "_a")
        .select("entity_id", "run", "_e.at", "_e.gone", F.explode("_a").alias("_p"))
        .select(
            "entity_id", F.col("_p.attribute"), "run", "at", F.lit(None).cast("string").alias("old_value"), F.when(~F.col("gone"), F.col("_p.new_value")).alias("new_value"),
            F.lit(True).alias("old_absent"), F.col("gone").alias("new_absent"),
        )
    )
