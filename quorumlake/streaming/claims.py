"""An extension: claims that arrive as a stream are folded into the resolved table batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quorumlake.operators.resolve import KEY

CLAIM_STREAM_SCHEMA = "entity_id string, attribute string, source string, value_json string, priority int, seq bigint, emitted_at timestamp"


def claim_stream(spark: SparkSession, folder: str, watermark: str = "1 hour") -> DataFrame:
    """Claims of a folder of Parquet files as a stream, redelivered ones dropped within the watermark."""
    raw = spark.readStream.schema(CLAIM_STREAM_SCHEMA).parquet(folder)
    return raw.withWatermark("emitted_at", watermark).dropDuplicatesWithinWatermark(["entity_id", "attribute", "source", "seq"])


def claim_rates(claims: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Claims per source and tumbling window of event time; late ones count until the watermark."""
    return claims.groupBy(F.window("emitted_at", window), "source").agg(F.count(F.lit(1)).alias("n")).select("window.start", "source", "n")


def best_claims(claims: DataFrame) -> DataFrame:
    """The winning claim of each entity and attribute, as a row that can compete again."""
    best = F.min_by(F.struct("value_json", "source", "priority", "seq"), F.struct("priority", "seq"))
    return claims.filter("value_json is not null").groupBy(*KEY).agg(best.alias("_b")).select(*KEY, "_b.*")


def fold_into(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the stored winners and the batch compete, the winners are stored.

    Resolution is associative, so folding gives what resolving all claims at once gives; a batch that
    is delivered again changes nothing. read returns None before the first batch.
    """

    def fold(batch: DataFrame, _: int) -> None:
        new = best_claims(batch)
        old = read()
        write(best_claims(old.unionByName(new)) if old is not None else new)

    return fold


def start(claims: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs the fold over all that is there, in micro-batches that survive a restart."""
    return claims.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
