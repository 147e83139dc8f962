"""Continuous ingestion: sightings arrive as a stream and are folded into the ledger by micro-batch.

Each batch is consolidated by itself and merged with the ledger's current
snapshot; snapshots are written under the batch number, so a batch that is run
again after a failure writes the same snapshot again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.consolidate import consolidate, merge
from ..schema import EDGES
from ..sources.shared import shared_folder


def fold_stream(sightings: DataFrame, root: str) -> str:
    """Run the stream to its end; returns the path of the last snapshot of edges."""
    spark = sightings.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        now = consolidate(batch)
        if number:
            now = merge(spark.read.schema(EDGES).parquet(f"{root}/edges/{number - 1}"), now)
        now.write.mode("overwrite").parquet(f"{root}/edges/{number}")

    query = sightings.writeStream.foreachBatch(fold).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    return f"{root}/edges/{last['batchId'] if last else 0}"


def event_sightings(events: DataFrame) -> DataFrame:
    """An event is a publication: its user writes the channel of its type, at a place made of its day."""
    return events.select(
        F.concat(F.lit("user-"), (F.col("user_id") % 10).cast("string")).alias("actor"),
        F.lit("pub").alias("rel"),
        F.col("event_type").alias("object"),
        F.lit("-").alias("label"),
        F.lit("CODE").alias("tag"),
        F.date_format("ts", "'events/'yyyy-MM-dd").alias("path"),
        F.hour("ts").alias("line"),
        F.lit(None).cast("string").alias("note"),
    )


def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, folded to edges: one row per edge with its number of places."""
    source = f"{sf_dir}/events.parquet"
    static = spark.read.parquet(source)
    root = shared_folder(spark)
    # the source is one file or one folder; the stream reads a folder, four files at a time
    static.select("ts", "user_id", "event_type").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(static.select("ts", "user_id", "event_type").schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    edges = spark.read.schema(EDGES).parquet(fold_stream(event_sightings(stream), root))
    places = F.aggregate("receipts", F.lit(0).cast("bigint"), lambda n, r: n + F.size(r["lines"]))
    return edges.select("actor", "rel", "object", places.alias("places"))
