"""Streaming forms of batch operators. They use the same expressions and keep state only within a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remembra.functions.text import content_hash
from remembra.memory import Memory
from remembra.operators.ingest import exchange_content, exchange_importance, exchange_metadata, exchanges, session_summary, substantive
from remembra.sources.files import session_messages
from remembra.sources.store import Store


def session_files(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(file, text) of JSONL session logs as they arrive; a file counts once, by the query's checkpoint."""
    logs = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_batch)
    return logs.load(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def ingest_sessions(spark: SparkSession, folder: str, checkpoint: str, take: Callable[[DataFrame, int], None]):
    """Start taking in the files that are there and not yet taken: each batch's substantive exchanges go to `take`, then the query stops."""

    def batch(files: DataFrame, number: int) -> None:
        lines = files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
        take(exchanges(session_messages(lines)).filter(substantive()), number)

    return session_files(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions_into(memory: Memory, as_of: Column, least: float = 0.0, name: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ingest_sessions: saves each batch's exchanges as episodic memories, with their importance and metadata, those whose content is there left out, and
    the summaries of its sessions. name: of the stream, one for each checkpoint; with it, a batch that is run again does nothing."""

    def take(rows: DataFrame, number: int) -> None:
        rows = rows.withColumn("importance", exchange_importance()).filter(F.col("importance") >= least)
        said = F.concat_ws(" ", "user", "assistant")
        made = rows.select(exchange_content().alias("content"), F.lit("episodic").alias("type"), "importance", F.lit("sessions").alias("namespace"), F.concat(F.lit("session:"), F.col("session").cast("string")).alias("source"), F.to_json(exchange_metadata(said)).alias("metadata"))
        short = session_summary(rows).select(F.col("summary").alias("content"), F.lit("session").alias("type"), F.lit(0.5).alias("importance"), F.lit("sessions").alias("namespace"), F.concat(F.lit("session:"), F.col("session").cast("string")).alias("source"), F.to_json(F.struct(F.lit(True).alias("isSummary"), F.col("exchanges").alias("exchangeCount"))).alias("metadata"))
        memory.save(made.unionByName(short), as_of, dedup=True, batch=f"{name}:{number}" if name else None)

    return take


def attention_windows(records: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(start, topic, minutes): attention by topic in tumbling windows of records (created_at, topics, duration); later ones than `late` are dropped."""
    minutes = F.when(F.coalesce(F.col("duration"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("duration"))
    each = records.withWatermark("created_at", late).select("created_at", F.explode("topics").alias("topic"), minutes.alias("d"))
    return each.groupBy(F.window("created_at", width).alias("w"), "topic").agg(F.sum("d").alias("minutes")).select(F.col("w.start").alias("start"), "topic", "minutes")


def first_seen(memories: DataFrame, late: str = "7 days") -> DataFrame:
    """memories whose trimmed content has not come within the watermark."""
    return memories.withColumn("hash", content_hash(F.col("content"))).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["hash"]).drop("hash")


def fold_touches(touches: DataFrame, store: Store, checkpoint: str):
    """Start folding searches' touches (id, accessed_at, accesses) into the store, a segment of touches for each batch; a batch that is run again counts once."""
    return touches.writeStream.foreachBatch(lambda rows, n: store.fold(rows, f"{checkpoint}:{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
