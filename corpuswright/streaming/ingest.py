"""Streaming ingest: files to deduplicated documents with running counts, exactly once a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuswright.functions.text import content_sha256, is_blank


def documents_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def deduplicated(stream: DataFrame, text: str = "text") -> DataFrame:
    """The first document of each content; the keys seen are the query's state (a state store, not memory)."""
    return stream.where(~is_blank(text)).withColumn("sha256", content_sha256(text)).dropDuplicates(["sha256"])


def ingest(stream: DataFrame, table: str, index: str, checkpoint: str, text: str = "text", order: str | Column = "doc_id", key: Column | None = None, least: bool = False) -> StreamingQuery:
    """Append new documents to ``table`` and their hashes to ``index``, until the source is used up.

    Each batch is deduplicated, held against the index by an anti join, and
    written under its number; a batch that is run again overwrites its own files.
    Of a batch's copies the least by ``order`` stays, of rows with equal orders one.

    ``key`` tells copies (the hash of the stripped text; blank texts are left out)
    - with a key of its own, all rows count whose key isn't null. With ``least``
    a copy of a later batch is appended too if it comes before those known;
    ``current`` reads such a table, whose result no longer depends on the batches.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        by = (F.col(order) if isinstance(order, str) else order).alias("__order")
        own = df.where(~is_blank(text)).withColumn("sha256", content_sha256(text)) if key is None else df.withColumn("sha256", key).where("sha256 is not null")
        own = own.withColumn("__order", by)
        first = own.groupBy("sha256").agg(F.min("__order").alias("__first"))
        new = own.join(first, "sha256").where(F.col("__order").eqNullSafe(F.col("__first"))).drop("__first").dropDuplicates(["sha256"])
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(index)
        if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            known = spark.read.option("recursiveFileLookup", False).parquet(index).where(F.col("batch") < number)
            if least:
                known = known.groupBy("sha256").agg(F.min("__order").alias("__known"))
                new = new.join(known, "sha256", "left").where("__known is null or __order < __known").drop("__known")
            else:
                new = new.join(known.select("sha256"), "sha256", "left_anti")
        if not least:
            new = new.drop("__order")
        new.write.mode("overwrite").parquet(f"{table}/batch={number}")
        spark.read.parquet(f"{table}/batch={number}").select("sha256", *["__order"] * least).write.mode("overwrite").parquet(f"{index}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, *columns: str) -> DataFrame:
    """sha256 and the columns of the least row of each key in a table that ``ingest`` wrote with ``least``."""
    rows = spark.read.parquet(table)
    return rows.groupBy("sha256").agg(F.min(F.struct("__order", *columns)).alias("__f")).select("sha256", *(F.col(f"__f.{c}").alias(c) for c in columns))


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts of events by type and tumbling or sliding window, closed by a watermark. Our own addition."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's events with no longer gap between them. Our own addition."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")
