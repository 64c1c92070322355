"""Streams: file ingestion with full replacement per file, and sessions of events under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as S


def file_stream(spark: SparkSession, root: str, extensions=S.WATCHED) -> DataFrame:  # noqa: ANN001
    """New and changed files of a folder as a stream."""
    raw = spark.readStream.format("binaryFile").schema(S.BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(extensions)}}}").load(root)
    return S.as_texts(raw.where((F.col("length") > 0) & ~F.col("path").rlike(r"/\.|/mirrored_brain/")))


def ingest_batch(batch: DataFrame, batch_id: int, table: str) -> None:
    """Write one micro-batch as a version of its own: latest row per path, and only paths whose hash changed.

    Rows carry the batch number; readers take the latest per path (``current``). A batch that is run again overwrites its own
    folder, so that a retry leaves nothing twice."""
    spark = batch.sparkSession
    rows = S.latest_versions(batch)
    known = current(spark, table)
    if known is not None:
        known = known.where(F.col("batch") < batch_id)
        rows = rows.join(known.select("path", "hash"), ["path", "hash"], "left_anti")
    rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table}/batch={batch_id}/")


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """Latest version of every path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or not fs.listStatus(hadoop):
        return None
    df = spark.read.schema("path string, modified timestamp, bytes bigint, hash string, content string, batch bigint").parquet(table)
    last = df.groupBy("path").agg(F.max("batch").alias("batch"))
    return df.join(last, ["path", "batch"], "left_semi")


def run_ingest(spark: SparkSession, root: str, table: str, checkpoint: str, extensions=S.WATCHED) -> DataFrame | None:  # noqa: ANN001
    """Take in everything there is now, and stop; gives the current rows."""
    q = file_stream(spark, root, extensions).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: ingest_batch(df, i, table)).start()
    q.awaitTermination()
    return current(spark, table)


def sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "15 minutes", late: str | None = None) -> DataFrame:
    """Gap sessions per user; the same plan for a batch and, with a watermark, for a stream."""
    if late:
        events = events.withWatermark(ts, late)
    s = events.groupBy(F.session_window(ts, gap).alias("w"), F.col(user).alias("user_id")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return s.select("user_id", F.col("w.start").alias("first_ts"), (F.col("w.end") - F.expr(f"interval {gap}")).alias("last_ts"), "n", "total")


def run_sessions(spark: SparkSession, path: str, schema, out: str, checkpoint: str, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:  # noqa: ANN001
    """Sessions of an event folder through the streaming engine, written as they close; a session still open at the end stays in the state."""
    src = spark.readStream.schema(schema).parquet(path)
    q = sessions(src, gap=gap, late=late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("user_id bigint, first_ts timestamp, last_ts timestamp, n bigint, total double").parquet(out)
