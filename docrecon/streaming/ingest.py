"""Incremental ingestion: files that are new or changed, once each.

A file's signature is a digest of its path, size and time and of the settings that it is read with. ingest_changed keeps a table of
signatures: a run takes the files whose signature is not there and adds it once they are taken, so a rerun does nothing, a
changed file is read again, and so are all files under other settings. ingest_stream is for folders whose files never change: a stream
with a checkpoint, which remembers paths.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecon.operators.scans import kept


def signature(path: Column, length: Column, modified: Column, settings: str) -> Column:
    return F.sha1(F.concat_ws("|", path, length.cast("string"), modified.cast("string"), F.lit(settings)))


def pending(files: DataFrame, seen: DataFrame | None, settings: str = "") -> DataFrame:
    """Of files(path, length, modificationTime) those whose signature `seen` (path, signature) lacks: path, signature, status
    (new, or changed for a path that was seen before). Repeated files count once."""
    now = files.select("path", signature(F.col("path"), F.col("length"), F.col("modificationTime"), settings).alias("signature")).distinct()
    if seen is None:
        return now.withColumn("status", F.lit("new"))
    known = seen.select("path").distinct().withColumn("_known", F.lit(True))
    left = now.join(seen.select("signature").distinct(), "signature", "left_anti").join(known, "path", "left")
    return left.select("path", "signature", F.when(F.col("_known"), "changed").otherwise("new").alias("status"))


def listed_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length and modificationTime of all files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "modificationTime")


def pending_files(spark: SparkSession, folder: str, seen: DataFrame | None, settings: str = "", pattern: str = "*") -> DataFrame:
    """pending, of the files below a folder."""
    return pending(listed_files(spark, folder, pattern), seen, settings)


def ingest_changed(spark: SparkSession, folder: str, state: str, sink: Callable[[DataFrame], None], settings: str = "", pattern: str = "*") -> int:
    """Hands the files that are new or changed to `sink` (path, signature, status) and adds their signatures to the table at
    `state`; returns how many there were. A run that fails before its end adds none, so sinks should be idempotent by
    signature: they see such files again."""
    spark.createDataFrame([], "path string, signature string").write.mode("append").parquet(state)
    found = kept(pending_files(spark, folder, spark.read.schema("path string, signature string").parquet(state), settings, pattern), "pending")
    n = found.count()
    if n:
        sink(found)
        found.select("path", "signature").write.mode("append").parquet(state)
    return n


def ingest_stream(spark: SparkSession, folder: str, schema, checkpoint: str, sink: Callable[[DataFrame, int], None], source: str = "parquet", max_files: int = 1000, pattern: str = "*") -> None:
    """Runs `sink` on each batch of new files until none is left. The checkpoint remembers files, so each is read once
    over any number of runs; sinks should be idempotent by batch id."""
    stream = spark.readStream.format(source).schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", pattern).load(folder)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drift_counts(stream: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows per window and kind, with a watermark for late rows; for batches and streams."""
    stamped = stream.withColumn("_at", F.col(time).cast("timestamp"))
    marked = stamped.withWatermark("_at", late) if stream.isStreaming else stamped
    return marked.groupBy(F.window("_at", width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
