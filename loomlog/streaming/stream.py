"""Streams of log lines: templates, windowed counts, and a pool that is updated batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.text import clean, heuristic_template, is_valid


def templated(lines: DataFrame) -> DataFrame:
    """lines (content, ...) with template_pattern; invalid lines are left out.  Stateless."""
    text = clean(F.col("content"))
    return lines.withColumn("cleaned", text).where(is_valid(F.col("cleaned"))).withColumn("template_pattern", heuristic_template(F.col("cleaned")))


def template_counts(lines: DataFrame) -> DataFrame:
    """Running count of each template (output mode complete or update)."""
    return templated(lines).groupBy("template_pattern").agg(F.count(F.lit(1)).alias("count"))


def windowed_counts(lines: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """window_start, template_pattern, count; a window is closed, and its state dropped, `late` after its end."""
    marked = templated(lines).withWatermark(ts, late)
    counted = marked.groupBy(F.window(ts, window, slide), "template_pattern").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("window.start").alias("window_start"), "template_pattern", "count")


def sessions(lines: DataFrame, key: str, ts: str = "ts", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Lines of each key in a row with pauses of less than `gap`."""
    marked = lines.withWatermark(ts, late)
    return marked.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("count")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")


def without_repeats(lines: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first line of each text within the watermark."""
    return lines.withWatermark(ts, late).dropDuplicatesWithinWatermark(["content"])


def mine(lines: DataFrame, parse: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Start a query that hands each micro-batch to parse(batch, number), e.g. Pipeline.parse_batch with the known tables, then a write.

    once: stop when all that is there now has been read.
    """
    writer = lines.writeStream.foreachBatch(parse).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: The state of a query that is drained lies on the executors' disks, in bounded memory, and not in their heaps.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def drained(df: DataFrame, mode: str, path: str) -> DataFrame:
    """All that the stream yields until what is there now has been read, as a table under `path`; no row passes through the driver.

    Each micro-batch is a folder of its own, which a repeated batch overwrites.  Mode complete: the last one is the result; append: all are.
    """
    spark, folders = df.sparkSession, {}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        folders[number] = f"{path}/{number}"

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:  # a query copies the settings when it starts
        running = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    running.awaitTermination()
    read = [folders[n] for n in sorted(folders)][-1 if mode == "complete" else 0 :]
    return spark.read.schema(df.schema).parquet(*read) if read else spark.createDataFrame([], df.schema)
