"""Scans and sinks: text, CSV, JSON and lists in; results, templates and state out."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATE_SCHEMA = (
    "template_id string, template_pattern string, static_tokens array<string>, variable_positions array<int>, example_logs array<string>, "
    "count bigint, confidence double, created_at timestamp, updated_at timestamp"
)


def _numbered(spark: SparkSession, rows: DataFrame, files: list[str]) -> DataFrame:
    """seq, content: seq goes by file name and then by place in the file; it identifies rows and need not be gapless.

    rows: content, file, start (where the row's block begins in its file).  A line has a byte at least, so the start of its block
    plus its place in the scan's partition grows along a file: a block that shares its partition with others is its file's last.  2^20
    files of 2^43 bytes have room.
    """
    # a row for each file of the listing that the driver holds anyway; a scheme may be followed by one slash or by three
    plain = [re.sub(r"^(\w+):/{2,}(?=/)", r"\1:", f) for f in sorted(files)]
    numbers = F.broadcast(spark.createDataFrame([(f, i) for i, f in enumerate(plain)], "file string, number long"))
    rows = rows.withColumn("file", F.regexp_replace("file", r"^(\w+):/{2,}(?=/)", "$1:"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.withColumn("place", F.col("start") + place)
    return placed.join(numbers, "file", "left").select((F.coalesce("number", F.lit(0)) * (1 << 43) + F.col("place")).alias("seq"), "content")


def _from_files(read: DataFrame, content: Column) -> DataFrame:
    return read.select(content.alias("content"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """seq, content: stripped lines without blank ones."""
    read = spark.read.text(path)
    rows = _from_files(read, F.regexp_replace("value", r"^\s+|\s+$", ""))
    return _numbered(spark, rows, read.inputFiles()).where(F.length("content") > 0)


def csv_lines(spark: SparkSession, path: str, column: str = "log", multi_line: bool = True) -> DataFrame:
    """The named column only; fields may hold quotes and, unless multi_line is off, newlines.  With it a file is one task's work."""
    read = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return _numbered(spark, _from_files(read, F.col(f"`{column}`").cast("string")), read.inputFiles())


def json_lines(spark: SparkSession, path: str, column: str = "log", multi_line: bool = True) -> DataFrame:
    """An array of records, or one record on each line; with multi_line off only the latter, and a large file is divided among tasks."""
    read = spark.read.option("multiLine", multi_line).schema(f"`{column}` string").json(path)
    return _numbered(spark, _from_files(read, F.col(f"`{column}`")), read.inputFiles())


def lines(spark: SparkSession, path: str, column: str = "log") -> DataFrame:
    """By suffix: .csv, .json, else text."""
    if path.endswith(".csv"):
        return csv_lines(spark, path, column)
    return json_lines(spark, path, column) if path.endswith(".json") else text_lines(spark, path)


def list_lines(spark: SparkSession, logs: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(logs)), "seq bigint, content string")


def column_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, content: a row for each line of a text column that is not blank."""
    spread = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "content"))
    return spread.withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", "")).where(F.length("content") > 0)


def chunk_number(position: Column, size: int = 1000) -> Column:
    """From 1, for positions from 1."""
    return F.floor((position - 1) / size) + 1


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_templates(pool: DataFrame, path: str) -> None:
    """Templates, and metadata beside them: total_templates, saved_at."""
    pool.write.mode("overwrite").json(f"{path}/templates")
    saved = F.lit(datetime.datetime.now(datetime.UTC).isoformat())
    pool.agg(F.count(F.lit(1)).alias("total_templates")).withColumn("saved_at", saved).write.mode("overwrite").json(f"{path}/metadata")


def templates_document(pool: DataFrame) -> DataFrame:
    """One row, document: the pool as one JSON text of the form {templates: [...], metadata: {...}}; for pools that fit a row."""
    listed = pool.agg(F.sort_array(F.collect_list(F.struct("template_id", *(c for c in pool.columns if c != "template_id")))).alias("templates"))
    meta = F.struct(F.size("templates").alias("total_templates"), F.current_timestamp().alias("saved_at")).alias("metadata")
    return listed.select(F.to_json(F.struct("templates", meta)).alias("document"))


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path, or None."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """The templates written to path; an empty pool if there are none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(TEMPLATE_SCHEMA).json(f"{path}/templates")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TEMPLATE_SCHEMA)


def save_state(path: str, **tables: DataFrame) -> None:
    """Each table as Parquet: templates, clusters, assignments, statistics ..."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_state(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names or ("templates", "assignments")}
