"""Assigning lines to templates: by known line, by prefix cluster, by pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.similarity import template_regex, variables
from loomlog.functions.text import level_of, timestamp_of

UNKNOWN = "unknown"


def by_known_line(logs: DataFrame, assignments: DataFrame, text: str = "content") -> DataFrame:
    """logs with template_id (null: not known) and cache_hit.  assignments: log_md5, template_id."""
    keyed = logs.withColumn("log_md5", F.md5(F.col(text).cast("binary")))
    return keyed.join(assignments.select("log_md5", "template_id"), "log_md5", "left").withColumn("cache_hit", F.col("template_id").isNotNull())


def unknown_lines(logs: DataFrame, assignments: DataFrame, text: str = "content") -> DataFrame:
    keyed = logs.withColumn("log_md5", F.md5(F.col(text).cast("binary")))
    return keyed.join(assignments.select("log_md5"), "log_md5", "left_anti")


def by_pattern(logs: DataFrame, templates: DataFrame, text: str = "cleaned") -> DataFrame:
    """logs with the most specific template (most constant characters, then least id) whose regular expression fits, else null.

    A template's longest constant word is in every text that fits it, so distinct texts meet templates on words: an
    equi-join.  Only templates without any constant word meet all distinct texts.
    """
    longest = F.array_max(F.transform(F.filter(F.split("template_pattern", " "), lambda w: (w != "") & ~w.contains("<*>")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    shaped = templates.select("template_id", "template_pattern", template_regex(F.col("template_pattern")).alias("_rx"), F.length(F.replace("template_pattern", F.lit("<*>"), F.lit(""))).alias("_fixed"), longest["w"].alias("_word"))
    texts = logs.select(F.col(text).alias("_text")).where("_text <> ''").distinct()
    spread = texts.select("_text", F.explode(F.array_distinct(F.split("_text", " "))).alias("_word"))
    same = spread.join(shaped.where("_word is not null"), "_word").where("_text rlike _rx")
    open_ = texts.join(shaped.where("_word is null").drop("_word"), F.expr("_text rlike _rx"))
    columns = ["_text", "template_id", "template_pattern", "_fixed"]
    best = same.select(*columns).unionByName(open_.select(*columns)).groupBy("_text").agg(F.min_by(F.struct("template_id", "template_pattern"), F.struct(-F.col("_fixed"), "template_id")).alias("_t"))
    return logs.join(best, logs[text] == best["_text"], "left").select(*logs.columns, F.col("_t.template_id").alias("template_id"), F.col("_t.template_pattern").alias("template_pattern"))


def cluster_templates(paths: DataFrame, found: DataFrame, assigned: DataFrame) -> DataFrame:
    """Clusters with template_id: that of the first of a cluster's lines.  paths: seq, path; assigned: seq, template_id."""
    first = paths.join(found.select("path", "cluster_id"), "path").join(assigned.select("seq", "template_id"), "seq").groupBy("cluster_id").agg(F.min_by("template_id", "seq").alias("template_id"))
    return found.join(first, "cluster_id", "left")


def parsed(rows: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Parsed rows: seq, original, template_id, template_pattern, variables, timestamp, log_level, component, confidence, metadata,
    processing_time_ms, used_llm, cache_hit.  rows: seq, content, cleaned, valid, template_id, template_pattern[, cache_hit].

    A row without template is a fallback: id 'unknown', pattern the line itself, confidence 0.
    """
    ok = F.col("valid") & F.col("template_id").isNotNull()
    hit = F.col("cache_hit") if "cache_hit" in rows.columns else F.lit(False)
    none = F.create_map().cast("map<string,string>")
    return rows.select(
        "seq", F.col("content").alias("original"), F.when(ok, F.col("template_id")).otherwise(UNKNOWN).alias("template_id"),
        F.when(ok, F.col("template_pattern")).otherwise(F.coalesce("content", F.lit(""))).alias("template_pattern"),
        F.when(ok, variables(F.col("cleaned"), F.col("template_pattern"))).otherwise(none).alias("variables"),
        F.try_to_timestamp(timestamp_of(F.col("content"))).alias("timestamp"), level_of(F.col("content")).alias("log_level"), F.lit(None).cast("string").alias("component"),
        F.when(ok, F.lit(confidence)).otherwise(0.0).alias("confidence"), none.alias("metadata"), F.lit(0.0).alias("processing_time_ms"),
        (ok & ~hit).alias("used_llm"), (ok & hit).alias("cache_hit"),
    )


def file_result(rows: DataFrame) -> DataFrame:
    """The seven columns of a parsed file."""
    return rows.select("original", "template_id", F.col("template_pattern").alias("template"), "confidence", "used_llm", "cache_hit", "processing_time_ms")


def structured(rows: DataFrame) -> DataFrame:
    """Six keys, the timestamp in ISO form."""
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select("seq", F.col("template_pattern").alias("template"), "variables", iso.alias("timestamp"), F.col("log_level").alias("level"), "component", "confidence")
