"""Statistics of parsing, of the line cache and of extractor calls: one-row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.prompts import cost
from loomlog.operators.match import UNKNOWN


def parse_stats(rows: DataFrame, calls: int | None = None) -> DataFrame:
    """From parsed rows.  total counts all rows, failed the fallbacks; efficiency is lines for each extractor call, infinite without calls."""
    one = rows.agg(
        F.count(F.lit(1)).alias("total_logs"), F.count_if(F.col("template_id") == UNKNOWN).alias("failed"), F.count_if("cache_hit").alias("cache_hits"),
        F.count_if("used_llm").alias("_used"), F.count_distinct(F.when(F.col("template_id") != UNKNOWN, F.col("template_id"))).alias("unique_templates"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"), F.coalesce(F.sum("processing_time_ms"), F.lit(0.0)).alias("total_processing_time_ms"),
    )
    n = F.col("total_logs")
    share = lambda a: F.coalesce(F.try_divide(a.cast("double"), n), F.lit(0.0))
    used = F.col("_used") if calls is None else F.lit(calls)
    return one.select(
        "total_logs", "failed", "cache_hits", used.cast("long").alias("llm_calls"), "unique_templates", "average_confidence", "total_processing_time_ms",
        share(F.col("cache_hits")).alias("cache_hit_rate"), share(n - F.col("failed")).alias("success_rate"),
        F.when(used == 0, F.lit(float("inf"))).otherwise(n / used).alias("llm_efficiency"), share(F.col("total_processing_time_ms")).alias("avg_time_per_log_ms"),
    )


def cache_stats(probes: DataFrame, assignments: DataFrame, max_size: int = 10_000, ttl: int = 86_400, backend: str = "table") -> DataFrame:
    """From probed lines (cache_hit) and the stored assignments."""
    one = probes.agg(F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses")).join(assignments.agg(F.count(F.lit(1)).alias("size")))
    return one.select(
        F.lit(backend).alias("backend"), "hits", "misses", F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("misses")), F.lit(0.0)).alias("hit_rate"),
        F.lit(ttl).alias("ttl"), "size", F.lit(max_size).alias("max_size"), (F.col("size") / F.lit(float(max_size))).alias("utilization"),
    )


def usage(calls: DataFrame) -> DataFrame:
    """calls: tokens, model."""
    one = calls.agg(F.count(F.lit(1)).alias("total_calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.round(F.coalesce(F.sum(cost(F.col("tokens"), F.col("model"))), F.lit(0.0)), 4).alias("estimated_cost_usd"))
    return one.withColumn("avg_tokens_per_call", F.coalesce(F.try_divide(F.col("total_tokens").cast("double"), F.col("total_calls")), F.lit(0.0)))


def document(parse: DataFrame, tree: DataFrame, pool: DataFrame, llm: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """One row of structs: parse, tree, pool, llm and, where there is one, cache."""
    out = None
    for name, part in (("parse", parse), ("tree", tree), ("pool", pool), ("llm", llm), ("cache", cache)):
        if part is not None:
            one = part.select(F.struct(*part.columns).alias(name))
            out = one if out is None else out.join(one)
    return out
