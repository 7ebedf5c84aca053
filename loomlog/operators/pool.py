"""The template pool as a table: upsert, examples, removal, merging and statistics.

A pool row: template_id, template_pattern, static_tokens, variable_positions, example_logs, count, confidence, created_at, updated_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.similarity import static_tokens
from loomlog.functions.text import WILDCARD, words
from loomlog.operators.tables import kept, ranked

EXAMPLES = 10


def template_id(number: Column) -> Column:
    return F.format_string("tmpl_%04d", number)


def mined(rows: DataFrame, text: str = "cleaned", confidence: float = 0.9) -> DataFrame:
    """Templates of rows (seq, template_pattern, text), numbered in the order of their first row.

    One aggregation with partial sums, kept; only distinct patterns are numbered, by a distributed rank.  count is the number of rows.
    """
    # a condition on an aggregate: one on the pattern would be pushed down and repeat what makes the pattern
    found = rows.groupBy("template_pattern").agg(F.count(F.lit(1)).alias("count"), F.min("seq").alias("first_seq"), F.max(F.trim("template_pattern") != "").alias("_some")).where("_some").drop("_some")
    numbered = ranked(kept(found), [F.col("first_seq"), F.col("template_pattern")], name="_number")
    return numbered.withColumn("template_id", template_id(F.col("_number"))).withColumn("confidence", F.lit(confidence)).drop("_number")


def pool_rows(found: DataFrame, examples: DataFrame, now: Column | None = None) -> DataFrame:
    """Full pool rows from mined() and last_examples()."""
    now = F.current_timestamp() if now is None else now
    listed = examples.groupBy("template_pattern").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "example"))), lambda e: e["example"]).alias("example_logs"))
    positions = F.filter(F.transform(words(F.col("template_pattern")), lambda t, i: F.when(t.contains(WILDCARD), i)), lambda i: i.isNotNull())
    none = F.array().cast("array<string>")
    return found.join(listed, "template_pattern", "left").select(
        "template_id", "template_pattern", static_tokens(F.col("template_pattern")).alias("static_tokens"), positions.alias("variable_positions"),
        F.coalesce("example_logs", none).alias("example_logs"), "count", "confidence", now.alias("created_at"), now.alias("updated_at"),
    )


def last_examples(rows: DataFrame, text: str = "cleaned", n: int = EXAMPLES) -> DataFrame:
    """template_pattern, seq, example: of each template its `n` distinct texts seen last (a text counts where it is first seen)."""
    first = rows.groupBy("template_pattern", F.col(text).alias("example")).agg(F.min("seq").alias("seq"))
    # the last n of each part of a template's texts, then of these: no task sorts a frequent template's texts
    salted = Window.partitionBy("template_pattern", "_salt").orderBy(F.desc("seq"))
    few = first.withColumn("_salt", F.pmod(F.xxhash64("example"), F.lit(64))).withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= n)
    latest = F.row_number().over(Window.partitionBy("template_pattern").orderBy(F.desc("seq")))
    return few.withColumn("_n", latest).where(F.col("_n") <= n).drop("_n", "_salt")


def top(pool: DataFrame, n: int = 10) -> DataFrame:
    """The n templates of most rows; ties in order of first row."""
    return pool.orderBy(F.desc("count"), "first_seq").limit(n)


def upsert(pool: DataFrame, fresh: DataFrame) -> DataFrame:
    """template_id, template_pattern, count, first_seq, confidence: counts of equal patterns add up, new patterns get the ids after the largest."""
    columns = ["template_id", "template_pattern", "count", "first_seq", "confidence"]
    largest = pool.agg(F.coalesce(F.max(F.regexp_extract("template_id", r"(\d+)$", 1).cast("long")), F.lit(-1)).alias("_largest"))
    new = kept(fresh.join(pool.select("template_pattern"), "template_pattern", "left_anti").select("template_pattern", "count", "first_seq", "confidence"))
    new = ranked(new, [F.col("first_seq"), F.col("template_pattern")], name="_number").join(F.broadcast(largest))
    new = new.withColumn("template_id", template_id(F.col("_largest") + 1 + F.col("_number")))
    seen = fresh.select("template_pattern", F.col("count").alias("_more"))
    old = pool.select(*columns).join(seen, "template_pattern", "left").withColumn("count", F.col("count") + F.coalesce("_more", F.lit(0)))
    return old.select(*columns).unionByName(new.select(*columns))


def removed(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the template_ids of `gone`; applies to the pool and to assignments alike."""
    return table.join(gone.select("template_id").distinct(), "template_id", "left_anti")


def remapped(assignments: DataFrame, remap: DataFrame) -> DataFrame:
    """Assignments with merged ids replaced.  remap: template_id, leader_id."""
    joined = assignments.join(remap, "template_id", "left")
    return joined.withColumn("template_id", F.coalesce("leader_id", "template_id")).drop("leader_id")


def stats(pool: DataFrame, assignments: DataFrame) -> DataFrame:
    """total_templates, total_logs, avg_logs_per_template, avg_confidence, associations; zeros for an empty pool."""
    one = pool.agg(F.count(F.lit(1)).alias("total_templates"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_logs"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
    mean = F.coalesce(F.try_divide("total_logs", "total_templates"), F.lit(0.0))
    return one.join(assignments.agg(F.count(F.lit(1)).alias("associations"))).withColumn("avg_logs_per_template", mean)
