"""Mixing sources to target weights by systematic sampling.

A source's share of the whole size goes by its weight; no target exceeds `most` times the source's size, the excess is
reshared by weight.  Every document of a source expects target / size copies; documents are ordered by (size, doc_id) within
the source, their expected copies summed up, one offset added, and a document is emitted once for each integer boundary
its interval crosses.  The order by size stratifies the sample, so the taken size comes within about the largest document's of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.common import kept, ranked

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target.  Sources weigh `weights` in turn, by code point, null last.

    Each round caps the sources whose share of what is left exceeds `most` times their size; only its three sums reach
    the driver.  Every round caps a source at least, or ends.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    known = kept(ranked(sums, [F.col("source").asc_nulls_last()]).withColumn("w", weight).withColumn("cap", most * F.col("source_size")))
    left = weight_left = None
    capped = F.lit(False)
    while True:
        got = known.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("cap"))).alias("held"), F.sum(F.when(~capped, F.col("w"))).alias("w"), F.count_if(capped).alias("n")).first()
        left, weight_left = (got["all"] or 0) - (got["held"] or 0), got["w"] or 1
        share = F.col("w") * F.lit(left).cast("double") / F.lit(weight_left).cast("double")
        more = capped | (share > F.col("cap"))
        if known.agg(F.count_if(more).alias("n")).first().n == got["n"]:
            break
        # a source stays capped: what is left for the others only grows
        capped = more
    return known.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def offset(source: Column, seed: int = 0) -> Column:
    """The source's offset in [0, 1), by its name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00")))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def copies(sized: DataFrame, seed: int = 0) -> DataFrame:
    """sized (doc_id, source, size, ...; read twice, so pass a kept table) with source_size, target and copies.

    Null sources form one source; a source of size 0 gets no copies; rows alike in (size, doc_id) are interchangeable.
    """
    goal = targets(sized).withColumnRenamed("source", "_s")
    order = ranked(sized, [F.col("size"), F.col("doc_id").asc_nulls_last()], ["source"])
    mixed = order.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = offset(F.col("source"), seed)
    crossed = F.floor(u + (F.col("rank") + 1) * expected) - F.floor(u + F.col("rank") * expected)
    return mixed.withColumn("copies", crossed.cast("long")).drop("rank")


def stage(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix: every document's row as often as it is taken.

    Rows alike in doc_id, source and size share their copies out evenly, in the order of a hash of the text.
    """
    sized = kept(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    taken = copies(sized, seed).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    taken = kept(taken.where("_copies > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), "_copies", "_rows"))
    names = docs.columns
    key = {"_doc": F.col("doc_id"), "_source": F.col("source"), "_size": n_words(F.col("text")), "_text": F.xxhash64("text")}
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), *(v.alias(k) for k, v in key.items()))
    same = F.col("_doc").eqNullSafe(F.col("_d")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_n"))
    mixed = rows.join(taken.where("_rows = 1"), same)
    if not taken.where("_rows > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("_doc", "_source", "_size").orderBy("_text"))
        several = rows.join(taken.where("_rows > 1"), same).withColumn("_place", place)
        share = F.expr("_copies div _rows + cast(_place <= _copies % _rows as bigint)")
        mixed = mixed.unionByName(several.withColumn("_copies", share).drop("_place").where("_copies > 0"))
    mixed = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return mixed.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: doc_id, size, source_size, target, taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = copies(kept(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source),
weighed AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM sums),
filled AS (SELECT *, (SELECT sum(source_size) FROM weighed) - coalesce(sum(cap) OVER before, 0) AS rest, sum(w) OVER after AS open FROM weighed
  WINDOW before AS (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT rest::BIGINT AS rest, open::BIGINT AS open FROM filled WHERE w * rest::DOUBLE / open <= cap ORDER BY cap::DOUBLE / w, k LIMIT 1),
goal AS (SELECT source, source_size, least(cap::DOUBLE, w * rest::DOUBLE / open::DOUBLE) AS target FROM weighed, level),
placed AS (SELECT doc_id, size, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST) - 1 AS i,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e,
  ('0x' || substr(md5('0:' || coalesce(d.source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, ((floor(u + (i + 1) * e) - floor(u + i * e))::BIGINT * size)::BIGINT AS taken FROM placed
"""
