"""The engine: parse a frame, a list or a file of log lines; statistics; state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.text import clean, is_valid
from loomlog.operators import clusters, match, merge, pool, stats
from loomlog.operators.extract import with_templates
from loomlog.operators.tables import kept
from loomlog.sources import files
from loomlog.sources.config import Config

SINGLE, BATCH = 0.9, 0.85


def cleaned(logs: DataFrame, config: Config | None = None) -> DataFrame:
    """logs (seq, content) with cleaned and valid.

    The cleaned text comes out of a generator of one row, through which Spark pushes no filter: a condition on it would
    otherwise repeat all of its regular expressions.
    """
    p = (config or Config()).preprocessing
    text = clean(F.col("content"), p.remove_timestamps, p.remove_ip_addresses, p.normalize_numbers, p.normalize_paths, p.lowercase)
    return logs.select("*", F.explode(F.array(text)).alias("cleaned")).withColumn("valid", is_valid(F.col("cleaned")))


@dataclass
class Result:
    """Lazy tables of one parse.  clusters (path, cluster_id, template_id, ...) where the tree was asked for."""

    rows: DataFrame
    templates: DataFrame
    assignments: DataFrame
    clusters: DataFrame | None = None


class Pipeline:
    """No state but settings: known lines, templates and clusters are passed in and come out as tables."""

    def __init__(self, spark: SparkSession, config: Config | None = None, connect: Callable | None = None, ladder: str = "default", prepare: Callable[[Column], Column] | None = None):
        """connect makes clients of an external extractor, prepare is a step of the caller's own before cleaning, ladder the order of masking."""
        self.spark, self.config, self.connect, self.ladder, self.prepare = spark, config or Config(), connect, ladder, prepare
        if self.config.llm.provider != "heuristic" and connect is None:
            raise ValueError(f"provider {self.config.llm.provider!r} needs connect, which makes its client")

    def _cleaned(self, logs: DataFrame) -> DataFrame:
        if self.prepare is None:
            return cleaned(logs, self.config)
        own = cleaned(logs.withColumn("_original", F.col("content")).withColumn("content", self.prepare(F.col("content"))), self.config)
        return own.withColumn("content", F.col("_original")).drop("_original")

    def parse_batch(self, logs: DataFrame, known: Result | None = None, confidence: float = BATCH, match_mode: str | None = None) -> Result:
        """One row for each of logs (seq, content).

        A line whose text is known takes its template.  With match_mode 'prefix' so does one whose path is in a known cluster, with 'pattern' one
        that a known template's pattern fits.  The others are extracted, once for each distinct text if the extractor is external; invalid
        lines, lines without template and those below min_confidence fall back.  With more than merge_above templates, similar ones are merged, and
        rows and assignments follow.
        """
        if match_mode not in (None, "prefix", "pattern"):
            raise ValueError(f"no match mode {match_mode!r}")
        c = self.config
        rows = self._cleaned(logs)
        use_known = known is not None and c.parsing.use_cache
        if use_known:
            rows = match.by_known_line(rows, known.assignments).withColumnRenamed("template_id", "_id").drop("log_md5")
        else:
            rows = rows.withColumn("_id", F.lit(None).cast("string"))
        if known is not None and match_mode == "prefix" and known.clusters is not None:
            paths = clusters.with_exact_paths(rows, c.prefix_tree.max_depth, delimiter=c.prefix_tree.token_delimiter)
            at = clusters.lookup(paths, known.clusters.where("template_id is not null").select("path", F.col("template_id").alias("cluster_id")))
            rows = at.withColumn("_id", F.when(F.col("valid"), F.coalesce("_id", "cluster_id"))).drop("cluster_id", "path")
        if known is not None and match_mode == "pattern":
            fits = match.by_pattern(rows, known.templates).withColumn("_id", F.when(F.col("valid"), F.coalesce("_id", "template_id")))
            rows = fits.drop("template_id", "template_pattern")
        if known is not None:
            rows = rows.join(known.templates.select(F.col("template_id").alias("_id"), F.col("template_pattern").alias("_known")), "_id", "left")
        mined = with_templates(rows, self.connect, ladder=self.ladder, retries=c.llm.max_retries, delay=c.llm.retry_delay)
        if known is not None:
            mined = mined.withColumn("template_pattern", F.coalesce("_known", "template_pattern")).withColumn("_found", F.col("_known").isNotNull()).drop("_known")
        mined = mined.drop("_id").withColumn("template_pattern", F.when(F.col("valid") & F.lit(confidence >= c.parsing.min_confidence), F.col("template_pattern")))
        # a line's regular expressions cost far more than to write and read it, and its row is needed three times
        mined = kept(mined)
        templates = pool.mined(mined, confidence=confidence).select("template_id", "template_pattern", "count", "first_seq", "confidence")
        if known is not None:
            templates = pool.upsert(known.templates, templates)
        templates = kept(templates)
        # the pool has a row for each pattern: Spark broadcasts it if its size allows
        named = mined.join(templates.select("template_id", "template_pattern"), "template_pattern", "left")
        found = named.where("valid and template_id is not null").groupBy(F.md5(F.col("content").cast("binary")).alias("log_md5")).agg(F.min("template_id").alias("template_id"))
        if known is not None:
            found = known.assignments.select("log_md5", "template_id").join(found, "log_md5", "left_anti").unionByName(found)
        if c.merging.enable_auto_merge:
            merged = merge.merged_pool(templates, c.merging.merge_above, c.merging.merge_threshold, c.merging.max_edit_distance)
            if merged is not None:
                templates, remap = merged
                found = pool.remapped(found, remap)
                named = pool.remapped(named, remap).drop("template_pattern").join(templates.select("template_id", "template_pattern"), "template_id", "left")
        parsed = match.parsed(named, confidence)
        found_clusters = None
        if match_mode == "prefix":
            found_clusters = self._clusters(rows, parsed.select("seq", "template_id"))
            if known is not None and known.clusters is not None:
                old = known.clusters
                found_clusters = old.unionByName(found_clusters.join(old.select("path"), "path", "left_anti"), allowMissingColumns=True)
        return Result(parsed, templates, found, found_clusters)

    def _clusters(self, rows: DataFrame, assigned: DataFrame) -> DataFrame:
        t = self.config.prefix_tree
        paths = clusters.with_exact_paths(rows.where("valid").select("seq", "cleaned", F.col("seq").cast("string").alias("log_id")), t.max_depth, delimiter=t.token_delimiter)
        return match.cluster_templates(paths, clusters.clusters(paths, t.min_cluster_size), assigned)

    def parse_list(self, logs: list[str]) -> list:
        """Rows in the order of the list; for lists that fit the driver."""
        return self.parse_batch(files.list_lines(self.spark, logs)).rows.orderBy("seq").collect()

    def parse(self, log: str):
        return self.parse_batch(files.list_lines(self.spark, [log]), confidence=SINGLE).rows.first()

    def parse_file(self, path: str, column: str = "log", output: str | None = None) -> DataFrame:
        """The seven-column result of a file; written as CSV too if output is given."""
        out = match.file_result(self.parse_batch(files.lines(self.spark, path, column)).rows)
        if output:
            files.write_csv(out, output)
        return out

    def tree(self, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(paths, clusters) of the valid lines."""
        t = self.config.prefix_tree
        rows = self._cleaned(logs).where("valid").withColumn("log_id", F.col("seq").cast("string"))
        if self.config.preprocessing.remove_duplicates:  # the first line of each cleaned text
            rows = rows.groupBy("cleaned").agg(F.min(F.struct("seq", *(c for c in rows.columns if c not in ("seq", "cleaned")))).alias("r")).select("cleaned", "r.*")
        if t.enable_fuzzy_matching:
            paths = clusters.with_fuzzy_paths(rows, t.max_depth, t.fuzzy_threshold, delimiter=t.token_delimiter)
        else:
            paths = clusters.with_exact_paths(rows, t.max_depth, delimiter=t.token_delimiter)
        paths = kept(paths)
        return paths, clusters.clusters(paths, t.min_cluster_size)

    def statistics(self, result: Result, paths: DataFrame, found: DataFrame, calls: DataFrame) -> DataFrame:
        """One row of structs: parse, tree, pool, llm, cache."""
        return stats.document(
            stats.parse_stats(result.rows), clusters.tree_stats(paths, found, self.config.prefix_tree.max_depth), pool.stats(result.templates, result.assignments),
            stats.usage(calls), stats.cache_stats(result.rows, result.assignments, ttl=self.config.parsing.cache_ttl, backend=self.config.parsing.cache_type),
        )

    def save_state(self, path: str, result: Result) -> None:
        clusters_ = {} if result.clusters is None else {"clusters": result.clusters}
        files.save_state(path, templates=result.templates, assignments=result.assignments, statistics=stats.parse_stats(result.rows), **clusters_)

    def load_state(self, path: str) -> Result:
        """Templates, assignments and, where they were saved, clusters; rows are not kept."""
        tables = files.load_state(self.spark, path, "templates", "assignments")
        return Result(self.spark.createDataFrame([], "seq bigint"), tables["templates"], tables["assignments"], files.read_if_there(self.spark, f"{path}/clusters"))
