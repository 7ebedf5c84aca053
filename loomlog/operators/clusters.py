"""Prefix clustering: the token trie as a table of paths.

A node is the array of the first 1 to `depth` tokens of some line; a cluster is a node at full depth (or where a line ends) that `least`
distinct lines reach.  Exact clustering is one aggregation.  Fuzzy clustering replaces each token by the leader it was
assigned to, level by level; the set form equals sequential insertion.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.similarity import KINDS, token_similarity
from loomlog.functions.text import tokens
from loomlog.operators.tables import kept, ranked


def path(text: Column, depth: int = 5, delimiter: str = " ") -> Column:
    return F.slice(tokens(text, delimiter), 1, depth)


def with_exact_paths(logs: DataFrame, depth: int = 5, text: str = "cleaned", delimiter: str = " ") -> DataFrame:
    """logs with path."""
    return logs.withColumn("path", path(F.col(text), depth, delimiter))


def clusters(paths: DataFrame, least: int = 3) -> DataFrame:
    """path, size (distinct log_ids), reached (the seq at which the `least`th distinct one arrived), cluster_id.

    paths: log_id, seq, path.  Ids are numbered in the order in which paths reach `least`; only clusters, not lines, are numbered.
    """
    first = paths.groupBy("path", "log_id").agg(F.min("seq").alias("seq"))
    sizes = first.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    # the first `least` of each part of a path's lines, then of these: no task sorts a frequent path's lines
    salted = Window.partitionBy("path", "_salt").orderBy("seq")
    few = first.withColumn("_salt", F.pmod(F.xxhash64("log_id"), F.lit(64))).withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= least)
    arrival = F.row_number().over(Window.partitionBy("path").orderBy("seq"))
    early = few.withColumn("_n", arrival).where(F.col("_n") == least).select("path", F.col("seq").alias("reached"))
    found = kept(sizes.join(early, "path"))
    numbered = ranked(found, [F.col("reached"), F.col("path")], name="_number")
    return numbered.withColumn("cluster_id", F.format_string("clus_%04d", "_number")).drop("_number")


def members(paths: DataFrame, found: DataFrame) -> DataFrame:
    """cluster_id, log_id of each distinct member."""
    return paths.join(found.select("path", "cluster_id"), "path").select("cluster_id", "log_id").distinct()


def nodes(paths: DataFrame) -> DataFrame:
    """Each node below the root: path, depth, parent, token, lines, first_seq."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    spread = paths.where(F.size("path") > 0).select("log_id", "seq", F.explode(prefixes).alias("path"))
    counted = spread.groupBy("path").agg(F.count_distinct("log_id").alias("lines"), F.min("seq").alias("first_seq"))
    n = F.size("path")
    return counted.select("path", n.alias("depth"), F.slice("path", F.lit(1), n - 1).alias("parent"), F.element_at("path", n).alias("token"), "lines", "first_seq")


def tree_stats(paths: DataFrame, found: DataFrame, depth: int = 5) -> DataFrame:
    """total_logs, num_clusters, avg_cluster_size, max_depth, total_nodes (the root included)."""
    n_nodes = nodes(paths).agg((F.count(F.lit(1)) + 1).alias("total_nodes"))
    total, count = paths.agg(F.count(F.lit(1)).alias("total_logs")), found.agg(F.count(F.lit(1)).alias("num_clusters"))
    average = F.when(F.col("num_clusters") > 0, F.col("total_logs") / F.col("num_clusters")).otherwise(0.0)
    return total.join(count).join(n_nodes).select("total_logs", "num_clusters", average.alias("avg_cluster_size"), F.lit(depth).alias("max_depth"), "total_nodes")


def lookup(paths: DataFrame, found: DataFrame) -> DataFrame:
    """paths with the cluster of the shallowest prefix that is one, else null."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    at = paths.where(F.size("path") > 0).select("seq", F.explode(prefixes).alias("prefix")).join(found.select(F.col("path").alias("prefix"), "cluster_id"), "prefix")
    best = at.groupBy("seq").agg(F.min_by("cluster_id", F.size("prefix")).alias("cluster_id"))
    return paths.join(best, "seq", "left")


#: As in token_similarity(): ASCII digits beside '.' and '-', and the kinds, whole tokens.
_NUMERIC = re.compile(r"(?=[.-]*[0-9])[0-9.-]+\Z")
_KINDS = [re.compile(k.replace(r"\d", "[0-9]").replace("$", r"\Z")) for k in KINDS]


def _similar(a: str, b: str, threshold: float) -> float:
    """token_similarity() for two tokens that differ, or 0 if it is below the threshold."""
    if _NUMERIC.match(a) and _NUMERIC.match(b):
        return 0.9
    if any(k.match(a) and k.match(b) for k in _KINDS):
        return 0.85
    longer = max(len(a), len(b))
    if abs(len(a) - len(b)) > (1 - threshold) * longer + 1e-9:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return 1 - row[-1] / longer


def _pieces(n: int, parts: int) -> list[tuple[int, int]]:
    return [(i * n // parts, (i + 1) * n // parts) for i in range(parts)]


def _keys(token: str, threshold: float) -> list[str]:
    """Keys of which two different tokens have one in common if token_similarity() gives them `threshold` or more.

    Numeric tokens share one, as do the tokens of a kind.  Otherwise at most k characters of the longer token's length are edited, so of
    k + 1 pieces of the shorter one some is whole in the longer one, moved by k places at most.
    """
    keys = set()
    if threshold <= 0.9 and _NUMERIC.match(token):
        keys.add("n")
    if threshold <= 0.85:
        keys.update(f"k{i}" for i, k in enumerate(_KINDS) if k.match(token))
    n, edits = len(token), lambda longer: int((1 - threshold) * longer + 1e-9)
    for longer in range(n, int(n / threshold + 1e-9) + 1):  # as the shorter one
        k = edits(longer)
        keys.update(f"{n}/{longer}/{i}/{token[a:b]}" for i, (a, b) in enumerate(_pieces(n, k + 1)))
    k = edits(n)
    for shorter in range(max(n - k, 0), n + 1):  # as the longer one
        for i, (a, b) in enumerate(_pieces(shorter, k + 1)):
            keys.update(f"{shorter}/{n}/{i}/{token[at:at + b - a]}" for at in range(max(a - k, 0), min(a + k, n - (b - a)) + 1))
    return sorted(keys)


def _leaders(threshold: float):
    """Of each parent's distinct tokens, in order of arrival, those that no earlier leader is similar to.

    Leaders are found by their keys, so the work grows with the tokens and not with the pairs of them.
    """

    def choose(batch: pd.DataFrame) -> pd.DataFrame:
        chosen: list[tuple[str, int]] = []
        by_key: dict[str, list[str]] = {}
        for token, seq in batch.sort_values(["first_seq", "token"])[["token", "first_seq"]].itertuples(index=False):
            keys = _keys(token, threshold)
            tried: set[str] = set()
            for other in (o for k in keys for o in by_key.get(k, ())):
                if other not in tried:
                    tried.add(other)
                    if (s := _similar(token, other, threshold)) >= threshold and s > 0:
                        break
            else:
                chosen.append((token, seq))
                for k in keys:
                    by_key.setdefault(k, []).append(token)
        return pd.DataFrame({"parent": [batch["parent"].iloc[0]] * len(chosen), "leader": [t for t, _ in chosen], "created": [s for _, s in chosen]})

    return choose


def with_fuzzy_paths(logs: DataFrame, depth: int = 5, threshold: float = 0.8, text: str = "cleaned", delimiter: str = " ") -> DataFrame:
    """logs with path, its tokens replaced by their leaders.

    A level takes distinct (parent, token) only; each occurrence goes to the most similar leader that existed when it came (ties:
    the earliest).  Tokens meet leaders on keys that similar ones share.  The result of every level is kept, so the lineage stays short.
    """
    sep = "\u0001"

    @F.pandas_udf("array<string>")
    def keys(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: _keys(t, max(threshold, 0.05)))

    state = logs.withColumn("_t", path(F.col(text), depth, delimiter)).withColumn("_p", F.lit(""))
    for level in range(1, depth + 1):
        here = state.where(F.size("_t") >= level).select("seq", F.col("_p").alias("parent"), F.element_at("_t", level).alias("token"))
        distinct = kept(here.groupBy("parent", "token").agg(F.min("seq").alias("first_seq")))
        leaders = kept(distinct.groupBy("parent").applyInPandas(_leaders(max(threshold, 0.05)), "parent string, leader string, created long"))
        spread = lambda df, c: df.withColumn("_k", F.explode(keys(F.col(c))))
        same = leaders.select("parent", F.col("leader").alias("token"), "leader", "created")
        met = spread(distinct.select("parent", "token"), "token").join(spread(leaders, "leader"), ["parent", "_k"]).select("parent", "token", "leader", "created").unionByName(same).distinct()
        pairs = met.withColumn("s", token_similarity(F.col("token"), F.col("leader"))).where((F.col("s") >= threshold) & (F.col("s") > 0))
        rows = here.join(pairs, ["parent", "token"]).where("created <= seq")
        chosen = rows.groupBy("seq").agg(F.min_by("leader", F.struct(-F.col("s"), "created")).alias("_leader"))
        state = state.join(chosen, "seq", "left").withColumn("_p", F.when(F.col("_leader").isNotNull(), F.concat("_p", F.lit(sep), "_leader")).otherwise(F.col("_p"))).drop("_leader")
        state = kept(state)
    return state.withColumn("path", F.filter(F.split("_p", sep), lambda t: t != "")).drop("_t", "_p")


def drawn(paths: DataFrame, found: DataFrame) -> DataFrame:
    """position, line of a drawing of the tree; children in order of arrival.  For trees a person can read."""
    tree = nodes(paths).join(found.select("path", "cluster_id", "size"), "path", "left")
    rank = Window.partitionBy("parent").orderBy("first_seq", "token")
    last = F.lead("token").over(rank).isNull()
    ranked = kept(tree.withColumn("last", last).withColumn("place", F.format_string("%08d", F.row_number().over(rank))))
    steps = ranked.select(F.col("path").alias("_up"), F.col("place").alias("_place"), F.col("last").alias("_last"))
    spread = ranked.withColumn("_d", F.explode(F.sequence(F.lit(1), F.col("depth")))).withColumn("_up", F.slice("path", F.lit(1), F.col("_d")))
    joined = spread.join(steps, "_up").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_d", "_place", "_last"))).alias("ups"))
    full = ranked.join(joined, "path")
    bars = F.transform(F.slice("ups", F.lit(1), F.col("depth") - 1), lambda u: F.when(u["_last"], F.lit("    ")).otherwise(F.lit("│   ")))
    label = F.concat("token", F.when(F.col("cluster_id").isNotNull(), F.format_string(" [%s, %d logs]", "cluster_id", "size")).otherwise(F.lit("")))
    line = F.concat(F.lit("    "), F.array_join(bars, ""), F.when(F.col("last"), F.lit("└── ")).otherwise(F.lit("├── ")), label)
    below = full.select(F.array_join(F.transform("ups", lambda u: u["_place"]), ".").alias("position"), line.alias("line"))
    root = paths.sparkSession.createDataFrame([("", "<ROOT>")], "position string, line string")
    return root.unionByName(below).orderBy("position")
