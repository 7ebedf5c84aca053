"""Merging similar templates: candidate pairs by blocking, greedy leaders, folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.similarity import merge_pad, merge_truncate, pattern_similarity, should_merge
from loomlog.functions.text import words
from loomlog.operators.components import components
from loomlog.operators.tables import kept, ranked

PENALTY = 0.95


def _blocks(ts: Column, share: float, longer: bool) -> Column:
    """Keys of which two patterns have one in common if at least `share` of the places of the longer one are equal.

    Of n places at most k differ, so of k + 1 stretches of places one is equal.  A pattern gives a key for each stretch of its own
    length, or, as the shorter one, for those of every length that the longer one may have.
    """
    n = F.size(ts)
    apart = lambda m: F.floor(m * (1 - share) + 1e-9).cast("int") + 1
    edge = lambda m, s: F.floor(s * m / apart(m)).cast("int")
    one = lambda m: F.transform(F.sequence(F.lit(0), apart(m) - 1), lambda s: F.struct(m.alias("n"), s.alias("s"), F.xxhash64(F.slice(ts, edge(m, s) + 1, edge(m, s + 1) - edge(m, s))).alias("h")))
    lengths = F.array(n) if longer else F.sequence(n, F.floor(n / share + 1e-9).cast("int"))
    return F.when(n > 0, F.flatten(F.transform(lengths, one)))


def mergeable_pairs(templates: DataFrame, threshold: float = 0.9, max_edit: int = 3) -> DataFrame:
    """i < j, p, q, similarity of templates (i, p) that should merge.

    At most `max_edit` edits change the length by as much, so pairs meet on a length within that range: an equi-join.  Without such a bound, a similarity
    of `threshold` asks for (threshold - 0.3) / 0.7 of the places to be equal, so they meet on stretches of words, and where that is nothing
    on a common word.
    """
    share = (threshold - 0.3) / 0.7
    left = templates.select(F.col("i"), F.col("p"))
    right = templates.select(F.col("i").alias("j"), F.col("p").alias("q"))
    if max_edit:
        near = left.withColumn("_b", F.explode(F.sequence(F.length("p") - max_edit, F.length("p") + max_edit))).join(right.withColumn("_b", F.length("q")), "_b").where("i < j")
    elif share > 0.05:
        # the words are a column of their own: an expression would be split anew for every stretch
        left = left.withColumn("_ts", words(F.col("p"))).withColumn("_b", F.explode(_blocks(F.col("_ts"), share, True))).drop("_ts")
        right = right.withColumn("_ts", words(F.col("q"))).withColumn("_b", F.explode(_blocks(F.col("_ts"), share, False))).drop("_ts")
        near = left.join(right, "_b").where("i <> j")
        swap = F.col("i") > F.col("j")
        sides = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("i", "j"), ("j", "i"), ("p", "q"), ("q", "p"))]
        near = near.select(*sides).distinct()
    else:  # a similarity above 0 asks for a common word; 0 for nothing
        word = lambda c: F.explode(F.array_distinct(words(F.col(c)))) if threshold > 0 else F.lit(0)
        near = left.withColumn("_b", word("p")).join(right.withColumn("_b", word("q")), "_b").where("i < j").select("i", "j", "p", "q").distinct()
    near = near.where(should_merge(F.col("p"), F.col("q"), threshold, max_edit))
    return near.select("i", "j", "p", "q", pattern_similarity(F.col("p"), F.col("q")).alias("similarity"))


def _greedy(batch: pd.DataFrame) -> pd.DataFrame:
    """In order of i each template that no earlier leader has absorbed leads, and absorbs the unused j > i it should merge with."""
    used, out = set(), []
    for i, js in batch.sort_values(["i", "j"]).groupby("i")["j"]:
        if i not in used:
            for j in js:
                if j not in used:
                    used.add(j)
                    out.append((i, j))
    return pd.DataFrame(out, columns=["leader", "member"])


def ordered(pairs: DataFrame) -> DataFrame:
    """Mergeable pairs with place, from 0: the most similar first, then by i and j."""
    return ranked(kept(pairs), [F.desc("similarity"), F.col("i"), F.col("j")], name="place")


def leaders(pairs: DataFrame) -> DataFrame:
    """leader, member.  Templates that no chain of pairs connects can't absorb each other: the greedy order runs within components."""
    pairs = kept(pairs.select("i", "j"))
    within = components(pairs.select(F.col("i").alias("u"), F.col("j").alias("v")))
    grouped = pairs.join(within, pairs["i"] == within["node"]).select("label", "i", "j")
    return grouped.groupBy("label").applyInPandas(lambda b: _greedy(b.drop(columns="label")), "leader long, member long")


#: What a pool may hold besides; each is folded where it is there.
_FOLDS = {
    "example_logs": lambda ms: F.slice(F.flatten(F.transform(ms, lambda m: m["example_logs"])), 1, 10),
    "static_tokens": lambda ms: F.aggregate(F.slice(ms, F.lit(2), F.greatest(F.size(ms) - 1, F.lit(0))), F.element_at(ms, 1)["static_tokens"], lambda acc, m: F.array_intersect(acc, m["static_tokens"])),
    "created_at": lambda ms: F.element_at(ms, 1)["created_at"],
    "first_seq": lambda ms: F.element_at(ms, 1)["first_seq"],
}


def merged(templates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Templates after merge_batch: i, p, count, confidence, merges[, example_logs, static_tokens, created_at, first_seq], members.

    templates: i, p, count, confidence and any of the others.  The pattern is folded over members in order (padding), counts add up, confidence is the
    running minimum times PENALTY at each step; the first ten examples stay, static tokens that all have, and the leader's creation.
    """
    lead = leaders(pairs)
    folds = {c: f for c, f in _FOLDS.items() if c in templates.columns}
    rows = templates.join(lead.withColumnRenamed("member", "i"), "i", "left").withColumn("leader", F.coalesce("leader", "i"))
    listed = rows.groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("i", "p", "count", "confidence", *folds))).alias("ms"))
    rest = F.slice("ms", F.lit(2), F.greatest(F.size("ms") - 1, F.lit(0)))
    confidence = F.aggregate(rest, F.element_at("ms", 1)["confidence"].cast("double"), lambda acc, m: F.least(acc, m["confidence"]) * PENALTY)
    pattern = F.aggregate(rest, F.element_at("ms", 1)["p"], lambda acc, m: merge_pad(acc, m["p"]))
    count = F.aggregate("ms", F.lit(0).cast("long"), lambda acc, m: acc + m["count"])
    others = [f(F.col("ms")).alias(c) for c, f in folds.items()]
    return listed.select(F.col("leader").alias("i"), pattern.alias("p"), count.alias("count"), confidence.alias("confidence"), (F.size("ms") - 1).alias("merges"), *others, F.transform("ms", lambda m: m["i"]).alias("members"))


def pool_merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two one-row pools into one row: counts add up, least confidence, patterns cut to the shorter, all examples (where both have them)."""
    a, b = first.alias("a"), second.alias("b")
    both = [F.concat("a.example_logs", "b.example_logs").alias("example_logs")] if "example_logs" in first.columns and "example_logs" in second.columns else []
    return a.join(b).select(
        F.col("a.template_id").alias("template_id"), merge_truncate(F.col("a.template_pattern"), F.col("b.template_pattern")).alias("template_pattern"),
        (F.col("a.count") + F.col("b.count")).alias("count"), F.least("a.confidence", "b.confidence").alias("confidence"), *both,
    )


def auto_merge(templates: DataFrame, above: int = 100, threshold: float = 0.9, max_edit: int = 3) -> DataFrame:
    """merged() if there are more than `above` templates, else the templates as they are, with merges 0 and themselves as members."""
    if templates.limit(above + 1).count() <= above:
        return templates.withColumn("merges", F.lit(0)).withColumn("members", F.array("i"))
    return merged(templates, kept(mergeable_pairs(templates, threshold, max_edit)))


def merged_pool(pool: DataFrame, above: int = 100, threshold: float = 0.9, max_edit: int = 3) -> tuple[DataFrame, DataFrame] | None:
    """(pool, remap: template_id, leader_id) after auto_merge(), or None where there is nothing to merge.

    pool: template_id, template_pattern, count, first_seq, confidence.  A leader keeps its id and takes the folded pattern.
    """
    if pool.limit(above + 1).count() <= above:
        return None
    numbered = kept(pool.select(F.regexp_extract("template_id", r"(\d+)$", 1).cast("long").alias("i"), F.col("template_pattern").alias("p"), "count", "confidence", "first_seq", "template_id"))
    pairs = kept(mergeable_pairs(numbered, threshold, max_edit))
    if pairs.isEmpty():
        return None
    found = kept(merged(numbered.drop("template_id"), pairs))
    named = numbered.select("i", "template_id")
    out = found.join(named, "i").select("template_id", F.col("p").alias("template_pattern"), "count", "first_seq", "confidence")
    members = found.where("merges > 0").select("i", F.explode("members").alias("m")).where("m <> i").join(named.select("i", F.col("template_id").alias("leader_id")), "i")
    return out, members.join(named.select(F.col("i").alias("m"), "template_id"), "m").select("template_id", "leader_id")
