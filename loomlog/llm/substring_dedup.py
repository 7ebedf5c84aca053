"""Substring de-duplication by seed and extend.

A window is `length` consecutive words.  Its seed is the least hash of its SEED-word grams (winnowing): equal windows have equal seeds
at equal offsets, so joining texts on seeds meets every repeat.  Consecutive windows with one seed form an anchor; its
context, the words of all its windows, is the seed extended both ways as far as the seed decides.

  1. Anchors whose seed occurs once in the corpus are dropped (a count with partial sums, then a join).
  2. Of the anchors with an equal seed and context all but the first are repeats as a whole.
  3. Where a seed has several contexts, their first anchors are extended by every split of the words that a window has left of the
     seed and right of it: a window of one of them is a repeat if the seed with the same extension occurs earlier.

A word is removed if a repeated window covers it; repeats of adjacent windows with one source add up to maximal repeats (see
maximal()).  Every step is linear in the text: no two members of a group are paired.  Two windows count as equal if both
the seed's hash and the extension's agree, 128 bits of two independent hashes.  Keys that many rows share (a passage in a third of all
texts) are not dealt to one task: see common.spread_join().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import dropped, folded, kept, runs, signed, slices, spread_join

SEED = 5
_NULL = -(1 << 63)


def _least_places(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, the place of its first least one."""
    place, reach = np.arange(len(g)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(g[right] < g[left], right, left)
        reach += step
    return place


def _anchors(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = (batch.column(i).to_numpy() for i in (0, 1))
            for words in slices(batch.column(2)):
                h = words.hashes()
                if len(h) < length:
                    continue
                place = _least_places(g := runs(h, SEED), length - SEED + 1)
                owner = words.owner()
                window = np.flatnonzero(np.arange(len(place)) + length <= words.at[1:][owner[: len(place)]])
                if not len(window):
                    continue
                p, o = place[window], owner[window]
                first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (o[1:] != o[:-1])]))
                n = np.diff(np.append(first, len(window)))
                lo, seed, doc = window[first], p[first], o[first]
                # the place of the seed in its windows goes into the hash
                context = folded(words.hashes(seed=1), lo, lo + n - 1 + length) ^ folded((seed - lo).astype(np.uint64), np.arange(len(lo)), np.arange(len(lo)) + 1, 9)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[words.first + doc]), pa.array(t[words.first + doc]), pa.array(signed(g[seed])), pa.array(signed(context)), pa.array((lo - words.at[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["d", "t", "seed", "context", "lo", "n"],
                )

    return rows


def _windows(length: int):
    """Of each text and its list of anchors (lo, n, seed): seed, extension and start of their windows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = np.cumsum([0, *(len(x) for x in lists)])
            flat = lists.flatten()
            lo, n, seed = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            for words in slices(batch.column(2)):
                h = runs(words.hashes(seed=1), length)
                a, b = ends[words.first], ends[words.first + len(words)]
                doc = np.repeat(np.arange(len(words)), np.diff(ends[words.first : words.first + len(words) + 1]))
                k = n[a:b]
                start = np.repeat(lo[a:b], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                doc, mine = np.repeat(doc, k), np.repeat(seed[a:b], k)
                of = pa.array(words.first + doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(mine), pa.array(signed(h[words.at[doc] + start])), pa.array(start.astype(np.int32))], ["d", "t", "seed", "extension", "lo"])

    return rows


def keyed(docs: DataFrame) -> DataFrame:
    """d, t, text: a null doc_id comes before all others; t is a hash of the text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")


def repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """d, t (see keyed()), a, b (a span of words to remove, from a to before b), and sd, st, sa: the text where it occurs first, and where there.

    Earlier is: of smaller d, or the same d and a smaller t, or the same text and an earlier start.  Rows alike in doc_id and text are one
    document, so a repeated row is no repeat of itself; texts that only share a doc_id (or have none) are documents of their own.
    """
    if length < 2 * SEED:
        raise ValueError(f"length is {2 * SEED} at least")
    texts = keyed(docs)
    # rows alike in doc_id and text give the same anchors twice; as first of a kind that changes nothing
    anchors = kept(texts.mapInArrow(_anchors(length), "d long, t long, seed long, context long, lo int, n int"))
    often = kept(anchors.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    total = often.agg(F.sum("_n")).first()[0] or 0
    every, anchors = anchors, kept(spread_join(anchors, often, ["seed"], "_n", total).drop("_n"))
    dropped(every, often)
    kinds = anchors.groupBy("seed", "context").agg(F.min(F.struct("d", "t", "lo", "n")).alias("f"), F.count(F.lit(1)).alias("_n"))
    kinds = kept(kinds.select("seed", "context", F.col("f.d").alias("sd"), F.col("f.t").alias("st"), F.col("f.lo").alias("slo"), F.col("f.n").alias("sn"), "_n"))
    later = "d <> sd or t <> st or lo <> slo"
    whole = spread_join(anchors, kinds.where("_n > 1").drop("sn"), ["seed", "context"], "_n", total).where(later)
    whole = whole.select("d", "t", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + length).alias("b"), "sd", "st", F.col("slo").alias("sa"))
    several = kinds.groupBy("seed").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("seed")
    one = F.struct(F.col("slo").alias("lo"), F.col("sn").alias("n"), "seed")
    ask = kinds.join(several, "seed").groupBy(F.col("sd").alias("d"), F.col("st").alias("t")).agg(F.collect_list(one).alias("ws"))
    asked = texts.join(ask, ["d", "t"], "left").where("ws is not null").select("d", "t", "text", "ws")
    windows = kept(asked.mapInArrow(_windows(length), "d long, t long, seed long, extension long, lo int"))
    first = windows.groupBy("seed", "extension").agg(F.min(F.struct("d", "t", "lo")).alias("f"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = kept(first.select("seed", "extension", F.col("f.d").alias("sd"), F.col("f.t").alias("st"), F.col("f.lo").alias("slo"), "_n"))
    part = spread_join(windows, first, ["seed", "extension"], "_n", total).where(later)
    part = part.select("d", "t", F.col("lo").alias("a"), (F.col("lo") + length).alias("b"), "sd", "st", F.col("slo").alias("sa"))
    return whole.unionByName(part)


def maximal(found: DataFrame) -> DataFrame:
    """repeats() with spans that overlap and have one source on one diagonal merged: the maximal repeats with that source."""
    line = ["d", "t", "sd", "st", "_line"]
    rows = found.withColumn("_line", F.col("a") - F.col("sa")).distinct()
    reach = F.expr(f"max(b) over (partition by {', '.join(line)} order by a, b rows between unbounded preceding and 1 preceding)")
    fresh = rows.withColumn("_new", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1)))
    run = fresh.withColumn("_run", F.expr(f"sum(_new) over (partition by {', '.join(line)} order by a, b)"))
    return run.groupBy(*line, "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("sa").alias("sa")).select("d", "t", "a", "b", "sd", "st", "sa")


def _kept_words(words: list[bytes], spans) -> list[bytes]:
    change = np.zeros(len(words) + 1, np.int64)
    for a, b in ((s["a"], s["b"]) for s in spans):
        change[a] += 1
        change[b] -= 1
    gone = np.cumsum(change)[:-1] > 0
    return [w for w, x in zip(words, gone.tolist(), strict=True) if not x]


def removed(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept: every row's words without repeats, joined by one space.  A null text has no words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, out = [], [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                left = _kept_words(words, spans.as_py()) if spans.is_valid else words
                n.append(len(words)), m.append(len(words) - len(left)), out.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["d", "n_words", "n_removed", "kept"])

    spans = repeats(docs, length).groupBy("d", "t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    found = keyed(docs).join(spans, ["d", "t"], "left").select("d", "text", "spans")
    out = found.mapInArrow(rows, "d long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("d") != _NULL, F.col("d")).alias("doc_id"), "n_words", "n_removed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: doc_id, n_words, n_removed, kept_sha256; windows of 20 words."""
    out = removed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM l),
g AS (SELECT *, CASE WHEN i <= n - 19 THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS win FROM w),
f AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS late FROM g),
c AS (SELECT doc_id, word, i, max(late::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM l LEFT JOIN k USING (doc_id)
"""
