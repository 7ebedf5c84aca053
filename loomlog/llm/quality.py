"""Quality by hierarchical empirical Bayes.

A document's own evidence is the log odds of a logistic model over its shape and its words (symbols, capitals, digits, word and line lengths,
and the shares of repeated, shouted, symbol-ridden and bare words).  A site has two levels, host and path below it.  From all documents' evidence each host gets a posterior
mean shrunk toward the global mean, and each path one shrunk toward its host's; how strongly is estimated from the spread
between sites (method of moments), so sparse sites stay near their parent.  A document's score adds its
site's log odds, without its own share, to its evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import NEWLINE, NON_ALNUM, kept, slices, split, spread_join

FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_lines", "line_words", "upper", "digits", "symbols", "other_bytes",
    "same_word", "capital_words", "symbol_runs", "bare_words",
)
_BYTE = np.arange(256)
_KINDS = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "digits": (_BYTE >= 48) & (_BYTE <= 57),
    "symbols": np.isin(_BYTE, list(b"#$%&*+<=>@[\\]^_`{|}~")),
    "other_bytes": _BYTE >= 128,
}
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def shapes(texts: pa.Array) -> np.ndarray:
    """FEATURES of each text (rows); a null or empty text has zeros.

    The last four are shares of words: equal to the word before, without lower-case letters and with two capitals at least, ending in a
    symbol twice, and without any letter or digit.
    """
    out = []
    for words in slices(texts):
        n, bytes_ = words.counts, np.maximum(np.diff(words.offsets), 1)
        h, owner = words.hashes(), words.owner()
        lines = split(words.buf, words.offsets, NEWLINE)
        lh = lines.hashes()
        distinct = [len(np.unique(h[a:b])) for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist(), strict=True)]
        single = [len(np.unique(lh[a:b])) for a, b in zip(lines.at[:-1].tolist(), lines.at[1:].tolist(), strict=True)]
        some = np.maximum(n, 1)
        length = words.ends - words.starts
        of_text = lambda flags: np.diff(_sums(flags)[words.at])
        of_word = lambda table: np.diff(np.stack([(c := _sums(table[words.buf]))[words.starts], c[words.ends]]), axis=0)[0]
        columns = [np.log1p(n), of_text(length) / some, np.log1p(distinct) / np.log(n + 2), 1 - np.array(single) / np.maximum(lines.counts, 1), np.log1p(n / np.maximum(lines.counts, 1))]
        for kind in ("upper", "digits", "symbols", "other_bytes"):
            columns.append(np.diff(_sums(_KINDS[kind][words.buf])[words.offsets]) / bytes_)
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])])[: len(h)]
        last, before = words.buf[words.ends - 1], words.buf[np.maximum(words.ends - 2, 0)]
        runs = (length > 1) & (last == before) & NON_ALNUM[last]
        capitals = (of_word(_KINDS["upper"]) > 1) & (of_word(_LOWER) == 0)
        bare = of_word(~NON_ALNUM) == 0
        columns += [of_text(flags) / some for flags in (same, capitals, runs, bare)]
        x = np.stack(columns, 1).astype(float)
        x[n == 0] = 0
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


class Shape:
    """Logistic regression of standardised features; Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.sd = x.mean(0) if len(x) else np.zeros(x.shape[1]), x.std(0) + 1e-6 if len(x) else np.ones(x.shape[1])
        n1 = float(y.sum())
        self.w = np.zeros(x.shape[1] + 1)
        self.w[0] = np.log((n1 + 0.5) / (len(y) - n1 + 0.5))
        if 0 < n1 < len(y):
            z = self._expand(x)
            penalty = np.full(len(self.w), ridge)
            penalty[0] = 1e-6
            for _ in range(25):
                p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
                step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
                self.w += np.clip(step, -2, 2)

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -5, 5)
        return np.concatenate([np.ones((len(z), 1)), z], 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._expand(x) @ self.w, -12, 12)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> Shape:
    """From `per_class` labelled rows of each class at most, least hashes of doc_id first; only their features reach the driver."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("y"))
    pick = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(pick[0].union(pick[1])), "doc_id").select("text", "y")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shapes(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = sample.mapInArrow(rows, "y int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return Shape(x, got.column("y").to_numpy().astype(float))


def evidence(docs: DataFrame, model: Shape, text: str = "text") -> DataFrame:
    """docs without `text`, with evidence (a column of that name is replaced): the log odds of good quality."""
    keep = [c for c in docs.columns if c not in (text, "evidence")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.log_odds(shapes(batch.column(0))))], [*keep, "evidence"])

    return docs.select(text, *keep).mapInArrow(rows, docs.select(*keep).schema.add("evidence", "double"))


def _strength(sites: DataFrame, mean: float) -> float:
    """How many documents a parent's mean counts as, from the spread of the sites' means beyond what chance gives them."""
    got = sites.where("n >= 2").agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("between"), F.sum("v").alias("within"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
    if not got.k or not got.n:
        return 10.0
    within = max(got.within / got.n, 1e-9)
    spread = max((got.between - got.k * within) / got.n, 0.0)
    return float(min(max(within / max(spread, 1e-9), 1.0), 1e4))


def posteriors(scored: DataFrame, host: str = "host", path: str = "path", weight: float = 1.0) -> DataFrame:
    """scored (evidence, host, path, ...) with host_mean, path_mean and score; columns of these names are replaced.

    Null hosts and paths are sites of their own; rows alike are rows of their own.  A site's sums are taken before they meet its rows,
    and a site that holds a large share of all rows is not dealt to one task: see common.spread_join().
    """
    keep = [c for c in scored.columns if c not in ("host_mean", "path_mean", "score")]
    of = lambda c: F.struct(F.col(f"`{c}`").isNull().alias("none"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("name"))
    rows = scored.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("r"), of(host).alias("h"), F.struct(of(host).alias("h"), of(path).alias("p")).alias("hp"), (1 / (1 + F.exp(-F.col("evidence")))).alias("q"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("s")).first()
    mean = min(max((total.s or 0.0) / max(total.n, 1), 1e-4), 1 - 1e-4)
    sums = [F.count(F.lit(1)).alias("n"), F.sum("q").alias("s"), (F.count(F.lit(1)) * F.coalesce(F.var_pop("q"), F.lit(0.0))).alias("v")]
    paths = kept(rows.groupBy("hp").agg(*sums))
    hosts = kept(rows.groupBy("h").agg(*sums))
    k_host, k_path = _strength(hosts, mean), _strength(paths, mean)
    # a path's row carries its host's sums, so that the documents meet one table
    sites = paths.withColumn("h", F.col("hp.h")).join(hosts.select("h", F.col("n").alias("hn"), F.col("s").alias("hs")), "h")
    sites = kept(sites.select("hp", "hn", "hs", F.col("n").alias("pn"), F.col("s").alias("ps")))
    joined = spread_join(rows.drop("h"), sites, ["hp"], "pn", total.n)
    others = lambda s, n, up, k: (s - F.col("q") + k * up) / (n - 1 + k)
    odds = lambda q: F.log(q / (1 - q))
    bound = lambda q: F.least(F.greatest(q, F.lit(1e-4)), F.lit(1 - 1e-4))
    out = joined.withColumn("hm", bound(others(F.col("hs"), F.col("hn"), F.lit(mean), k_host)))
    out = out.withColumn("pm", bound(others(F.col("ps"), F.col("pn"), F.col("hm"), k_path)))
    logit = F.col("r.evidence") + weight * (odds(F.col("pm")) - F.lit(float(np.log(mean / (1 - mean)))))
    return out.select(*(F.col(f"r.`{c}`").alias(c) for c in keep), F.col("hm").alias("host_mean"), F.col("pm").alias("path_mean"), (1 / (1 + F.exp(-logit))).alias("score"))


def for_training(labels: DataFrame) -> DataFrame:
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: doc_id, host (source), path (source/lang), evidence, host_mean, path_mean, score, kept (score of 0.5 or more)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = read("documents").select("doc_id", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path"), "text")
    scored = kept(evidence(docs, train(docs, for_training(read("labels")))))
    rounded = [F.round(c, 9).alias(c) for c in ("evidence", "host_mean", "path_mean", "score")]
    return posteriors(scored).select("doc_id", "host", "path", *rounded, (F.col("score") >= 0.5).alias("kept"))
