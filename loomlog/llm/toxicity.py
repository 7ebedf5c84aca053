"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), where x_i says whether term i
occurs in the text.  The factors v learn pairwise interactions (an insult next to a group's name) that additive
weights miss.  Terms are the lower-cased words of letters and digits and their first 4, 5 and 6 bytes (so that inflected forms share
evidence), each a 64-bit hash; whole texts are read.

Training is bounded: `per_class` labelled rows of each class at most (least hashes of doc_id first), and the
`terms` terms with the largest G-squared against the label.  Counting terms and scoring are distributed; only the
selected terms and the sample's rows of selected terms reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import LOWER, NON_ALNUM, Words, kept, list_array, signed, slices

PREFIXES = (4, 5, 6)


@dataclass
class Model:
    """terms: sorted hashes; weights and factors go with them."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    seen: np.ndarray | None = None

    def margins(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Of n texts, from distinct (text, term number) pairs."""
        out = np.full(n, self.bias)
        if len(term):
            out += np.bincount(text, self.weights[term], n)
            v = self.factors[term]
            for f in range(v.shape[1]):
                out += 0.5 * (np.bincount(text, v[:, f], n) ** 2 - np.bincount(text, v[:, f] ** 2, n))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def term_hashes(words: Words) -> Iterator[np.ndarray]:
    """For each kind of term, a hash of each word; kinds do not share values."""
    yield words.hashes()
    for k in PREFIXES:
        yield words.hashes(k) ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))


def selected(words: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term number) pairs of the model's terms."""
    if not len(model.terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if model.seen is None:  # a small table rules out most words before the search
        model.seen = np.zeros(1 << 20, bool)
        model.seen[model.terms >> np.uint64(44)] = True
    owner, pairs = words.owner(), []
    for h in term_hashes(words):
        at = np.flatnonzero(model.seen[h >> np.uint64(44)])
        k = np.minimum(np.searchsorted(model.terms, h[at]), len(model.terms) - 1)
        hit = model.terms[k] == h[at]
        pairs.append(owner[at[hit]] * len(model.terms) + k[hit])
    both = np.unique(np.concatenate(pairs))
    return both // len(model.terms), both % len(model.terms)


def fit(text: np.ndarray, term: np.ndarray, label: np.ndarray, terms: np.ndarray, prior: float, rank: int = 4, rounds: int = 600, rate: float = 0.1, shrink: float = 5e-4) -> Model:
    """Weighted logistic loss by Adam; classes are weighted to the share `prior` of label 1.  Rank 0 is the additive model."""
    n, m = len(label), len(terms)
    rng = np.random.Generator(np.random.PCG64(7))
    share = label.mean()
    weight = np.where(label == 1, prior / share, (1 - prior) / (1 - share))
    weight /= weight.sum()
    b, w, v = np.log(prior / (1 - prior)), np.zeros(m), rng.normal(0, 0.05, (m, rank))
    theta = [np.array([b]), w, v]
    m1, m2 = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    frequency = np.maximum(np.bincount(term, weight[text], m), 1e-9)
    for t in range(1, rounds + 1):
        model = Model(float(theta[0][0]), terms, theta[1], theta[2])
        slope = weight * (sigmoid(model.margins(text, term, n)) - label)
        s = slope[text]
        sums = np.stack([np.bincount(text, v[term, f], n) for f in range(rank)], 1) if len(term) and rank else np.zeros((n, rank))
        grad_w = np.bincount(term, s, m) / frequency**0.5 + shrink * w
        grad_v = np.stack([np.bincount(term, s * (sums[text, f] - v[term, f]), m) for f in range(rank)], 1) + shrink * v if rank else v
        for x, g, a, c in zip(theta, (np.array([slope.sum()]), grad_w, grad_v), m1, m2, strict=True):
            a += 0.1 * (g - a)
            c += 0.01 * (g * g - c)
            x -= rate * (1 - t / (rounds + 1)) * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.99**t)) + 1e-6)
        w, v = theta[1], theta[2]
    return Model(float(theta[0][0]), terms, w, v)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for words in slices(batch.column(0), NON_ALNUM, LOWER):
            owner = words.owner()
            for h in term_hashes(words):
                order = np.lexsort((owner, h))
                h, o = h[order], owner[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                h, y = h[fresh], label[words.first + o[fresh]]
                starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                if len(h):
                    n, n1 = np.diff(np.append(starts, len(h))), np.add.reduceat(y, starts)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h[starts])), pa.array(n), pa.array(n1)], ["term", "n", "n1"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, terms: int = 4096, least: int = 5, g2: float = 30.0) -> Model:
    """docs: doc_id, text.  labels: doc_id, toxic; null labels count for nothing, of several the largest holds.

    With no labelled rows, or of one class only, the model is constant: the share of label 1 (0 if there is none).
    """
    none = np.zeros(0, np.uint64)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    sums = known.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")).first()
    if not sums.n or not 0 < sums.n1 < sums.n:
        p = min(max((sums.n1 or 0) / max(sums.n, 1), 1e-6), 1 - 1e-6)
        return Model(float(np.log(p / (1 - p))), none, np.zeros(0), np.zeros((0, 1)))
    prior = sums.n1 / sums.n
    pick = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # at most 2 * per_class rows of two numbers: a proven bound
    sample = kept(docs.select("doc_id", "text").join(F.broadcast(pick[0].union(pick[1])), "doc_id").select("text", "y"))
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1")).first()
    if not size.n or not 0 < size.n1 < size.n:
        return Model(float(np.log(prior / (1 - prior))), none, np.zeros(0), np.zeros((0, 1)))
    counts = sample.mapInArrow(_count_terms, "term long, n long, n1 long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where(F.col("n") >= least)
    n, n1 = float(size.n), float(size.n1)
    cell = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    a, c = F.col("n1").cast("double"), F.col("n").cast("double")
    gain = 2 * (cell(a, c * (n1 / n)) + cell(c - a, c * (1 - n1 / n)) + cell(n1 - a, (n - c) * (n1 / n)) + cell(n - c - n1 + a, (n - c) * (1 - n1 / n)))
    chosen = counts.withColumn("g2", gain).where(F.col("g2") >= g2).orderBy(F.desc("g2"), "term").limit(terms).select("term").collect()
    chosen = np.sort(np.array([r.term for r in chosen], np.int64).view(np.uint64))
    empty = Model(0.0, chosen, np.zeros(len(chosen)), np.zeros((len(chosen), 1)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for words in slices(batch.column(0), NON_ALNUM, LOWER):
                text, term = selected(words, empty)
                at = np.searchsorted(text, np.arange(len(words) + 1))
                yield pa.RecordBatch.from_arrays([pa.array(y[words.first : words.first + len(words)].astype(np.int32)), list_array(pa.array(term.astype(np.int32)), at)], ["y", "terms"])

    got = sample.mapInArrow(rows, "y int, terms array<int>").toArrow()
    lists = got.column("terms").combine_chunks()
    held = np.array([len(x) for x in lists], np.int64)
    return fit(np.repeat(np.arange(len(held)), held), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), got.column("y").to_numpy().astype(float), chosen, max(prior, 0.2))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without `text`, with score (0 to 1; a column of that name is replaced); a null text counts as empty, an empty one gets the bias alone."""
    keep = [c for c in docs.columns if c not in (text, "score")]
    model = Model(model.bias, model.terms, model.weights, model.factors)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sigmoid(model.margins(*selected(words, model), len(words))) for words in slices(batch.column(0), NON_ALNUM, LOWER)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(out) if out else np.zeros(0))], [*keep, "score"])

    schema = docs.select(*keep).schema.add("score", "double")
    return docs.select(text, *keep).mapInArrow(scores, schema)


def for_training(labels: DataFrame) -> DataFrame:
    """The rows whose labels may be learnt from: crc32 of doc_id as text, modulo 5, is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def stage(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents that score below the threshold, with all their columns."""
    model = train(docs, for_training(labels))
    text, keep = "text", docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sigmoid(model.margins(*selected(words, model), len(words))) for words in slices(batch.column(keep.index(text)), NON_ALNUM, LOWER)]
            if out:
                yield batch.filter(pa.array(np.concatenate(out) < threshold))

    return docs.mapInArrow(clean, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: doc_id, held_out, score and predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, for_training(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
