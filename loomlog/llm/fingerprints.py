"""Homomorphic multiset hash of a text's paragraphs (its lines).

Every paragraph is hashed to a wide vector; a text's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo powers of
two.  So it depends on the multiset of paragraphs only, and a paragraph is inserted or deleted by adding or
subtracting its vector (add(), remove()).  The EQUAL lanes modulo 2^64 are the 256 bits of the paragraph's BLAKE2b digest, so that two
given texts of different paragraphs agree in them with probability 2^-256.  That is no proof against an adversary who may choose very many
paragraphs: sums of so few lanes fall to a generalised birthday search.  SKETCH lanes modulo 2^16 count the paragraph's word triples with
random signs, so that the cosine of two fingerprints estimates the likeness of the texts (standard error 1 / sqrt(SKETCH)).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import NEWLINE, SPACES, U64, Words, runs, shuffle_partitions, slices, split

EQUAL, SKETCH = 4, 256
#: Rows that are fingerprinted at once, and the characters they have at most, but for a single longer row.
ROWS, CHARS = 256, 1 << 22
_NULL = -(1 << 63)


def digests(lines: Words) -> np.ndarray:
    """EQUAL lanes of each line."""
    data = lines.buf.tobytes()
    known: dict[bytes, bytes] = {}
    out = []
    for a, b in zip(lines.starts.tolist(), lines.ends.tolist(), strict=True):
        line = data[a:b]
        if line not in known:
            known[line] = hashlib.blake2b(line, digest_size=8 * EQUAL).digest()
        out.append(known[line])
    return np.frombuffer(b"".join(out), "<u8").reshape(-1, EQUAL).astype(U64)


_BLANK = np.frombuffer(hashlib.blake2b(b"", digest_size=8 * EQUAL).digest(), "<u8").astype(U64)


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """EQUAL and SKETCH lanes of each text.  Empty lines are paragraphs too; a null or empty text is the zero vector."""
    n = len(texts)
    equal, sketch = np.zeros((n, EQUAL), U64), np.zeros((n, SKETCH), np.uint16)
    for lines in slices(texts, NEWLINE):
        docs = len(lines)
        here = slice(lines.first, lines.first + docs)
        owner = lines.owner()
        sums = np.concatenate([np.zeros((1, EQUAL), U64), np.cumsum(digests(lines), 0, dtype=U64)])
        equal[here] = sums[lines.at[1:]] - sums[lines.at[:-1]]
        # an empty line counts by the newlines beyond those between paragraphs
        breaks = np.concatenate([[0], np.cumsum(lines.buf == 0x0A)])
        blank = (breaks[lines.offsets[1:]] - breaks[lines.offsets[:-1]] - np.maximum(lines.counts - 1, 0)).astype(U64)
        equal[here] += blank[:, None] * _BLANK[None, :]
        bounds = np.concatenate([lines.starts, [len(lines.buf)]])
        words = split(lines.buf, lines.offsets, SPACES)
        wh = words.hashes()
        line = np.searchsorted(bounds, words.starts, "right") - 1
        for k in (3, 1):
            if k == 3:
                at = np.flatnonzero(line[2:] == line[:-2]) if len(wh) > 2 else np.zeros(0, np.int64)
                x = runs(wh, 3)[at] if len(at) else np.zeros(0, U64)
            else:  # lines of one or two words count as words
                size = np.bincount(line, minlength=len(bounds)) if len(line) else np.zeros(len(bounds), np.int64)
                at = np.flatnonzero(size[line] < 3) if len(line) else np.zeros(0, np.int64)
                x = wh[at]
            if len(at):
                cell = owner[line[at]] * SKETCH + (x >> U64(40) & U64(SKETCH - 1)).astype(np.int64)
                sign = 1 - 2 * (x & U64(1)).astype(np.int64)
                sketch[here] += np.bincount(cell, sign, docs * SKETCH).astype(np.int64).reshape(docs, SKETCH).astype(np.uint16)
    return equal, sketch


def add(a: tuple, b: tuple) -> tuple:
    """The fingerprint lanes of the union of two multisets of paragraphs."""
    return a[0] + b[0], a[1] + b[1]


def remove(a: tuple, b: tuple) -> tuple:
    """The lanes of a without the paragraphs of b."""
    return a[0] - b[0], a[1] - b[1]


def likeness(a: tuple, b: tuple) -> np.ndarray:
    """Row by row, 0 to 1: 1 for equal lanes, else the cosine of the sketches, at least 0."""
    x, y = (v[1].view(np.int16).astype(np.float64) for v in (a, b))
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.clip((x * y).sum(1) / np.where(norm > 0, norm, 1), 0, 1)
    same = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    return np.where(same, 1.0, np.round(cosine, 9))


def as_hex(lanes: tuple) -> list[str]:
    return [e.astype(">u8").tobytes().hex() + s.astype(">u2").tobytes().hex() for e, s in zip(*lanes, strict=True)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(as_hex(vectors(part.column(1))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, fingerprint string")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, text, part, tail) in order; each is compared with the next of its part.  A part ends in tail rows, which are not returned."""
    held_ids: list = []
    held_texts: list = []
    held_part, closed, chars = None, False, 0

    def done(ids: list, texts: list) -> pa.RecordBatch:
        """Of all but the last text, which is the next of the last but one."""
        edited = []
        for text, after in zip(texts[:-1], texts[1:], strict=True):
            k = len(text) // 3
            edited.append(text[: len(text) - k] + after[:k])
        lanes, changed = vectors(pa.array(texts, pa.string())), vectors(pa.array(edited, pa.string()))
        mine, after = (tuple(v[s] for v in lanes) for s in (slice(0, -1), slice(1, None)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[: len(edited)], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(as_hex(mine), pa.string()),
                pa.array(as_hex(changed), pa.string()),
                pa.array(likeness(mine, changed)),
                pa.array(likeness(mine, after)),
            ],
            ["d", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        for d, text, part, tail in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if part != held_part:
                held_ids, held_texts, held_part, closed, chars = [], [], part, False, 0
            if closed:
                continue
            held_ids.append(d), held_texts.append(text)
            closed, chars = tail, chars + len(text)
            if closed or len(held_texts) > ROWS or chars > CHARS:
                if len(held_texts) > 1:
                    yield done(held_ids, held_texts)
                held_ids, held_texts, chars = held_ids[-1:], held_texts[-1:], len(held_texts[-1])


_KEY = [("d", "i8"), ("t", "i8")]


def _keys(d: pd.Series, t: pd.Series) -> np.ndarray:
    """(~d, t): sorts by descending d and then by t."""
    key = np.empty(len(d), _KEY)
    key["d"], key["t"] = ~d.to_numpy(np.int64), t.to_numpy(np.int64)
    return key


def _firsts(keyed: DataFrame, n: int) -> np.ndarray:
    """The first key (~d, t) of each of about n parts of like numbers of rows, in order; every one is the key of a row.

    They come from quantiles of d; a d that fills several parts (rows without doc_id, say) is divided by quantiles of t.  Quantiles are
    approximate, and doubles: what they bound is looked up.
    """
    ends = keyed.agg(F.max("d").alias("top"), F.percentile_approx("d", [i / n for i in range(1, n)] or [0.5], 10000).alias("cuts")).first()
    if ends.top is None:
        return np.zeros(0, _KEY)
    times = pd.Series(ends.cuts).value_counts()
    # at most n rows: one for each part
    wanted = F.broadcast(keyed.sparkSession.createDataFrame([(int(d), int(k)) for d, k in times.items()], "d long, k int"))
    shares = keyed.join(wanted.where("k > 1"), "d").groupBy("d", "k").agg(F.percentile_approx("t", [i / 100 for i in range(1, 100)], 10000).alias("ts")).collect()
    bounds = {(~int(d), -(1 << 63)) for d in times.index} | {(~r.d, r.ts[99 * i // r.k]) for r in shares for i in range(1, r.k)}
    bounds = np.array(sorted(bounds), _KEY)

    @F.pandas_udf("int")
    def part(d: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, _keys(d, t), "right").astype(np.int32))

    least = keyed.groupBy(part("d", "t").alias("part")).agg(F.min(F.struct(F.bitwise_not("d").alias("d"), "t")).alias("key")).collect()
    return np.array(sorted((r.key.d, r.key.t) for r in least), _KEY)


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is that of the next smaller doc_id, after the last the first; a null doc_id is the smallest, a null
    text empty; rows of one doc_id go by a hash of the text.  Texts are dealt once: into parts that begin at known documents, each of
    which also goes to the end of the part before, where it is the next of the last row.
    """
    spark = docs.sparkSession
    schema = "d long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    n = shuffle_partitions(spark)
    firsts = _firsts(keyed.select("d", "t"), n)
    parts = len(firsts)
    if not parts:
        return spark.createDataFrame([], schema).withColumnRenamed("d", "doc_id")
    # a number for each part that hash partitioning sends to a partition of its own
    spread = spark.range(40 * n + 100).groupBy(F.expr(f"pmod(hash(id), {n})").alias("p")).agg(F.min("id").alias("id")).orderBy("p").collect()
    deal = np.array([spread[j % len(spread)].id for j in range(parts)], np.int64)

    @F.pandas_udf("array<struct<part:int,deal:bigint,tail:boolean>>")
    def places(d: pd.Series, t: pd.Series) -> pd.Series:
        key = _keys(d, t)
        part = np.searchsorted(firsts, key, "right") - 1
        first = firsts[part] == key
        out = []
        for p, f in zip(part.tolist(), first.tolist(), strict=True):
            q = (p - 1) % parts
            out.append([{"part": p, "deal": deal[p], "tail": False}] + ([{"part": q, "deal": deal[q], "tail": True}] if f else []))
        return pd.Series(out)

    dealt = keyed.select("d", "t", "text", F.explode(places("d", "t")).alias("at")).select("d", "t", "text", "at.part", "at.tail", F.col("at.deal").alias("deal")).repartition(n, "deal").drop("deal")
    out = dealt.sortWithinPartitions("part", "tail", F.desc("d"), "t", "text").select("d", "text", "part", "tail").mapInArrow(_compare, schema)
    return out.select(F.when(F.col("d") != _NULL, F.col("d")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: fingerprints of every text and its edited text, and their likeness."""
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
