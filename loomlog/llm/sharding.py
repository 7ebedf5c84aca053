"""Hilbert-curve sharding: quantise several metadata dimensions by their quantiles, sort by the curve, cut the order into runs.

Near places on the curve are near in all dimensions, so each shard has narrow ranges in several at once and a reader can
skip files by any of them (see manifest()).  Ranks come from a distributed sort; no text is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import kept, ranked

BITS = 5


def axes_to_place(axes: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of points (rows) with coordinates of `bits` bits.

    Bits go from the highest: a point is turned and mirrored into its octant's frame, then Gray-decoded and interleaved.
    """
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | (((x[i] ^ turn) >> bit) & 1)
    return place


def cumulated(df: DataFrame, order: list[Column], size: str) -> DataFrame:
    """df with _rank (from 0 in `order`) and _before, the sum of `size` over the rows before; no task holds all rows."""
    out = kept(ranked(df, order, name="_rank").withColumn("_block", F.expr("_rank div 65536")))
    sums = out.groupBy("_block").agg(F.sum(size).alias("_sum"))
    before = sums.select(F.col("_block").alias("_b"), F.expr("coalesce(sum(_sum) over (order by _block rows between unbounded preceding and 1 preceding), 0)").alias("_sum_before"))
    within = F.expr(f"coalesce(sum(`{size}`) over (partition by _block order by _rank rows between unbounded preceding and 1 preceding), 0)")
    at = out.join(before, F.col("_block") == F.col("_b")).withColumn("_before", F.col("_sum_before") + within)
    return at.select(*df.columns, "_rank", "_before")


def quantiles(df: DataFrame, dims: list[str], bits: int = BITS) -> dict[str, list[tuple]]:
    """Of each dimension the values (ascending) at which a new cell begins, with its number: 2 ** bits cells of like numbers of rows at most.

    Numbers by approximate quantiles; strings, whole ones, by the sums of rows of the distinct values in order.  At most 2 ** bits
    values of each reach the driver.  Nulls and values below the first are in cell 0.
    """
    cells, out, kinds = 1 << bits, {}, dict(df.dtypes)
    numeric = [c for c in dims if kinds[c] != "string"]
    if numeric:
        got = df.agg(*(F.percentile_approx(c, [i / cells for i in range(1, cells)], 10000).alias(c) for c in numeric)).first()
        for c in numeric:
            # a value that several quantiles share begins the last of their cells
            out[c] = sorted({v: i for i, v in enumerate(got[c] or [], 1)}.items())
    for c in dims:
        if c not in out:
            sums = kept(df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n")))
            total = sums.agg(F.sum("n")).first()[0] or 1
            at = cumulated(sums, [F.col("v").asc()], "n").select("v", F.expr(f"cast(_before * {cells} div {total} as int)").alias("cell"))
            out[c] = [(r.v, r["cell"]) for r in at.groupBy("cell").agg(F.min("v").alias("v")).orderBy("cell").collect()]
    return out


def placed(df: DataFrame, dims: list[str], cuts: dict[str, list[tuple]], bits: int = BITS, names: dict[str, str] | None = None) -> DataFrame:
    """df with `place` on the Hilbert curve through the cells that quantiles() gave; names: where a dimension has another name in df."""
    cells = []
    for c in dims:
        value, cell, low = F.col((names or {}).get(c, c)), F.lit(0), 0
        for v, number in cuts[c]:
            cell = cell + F.when(value >= F.lit(v), number - low).otherwise(0)
            low = number
        cells.append(cell.cast("long"))

    @F.pandas_udf("long")
    def place(cells: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for some in cells:
            yield pd.Series(axes_to_place(np.stack([c.to_numpy(np.int64) for c in some], 1), bits))

    return df.select(*df.columns, place(*cells).alias("place"))


def _order(df: DataFrame, key: str) -> list[Column]:
    """A total order: place, key with nulls last, then all other columns; its parts are never null where they decide."""
    return [F.col("place"), F.col(key).asc_nulls_last(), *(F.col(c) for c in df.columns if c != key)]


def assign(df: DataFrame, dims: list[str], shards: int, law: str = "rows", size: str = "size", key: str = "doc_id", bits: int = BITS, cuts: dict | None = None) -> DataFrame:
    """df (read several times: pass a kept table) with place, shard (from 0) and slot (gapless from 0 within the shard, in the curve's order).

    law 'rows': the shards' counts differ by one at most.  law 'bytes': runs are cut at equal parts of the summed `size`,
    so that a shard is off by one row's size at most.  Ties of place go by key, nulls last, then by all other columns.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"no law {law!r}")
    on_curve, order = placed(df, dims, quantiles(df, dims, bits) if cuts is None else cuts, bits), _order(df, key)
    if law == "rows":
        n = max(df.count(), 1)
        shard = F.expr(f"_rank * {shards} div {n}")
        start = F.expr(f"((_rank * {shards} div {n}) * {n} + {shards - 1}) div {shards}")
        return ranked(on_curve, order, name="_rank").select(*df.columns, "place", shard.cast("int").alias("shard"), (F.col("_rank") - start).cast("long").alias("slot"))
    total = df.agg(F.sum(size)).first()[0] or 1
    at = cumulated(on_curve, order, size).withColumn("shard", F.least(F.expr(f"cast(_before * {shards} div {total} as int)"), F.lit(shards - 1)))
    first = at.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return at.join(F.broadcast(first), "shard").withColumn("slot", F.col("_rank") - F.col("_first")).select(*df.columns, "place", "shard", "slot")


def manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Of each shard its rows and each dimension's least and largest value: what a reader prunes files by."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *(f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))))


def write(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in the curve's order."""
    sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _measures() -> dict[str, Column]:
    text = F.col("text")
    return {"doc_id": F.col("doc_id"), "lang": F.col("lang"), "source": F.col("source"), "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, size (UTF-8 bytes plus 1; null text: 1), text_crc32 (null text: null)."""
    return docs.select(*(v.alias(c) for c, v in _measures().items()))


DIMS = ["lang", "source", "size"]


def stage(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs with place and shard.

    Only metadata is sorted: the first row of each shard is the whole of what assigns the others, so no text moves.
    Rows alike in all metadata and text stay together.  Columns place and shard that docs has already are replaced.
    """
    docs = docs.drop("place", "shard")
    names, small = docs.columns, kept(measured(docs))
    cuts = quantiles(small, DIMS)
    firsts = assign(small, DIMS, shards, cuts=cuts).where("slot = 0").select("shard", "place", *small.columns).orderBy("shard").collect()
    shard = F.lit(0)
    for r in firsts[1:]:
        after = F.lit(True)  # at least r, by the columns of the order from the last to the first
        for c, kind in reversed([("place", "long"), ("doc_id", "long"), *((c, t) for c, t in small.dtypes if c != "doc_id")]):
            value, last = F.lit(r[c]).cast(kind), c == "doc_id"
            mine = F.col(f"_{c}")
            above = F.coalesce(mine > value, (mine.isNull() & value.isNotNull()) if last else (mine.isNotNull() & value.isNull()))
            after = above | (mine.eqNullSafe(value) & after)
        shard = shard + after.cast("int")
    numbered = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), *(v.alias(f"_{c}") for c, v in _measures().items()))
    own = placed(numbered, DIMS, cuts, names={c: f"_{c}" for c in DIMS}).withColumnRenamed("place", "_place").withColumn("_shard", shard.cast("int"))
    return own.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("_place").alias("place"), F.col("_shard").alias("shard"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: doc_id, size, text_crc32, law, shard, slot, grown_shard, and place."""
    out = assign(kept(measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))), DIMS, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "place")
