"""MinHash near-duplicates by an LSH forest.

A document's set is that of its distinct k-word shingles (A-Z lower-cased); documents link at a Jaccard similarity of
`percent` / 100 or more.  Documents with equal sets share one node, the least doc_id of them, so that exact copies are
never paired.  Each of TREES sorted orders sorts the nodes by its own sequence of DEPTH minhashes; a node's candidates
are the NEAR nodes before and after it that share a prefix of LEAST values at least.  Neighbours in a sorted order are those with
the longest common prefix, so the depth adapts: in a dense region they agree deep into the sequence, in a sparse one
LEAST values are enough.  Orders are cut into ranges of rows wherever that balances them; a range also sees the first rows of
the next, so the result does not depend on the number of partitions.

Where more than NEAR + 1 nodes share a prefix of RUN values, neighbours alone can miss a link.  The nodes of such runs, joined over
all trees, are families; within a family all links between different components are found exactly (see completed()).  So a
link is found if its ends share a prefix of RUN values in any order.  The first RUN values of the orders are disjoint, hence a pair at
similarity 0.8 shares none with probability (1 - 0.8 ** 3) ** 24 = 3e-8, and in sparse regions (1 - 0.8 ** 2) ** 24 = 2e-11.

Candidates must be alike in size first, and parities() must not rule them out; neither drops a link.  They are verified on full sets: each
node's best candidate, then all candidates that join different components so far (a candidate within one component can't change a
result), then the families.  Only texts of documents that are asked for are dealt out (see marked()).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import LOWER, U64, Words, dropped, kept, list_array, mix, runs, shuffle_partitions, signed, slices, spread_join
from loomlog.operators.components import components

TREES, DEPTH, RUN, LEAST, NEAR = 24, 6, 3, 2, 3
#: Order t takes the values from RUN * t on, and starts again after the last: its first RUN values are its own.
VALUES = TREES * RUN
#: Members of a family that meet one copy of its base.
MEMBERS = 1000
#: Rows (of 64 bits each) of the filter of ids that marked() broadcasts at most, whatever the input.
MARKS = 1 << 17
_TAKES = (RUN * np.arange(TREES)[:, None] + np.arange(DEPTH)) % VALUES
_FACTORS = np.random.Generator(np.random.PCG64(42)).integers(1, 1 << 63, VALUES, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than k words is one shingle."""
    h, at = words.hashes(), words.at
    shingles = runs(h, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(shingles[a : b - k + 1])
        elif b > a:
            yield runs(h[a:b], b - a) ^ U64(b - a)
        else:
            yield np.zeros(0, U64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES minhashes as big-endian 32-bit values."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, U64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (_FACTORS[:, None] * shingles[None, i : i + 1024]).min(1), out=least)
    return (least >> U64(32)).astype(">u4")


def parities(shingles: np.ndarray) -> bytes:
    """A bit for each residue of the hashes modulo a power of two from their number on, 64 at least: whether it has an odd number of them.

    Two sets differ in at least as many shingles as their parities differ in bits.  The halves of a longer one, combined
    by exclusive or, are the parities modulo half as much.
    """
    size = 1 << max(6, (len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & U64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many bits two parities differ, modulo the smaller of their sizes."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    v, size = int.from_bytes(a, "little"), len(a)
    while size > len(b):
        size //= 2
        v = (v >> 8 * size) ^ (v & (1 << 8 * size) - 1)
    return (v ^ int.from_bytes(b, "little")).bit_count()


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (size of the set), h1 and h2 (a 128-bit hash of the set), sig, parity."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column(1), bytes_map=LOWER):
                n, h1, h2, sig, parity = [], [], [], [], []
                for s in shingle_sets(words, k):
                    n.append(len(s))
                    h1.append(mix(s).sum(dtype=U64))
                    h2.append(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64))
                    sig.append(signature(s).tobytes() if len(s) else b"")
                    parity.append(parities(s) if len(s) else b"")
                ids = batch.column(0).slice(words.first, len(words))
                hashes = (pa.array(signed(np.array(h, U64))) for h in (h1, h2))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *hashes, *(pa.array(c, pa.binary()) for c in (sig, parity))], ["doc_id", "n", "h1", "h2", "sig", "parity"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n long, h1 long, h2 long, sig binary, parity binary")


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (doc_id, ...) with maybe: false only if doc_id is none of ids (doc_id).

    What is sure to meet nothing need not be dealt out for a join.  The filter has a bit for each id and MARKS rows at most, so it is
    broadcast for any input; ids that share a bit are left to the join that follows.
    """
    word, bit = F.expr(f"xxhash64(doc_id) & {MARKS - 1}L"), F.expr("shiftleft(1L, cast(shiftright(xxhash64(doc_id), 32) & 63 as int))")
    marks = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_marks"))
    found = rows.withColumn("_word", word).join(F.broadcast(marks), "_word", "left")
    return found.withColumn("maybe", F.coalesce(F.col("_marks").bitwiseAND(bit) != 0, F.lit(False))).select(*rows.columns, "maybe")


def _asked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents that may be among ids (doc_id)."""
    return marked(docs.select("doc_id", "text"), ids).where("maybe").drop("maybe")


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: its number and the tree's minhashes, as bytes that sort in their order."""
    width = 4 * DEPTH + 1
    for batch in batches:
        n = batch.num_rows
        if n:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u4").reshape(n, VALUES)
            keys = np.empty((n, TREES, width), np.uint8)
            keys[:, :, 0], keys[:, :, 1:] = np.arange(TREES), np.ascontiguousarray(sig[:, _TAKES]).view(np.uint8).reshape(n, TREES, 4 * DEPTH)
            offsets = pa.py_buffer((np.arange(n * TREES + 1) * width).astype(np.int32).tobytes())
            ids, size = (pa.array(np.repeat(batch.column(i).to_numpy(), TREES)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, size, pa.Array.from_buffers(pa.binary(), n * TREES, [None, offsets, pa.py_buffer(keys.tobytes())])], ["doc_id", "n", "key"])


_WIDTH, _FAR = 4 * DEPTH + 1, NEAR + 1
_NEAR = "x long, y long, common int, part int, at int, n long, key binary"

#: Consecutive rows of an order: doc_id, n, key.
_Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _rows(ids: np.ndarray, size: np.ndarray, keys: list[bytes]) -> _Rows:
    return ids, size, np.frombuffer(b"".join(keys), np.uint8).reshape(-1, _WIDTH)


def _joined(a: _Rows, b: _Rows) -> _Rows:
    return tuple(np.concatenate(c) for c in zip(a, b, strict=True))


def _seen(rows: _Rows, old: int, to: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """x, y, common of pairs of a row before `to` and a later one from `old` on, NEAR apart at most, that share a tree and a prefix of
    LEAST values, and are alike in size.

    Besides, with common 0, a chain through each run of more than NEAR + 1 rows that share a prefix of RUN values.
    """
    ids, size, keys = rows
    values = np.ascontiguousarray(keys[:, 1:]).view(np.uint32)

    def pairs(a: np.ndarray, b: np.ndarray, common: np.ndarray):
        x, y = ids[a], ids[b]
        return np.minimum(x, y), np.maximum(x, y), common.astype(np.int32)

    for j in range(1, _FAR + 1):
        if len(ids) <= j:
            break
        same = np.concatenate([keys[j:, :1] == keys[:-j, :1], values[j:] == values[:-j]], 1)
        common = np.logical_and.accumulate(same, 1).sum(1) - 1
        fresh = (np.arange(len(common)) + j >= old) & (np.arange(len(common)) < to)
        if j < _FAR:
            alike = 100 * np.minimum(size[j:], size[:-j]) >= percent * np.maximum(size[j:], size[:-j])
            at = np.flatnonzero(fresh & (common >= LEAST) & alike)
            yield pairs(at, at + j, common[at])
        else:
            long = common >= RUN
            starts = np.flatnonzero(long & ~np.concatenate([[False], long[:-1]]) & fresh)
            at = np.concatenate([np.flatnonzero(long & fresh) + NEAR, *(starts + i for i in range(NEAR))])
            yield pairs(at, at + 1, np.zeros(len(at)))


def _neighbours(percent: int):
    """Pairs within a partition, as _NEAR without part; besides, its first and last NEAR + 1 rows, at from 0 up and from -1 down, with doc_id as x."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(x: np.ndarray, *more: pa.Array) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            columns = [pa.array(x, pa.int64()), *more]
            return pa.RecordBatch.from_arrays([c if c is not None else pa.nulls(len(x), t) for c, t in zip(columns, types, strict=True)], ["x", "y", "common", "part", "at", "n", "key"])

        def border(some: _Rows, at: np.ndarray) -> pa.RecordBatch:
            return table(some[0], None, None, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(some[1], pa.int64()), pa.array([k.tobytes() for k in some[2]], pa.binary()))

        last, part, count = _rows(np.zeros(0, np.int64), np.zeros(0, np.int64), []), None, 0
        for batch in batches:
            if batch.num_rows:
                old, part = len(last[0]), batch.column(3)[0].as_py()
                more = _rows(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist())
                if count < _FAR:
                    first = tuple(c[: _FAR - count] for c in more)
                    yield border(first, count + np.arange(len(first[0])))
                count += batch.num_rows
                window = _joined(last, more)
                for x, y, common in _seen(window, old, len(window[0]), percent):
                    yield table(x, pa.array(y), pa.array(common), None, None, None, None)
                last = tuple(c[-_FAR:] for c in window)
        if count:
            yield border(last, np.arange(-len(last[0]), 0))

    return rows


def _over_borders(borders: list, percent: int) -> list[tuple[int, int, int]]:
    """x, y, common of the pairs that _neighbours() leaves: of rows in different partitions.  borders: its rows with a part."""
    ends: dict[int, tuple[list, list]] = {}
    for r in sorted(borders, key=lambda r: (r.part, r["at"])):
        ends.setdefault(r.part, ([], []))[r["at"] < 0].append((r.x, r.n, bytes(r.key)))
    found, following = [], []
    for part in sorted(ends, reverse=True):
        first, last = ends[part]
        if following:
            window = _rows(*(np.array(c, np.int64) for c in list(zip(*last, *following, strict=True))[:2]), [r[2] for r in (*last, *following)])
            for pairs in _seen(window, len(last), len(last), percent):
                found += zip(*(c.tolist() for c in pairs), strict=True)
        following = [*first, *following][:_FAR]
    return found


def candidates(nodes: DataFrame, percent: int = 80) -> DataFrame:
    """x < y, weight (sum of common prefixes) of neighbouring nodes, dense (linked by a run of more than NEAR + 1); a kept table.  nodes: doc_id, n, sig.

    The orders themselves, by far the longest table here, are read once, as they are sorted, and not kept: what is wanted are their pairs and
    the 2 * (NEAR + 1) rows at the ends of each partition, which do not grow with the documents.
    """
    spark = nodes.sparkSession
    forest = nodes.select("doc_id", "n", "sig").mapInArrow(_orders, "doc_id long, n long, key binary")
    forest = forest.repartitionByRange(shuffle_partitions(spark), "key", "doc_id").sortWithinPartitions("key", "doc_id").withColumn("part", F.spark_partition_id())
    near = kept(forest.mapInArrow(_neighbours(percent), _NEAR))
    over = spark.createDataFrame(_over_borders(near.where("part is not null").collect(), percent), "x long, y long, common int")
    pairs = near.where("part is null").select("x", "y", "common").union(over).where("x <> y")
    out = kept(pairs.groupBy("x", "y").agg(F.sum("common").alias("weight"), (F.min("common") == 0).alias("dense")))
    dropped(near)
    return out


def plausible(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y, ...) whose parities leave them a similarity of percent, in any of their rows in sig (doc_id, n, parity).

    With sets of m and n shingles of which d are in one only, 100 * intersection >= percent * union is the same as
    (100 + percent) * d <= (100 - percent) * (m + n), and d is at least what the parities differ in: no link is dropped.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(batch.num_columns - 4).to_numpy() + batch.column(batch.num_columns - 2).to_numpy()
            d = np.array([differing(a, b) for a, b in zip(*(batch.column(batch.num_columns - i).to_pylist() for i in (3, 1)), strict=True)], np.int64)
            yield batch.select(range(batch.num_columns - 4)).filter(pa.array((100 + percent) * d <= (100 - percent) * size))

    of = lambda side: sig.where("n > 0").select(F.col("doc_id").alias(side), F.col("n").alias(f"n{side}"), F.col("parity").alias(f"p{side}"))
    both = pairs.join(of("x"), "x").join(of("y"), "y").select(*pairs.columns, "nx", "px", "ny", "py")
    return both.mapInArrow(rows, pairs.schema).distinct()


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (x, y) with 100 * intersection >= percent * union of their full sets."""

    def sets(texts: pa.Array) -> Iterator[np.ndarray]:
        for words in slices(texts, bytes_map=LOWER):
            yield from shingle_sets(words, k)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for a, b in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                yes.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    docs = _asked(docs, pairs.select(F.explode(F.array("x", "y")).alias("doc_id")))
    one = docs.select(F.col("doc_id").alias("x"), F.col("text").alias("tx"))
    two = docs.select(F.col("doc_id").alias("y"), F.col("text").alias("ty"))
    return pairs.select("x", "y").join(one, "x").join(two, "y").select("x", "y", "tx", "ty").mapInArrow(linked, "x long, y long").distinct()


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components, with lx and ly, the labels of these."""
    of = lambda side: label.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    named = pairs.select("x", "y").join(of("x"), "x", "left").join(of("y"), "y", "left")
    return named.select("x", "y", F.coalesce("lx", "x").alias("lx"), F.coalesce("ly", "y").alias("ly")).where("lx <> ly")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """family, node, comp, set of the rows family, node, comp, text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column(3), bytes_map=LOWER):
                sets = list(shingle_sets(words, k))
                values = pa.array(signed(np.concatenate([np.zeros(0, U64), *sets])))
                columns = [c.slice(words.first, len(words)) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*columns, list_array(values, np.cumsum([0, *map(len, sets)]))], ["family", "node", "comp", "set"])

    return docs.select("family", "node", "comp", "text").mapInArrow(rows, "family long, node long, comp long, set array<long>").where("size(set) > 0").distinct()


def completed(families: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """x, y: links that join all components with a link between them within a family.  families: node, family, comp.

    A set is held as its difference from its family's base, the shingles of more than half of the members.  With b shingles
    in the base, d of them missing, u others, and s in both differences, 100 * intersection >= percent * union is the same as
    2 * (100 + percent) * s >= cost + cost, where cost = 200 * d + 2 * percent * u - (100 - percent) * b.  A pair of costs
    up to 0 links whatever it shares, and then both ends link to the member of least cost: one link each.  All others share
    some of their differences, at least what their cost and the least one ask for: they are found by a join on the rarest
    ones (a prefix filter, exact for any base), and their shared differences are counted in full.
    """
    mixed = families.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("family", "m")
    mixed, families = kept(mixed), kept(families)
    nodes = mixed.agg(F.sum("m")).first()[0] or 0
    members = spread_join(families, mixed, ["family"], "m", nodes)
    docs = _asked(docs, members.select(F.col("node").alias("doc_id")))
    sets = kept(_sets(members.select("node", "family", "comp").join(docs.withColumnRenamed("doc_id", "node"), "node"), k).withColumn("id", F.monotonically_increasing_id()))
    sizes = kept(sets.groupBy("family").agg(F.count(F.lit(1)).alias("m")))
    nodes = sizes.agg(F.sum("m")).first()[0] or 0
    counts = sets.select("family", F.explode("set").alias("s")).groupBy("family", "s").agg(F.count(F.lit(1)).alias("c"))
    base = counts.join(sizes, "family").where("2 * c > m").groupBy("family").agg(F.collect_list("s").alias("base"))
    # a base may be as long as a text: a family of many members gets a copy of it for each MEMBERS of them
    salt = F.floor(F.col("m") / MEMBERS).cast("int")
    based = sizes.join(base, "family", "left").select("family", F.coalesce("base", F.array().cast("array<long>")).alias("base"), F.explode(F.sequence(F.lit(0), salt)).alias("salt"))
    salted = spread_join(sets, sizes, ["family"], "m", nodes).withColumn("salt", F.pmod(F.xxhash64("id"), salt + 1).cast("int"))
    apart = salted.join(based, ["family", "salt"])
    apart = apart.withColumn("missing", F.array_except("base", "set")).withColumn("extra", F.array_except("set", "base"))
    apart = apart.withColumn("cost", 200 * F.size("missing") + 2 * percent * F.size("extra") - (100 - percent) * F.size("base"))
    apart = kept(apart.select("family", "node", "comp", "id", "cost", F.concat("missing", "extra").alias("diff")))
    least = apart.groupBy("family").agg(F.min(F.struct("cost", "node", "comp")).alias("l"), F.count(F.lit(1)).alias("m"))
    least = kept(least.select("family", F.col("l.cost").alias("least"), F.col("l.node").alias("centre"), F.col("l.comp").alias("centre_comp"), "m"))
    share = 2 * (100 + percent)
    with_least = spread_join(apart, least, ["family"], "m", nodes)
    sure = with_least.where("cost + least <= 0 and comp <> centre_comp").select(F.least("node", "centre").alias("x"), F.greatest("node", "centre").alias("y"))

    each = with_least.select("family", "node", "comp", "id", "cost", F.greatest(F.lit(1), F.ceil((F.col("cost") + F.col("least")) / share)).alias("need"), F.explode("diff").alias("s"))
    often = kept(apart.select("family", F.explode("diff").alias("s")).groupBy("family", "s").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    some = spread_join(each, often, ["family", "s"], "c", often.agg(F.sum("c")).first()[0] or 0)
    some = some.groupBy("family", "node", "comp", "id", "cost", "need").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("diff"))
    some = kept(some.where("size(diff) >= need").withColumn("diff", F.transform("diff", lambda e: e.s)))
    # Of two components at least one is not the family's largest: that side is `a`.
    largest = some.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("family").agg(F.max_by("comp", F.struct("c", "comp")).alias("largest"), F.sum("c").alias("m"))
    rare = spread_join(some, kept(largest), ["family"], "m", nodes).select("family", "node", "comp", "id", "cost", F.size("diff").alias("n"), (F.col("comp") == F.col("largest")).alias("major"), F.explode(F.expr("slice(diff, 1, cast(size(diff) - need + 1 as int))")).alias("s"))
    a, b = rare.where("not major").alias("a"), rare.alias("b")
    on = F.expr(f"a.family = b.family and a.s = b.s and a.comp <> b.comp and (b.major or a.id < b.id) and a.cost + b.cost > 0 and {share} * least(a.n, b.n) >= a.cost + b.cost")
    asked = a.join(b, on).select(F.col("a.id").alias("i"), F.col("b.id").alias("j")).distinct()
    of = lambda i, x: some.select(F.col("id").alias(i), F.col("node").alias(x), F.col("cost").alias(f"c{x}"), F.col("diff").alias(f"d{x}"))
    shared = asked.join(of("i", "x"), "i").join(of("j", "y"), "j").where(share * F.size(F.array_intersect("dx", "dy")) >= F.col("cx") + F.col("cy"))
    return sure.union(shared.select(F.least("x", "y"), F.greatest("x", "y"))).distinct()


def classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    component_id is the least doc_id reachable over links.  Empty sets (null or blank texts) link with nothing.
    Rows with one doc_id count as one document, linked if any of their texts is; a null doc_id is in the
    class of the rows with an equal set, else its component_id is null.
    """
    sig = kept(signatures(docs, k))
    groups = sig.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    groups = kept(groups)
    near = candidates(groups.where("node is not null").select(F.col("node").alias("doc_id"), "n", "sig"), percent)
    pairs, runs_of = kept(plausible(near.where("weight > 0").select("x", "y", "weight"), sig, percent)), near.where("dense").select(F.col("x").alias("u"), F.col("y").alias("v"))
    ends = pairs.select("x", "y", "weight", F.col("x").alias("at")).union(pairs.select("x", "y", "weight", F.col("y").alias("at")))
    best = ends.groupBy("at").agg(F.max_by(F.struct("x", "y"), F.struct("weight", -F.col("x"), -F.col("y"))).alias("p")).select("p.x", "p.y").distinct()
    best = kept(best)
    links = kept(verified(best, docs, k, percent))
    label = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")))
    rest = kept(_apart(pairs, label).select("x", "y").join(best, ["x", "y"], "left_anti"))
    spent = [near, pairs, best, rest, links, label]
    links = kept(links.union(verified(rest, docs, k, percent)))
    label = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")))
    if not runs_of.isEmpty():
        families = components(runs_of).withColumnRenamed("label", "family").join(label, "node", "left").select("node", "family", F.coalesce("label", "node").alias("comp"))
        new = kept(completed(families, docs, k, percent))
        spent += [new, links, label]
        if not new.isEmpty():
            links = kept(links.union(new))
            label = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")))
    named = kept(groups.join(label, "node", "left").select("h1", "h2", "n", "copies", F.coalesce("label", "node").alias("c")))
    dropped(*spent, links, label, groups)
    some = sig.where("n > 0").select("doc_id", "h1", "h2", "n")
    total = named.agg(F.sum("copies")).first()[0] or 0
    out = spread_join(some, named, ["h1", "h2", "n"], "copies", total).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
    return out.unionByName(sig.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def stage(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class: that of the least doc_id, once if it has several rows (that of the least hash of the text).  Rows
    without doc_id stay.  Only the texts of doc_ids that go or have several rows are dealt anew, and few others (see marked())."""
    gone = kept(classes(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct())
    repeated = kept(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    names = docs.columns
    all_rows = marked(docs, gone.union(repeated))
    rows = all_rows.where("maybe").drop("maybe").join(gone, "doc_id", "left_anti")
    once = rows.join(repeated, "doc_id", "left_anti").select(*names)
    numbered = rows.join(repeated, "doc_id", "left_semi").select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"))
    least = numbered.groupBy("_d").agg(F.min_by(F.struct(*(f"c{i}" for i in range(len(names)))), "_t").alias("r"))
    return all_rows.where("not maybe").select(*names).unionByName(once).unionByName(least.select(*(F.col(f"r.c{i}").alias(c) for i, c in enumerate(names))))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: doc_id, n_shingles, component_id, kept; shingles of four words, similarity of 80 percent."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs, 4, 80).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


SQL = r"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM l),
g AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS shingle FROM w),
s AS (SELECT DISTINCT doc_id, shingle FROM g WHERE i <= greatest(n - 3, 1)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * m >= 80 * (a.n + b.n - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM k LEFT JOIN c USING (doc_id)
"""
