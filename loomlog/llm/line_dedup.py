"""Line de-duplication by pairwise alignment.

Overlapping documents are found through shared lines: each document that has a line is linked to the first two that have
it, however frequent it is, so there are at most two links for each line of a document, and every repeated line has one.  Each
linked pair is aligned by patience diff: lines unique on both sides anchor the longest increasing run, and the stretches between
anchors are aligned in the same way; where a stretch has no such line, its rarest common one and its equal neighbours are taken.
Aligned lines are deleted from the later document.  Blank lines are neither compared nor deleted.

A line that the first two do not align may be aligned with a later holder, so with whole=True the lines deleted are those of an
alignment with all earlier documents.  An alignment depends on the lines that both have only.  So documents that share a line of FEW
holders at most are aligned as they are; all others go by their frequent lines, and documents alike in these are one kind: what is
left of a kind is aligned once with each earlier kind, not with each document of it.  See _rest().
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import NEWLINE, SPACES, dropped, kept, list_array, signed, slices, spread_join

_NULL = -(1 << 63)
#: So many links of one document are aligned by one task; a document with more is copied once for every so many.
LINKS = 1000
#: Lines of so many holders at most link each two of them; documents that share only more frequent ones meet by kinds.
FEW = 20
#: What a frequent line brings together is dealt to so many tasks.
SALTS = 64
#: Any run of lines that no other document is asked for, in a kind.
_GAP = 1


def _line_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lines in slices(batch.column(2), NEWLINE):
            space = np.concatenate([[0], np.cumsum(SPACES[lines.buf])])
            blank = space[lines.ends] - space[lines.starts] == lines.ends - lines.starts
            h = np.where(blank, 0, signed(lines.hashes()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lines.first, len(lines)) for i in (0, 1)), list_array(pa.array(h), lines.at)], ["d", "t", "lines"])


def line_lists(docs: DataFrame) -> DataFrame:
    """d (doc_id, the least long for null), t (a hash of the text), lines: the hash of each line that is not empty, 0 for one of white space only."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
    return rows.mapInArrow(_line_lists, "d long, t long, lines array<long>")


def _unique(x: list[int], lo: int, hi: int) -> dict[int, int]:
    """The place of each value that is in x[lo:hi] once, but for 0."""
    at: dict[int, int] = {}
    for k in range(lo, hi):
        at[x[k]] = -1 if x[k] in at else k
    return {v: k for v, k in at.items() if k >= 0 and v}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, which are sorted by the first place, that increases in the second too."""
    tops: list[int] = []
    ends: list[int] = []
    links: list[int] = []
    for k, (_, i) in enumerate(pairs):
        at = bisect_left(tops, i)
        tops[at : at + 1], ends[at : at + 1] = [i], [k]
        links.append(ends[at - 1] if at else -1)
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = links[k]
    return chain[::-1]


def _rarest(old: list[int], new: list[int], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """Of old[a:b] and new[c:d], the first of the rarest common values, at its first place in either."""
    mine: dict[int, list[int]] = {}
    for k in range(a, b):
        mine.setdefault(old[k], []).append(k)
    at = min(((len(mine[new[j]]), j) for j in range(c, d) if new[j] and new[j] in mine), default=None)
    return [(at[1], mine[new[at[1]]][0])] if at else []


def alignment(old: list[int], new: list[int]) -> list[tuple[int, int]]:
    """Pairs (place in new, place in old) of aligned lines, increasing in both.  0 is aligned with 0 only as a neighbour of another line."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(old), 0, len(new))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and old[a] == new[c]:
            out.append((c, a))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            out.append((d, b))
        if a == b or c == d:
            continue
        mine = _unique(old, a, b)
        chain = _increasing(sorted((j, mine[v]) for v, j in _unique(new, c, d).items() if v in mine)) or _rarest(old, new, a, b, c, d)
        for j, i in chain:
            todo.append((a, i, c, j))
            out.append((j, i))
            a, c = i + 1, j + 1
        if chain:
            todo.append((a, b, c, d))
    return sorted(out)


def aligned(old, new) -> np.ndarray:
    """The places of `new` that patience diff aligns with `old`, but for blank lines."""
    new = list(map(int, new))
    return np.array([j for j, _ in alignment(list(map(int, old)), new) if new[j]], np.int64)


def _linked(lists: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """pairs(), and where they come from: lines (line, d, t); the number _n of each line's holders, if several; of these the third
    and later ones (line, d, t); the sum of _n."""
    lines = kept(lists.select("d", "t", F.explode(F.array_distinct("lines")).alias("line")).where("line <> 0"))
    out, rest, spent, holders = None, lines, [], []
    for _ in range(2):
        first = rest.groupBy("line").agg(F.min(F.struct("d", "t")).alias("o"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        first = kept(first.select("line", F.col("o.d").alias("od"), F.col("o.t").alias("ot"), "_n"))
        total = first.agg(F.sum("_n")).first()[0] or 0
        rest = spread_join(rest, first, ["line"], "_n", total).where("d <> od or t <> ot")
        rest = kept(rest.select("line", "d", "t", "od", "ot"))
        holders.append((first, total))
        spent.append(rest)
        found = rest.select("od", "ot", F.col("d").alias("nd"), F.col("t").alias("nt"))
        out = found if out is None else out.unionByName(found)
        rest = rest.select("line", "d", "t")
    out = kept(out.distinct())
    dropped(spent[0], holders[1][0])
    return out, lines, holders[0][0], spent[1], holders[0][1]


def pairs(lists: DataFrame) -> DataFrame:
    """od, ot, nd, nt: each document (d, t) with the first, and with the second, of those before it that share a line with it."""
    out, *spent, _ = _linked(lists)
    dropped(*spent)
    return out


def _hits(lists: DataFrame, found: DataFrame) -> DataFrame:
    """nd, nt, od, places: what each linked pair aligns.  Both are read twice: pass kept tables."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [aligned(o, n) for o, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], list_array(pa.array(np.concatenate([np.zeros(0, np.int64), *places])), np.cumsum([0, *map(len, places)]))], ["nd", "nt", "od", "places"])

    olds = kept(found.groupBy("od", "ot").agg(F.count(F.lit(1)).alias("_n")))
    total = olds.agg(F.sum("_n")).first()[0] or 0
    salt = lambda n: F.floor(n / LINKS).cast("int")
    asked = spread_join(found, olds, ["od", "ot"], "_n", total).withColumn("_salt", F.pmod(F.xxhash64("nd", "nt"), salt(F.col("_n")) + 1).cast("int"))
    old = lists.join(olds, (lists.d == olds.od) & (lists.t == olds.ot)).select("od", "ot", F.col("lines").alias("lo"), F.explode(F.sequence(F.lit(0), salt(F.col("_n")))).alias("_salt"))
    new = lists.select(F.col("d").alias("nd"), F.col("t").alias("nt"), F.col("lines").alias("ln"))
    both = asked.drop("_n").join(old, ["od", "ot", "_salt"]).join(new, ["nd", "nt"])
    return both.select("nd", "nt", "od", "lo", "ln").mapInArrow(align, "nd long, nt long, od long, places array<long>").where(F.size("places") > 0)


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of d, t, lines and the frequent ones among them: the lines with _GAP for each run of others, and the places of the frequent ones.

    Blank lines between two gaps are next to no line that is aligned, so they are of the gap.
    """
    for batch in batches:
        lists, places = [], []
        for lines, frequent in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            held, out, at, gap = set(frequent), [], [], -1
            for k, x in enumerate(lines):
                if x in held:
                    out.append(x)
                    at.append(k)
                    gap = -1
                elif not x:
                    out.append(0)
                else:
                    if gap >= 0:
                        del out[gap:]
                    gap = len(out)
                    out.append(_GAP)
            lists.append(out)
            places.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, pa.list_(pa.int64())) for x in (lists, places))], ["d", "t", "kind", "at"])


def _align_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of h, e, od, ot, oh, oe, and the lists of the older and the newer kind: which of the newer's frequent lines (from 0) are aligned."""
    for batch in batches:
        found = []
        for old, new in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
            number = np.cumsum([x not in (0, _GAP) for x in new]) - 1
            found.append([int(number[j]) for j in aligned(old, [_GAP + 1 if x == _GAP else x for x in new]) if new[j] != _GAP])
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(found, pa.list_(pa.int64()))], ["h", "e", "od", "ot", "oh", "oe", "ks"])


def _before(d: str, t: str, nd: str = "nd", nt: str = "nt"):
    return (F.col(d) < F.col(nd)) | ((F.col(d) == F.col(nd)) & (F.col(t) < F.col(nt)))


def _salted(df: DataFrame):
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _rest(lists: DataFrame, found: DataFrame, hits: DataFrame, lines: DataFrame, counts: DataFrame, later: DataFrame, total: int) -> DataFrame:
    """nd, nt, od, places as of _hits(): what alignments with all earlier documents beyond those of `found` add to hits, each place with
    one of these documents at least.  The other tables are those of _linked().

    Asked are the documents with a place left whose line has two earlier holders.  A document that shares a line of FEW holders with
    one of them is `near` it, and aligned with it as it is.  All others share frequent lines with it only, so the first of their kind
    stands for them; if that one is near, the first of the kind that is not.
    """
    new, old, kind = ["nd", "nt"], ["od", "ot"], ["h", "e"]
    none = F.array().cast("array<long>")
    at = F.filter(F.transform("lines", lambda x, i: F.when(x != 0, i.cast("long"))), lambda i: i.isNotNull())
    left = F.array_distinct(F.transform(F.array_except(at, F.coalesce("removed", none)), lambda i: F.element_at("lines", (i + 1).cast("int"))))
    gone = hits.groupBy(F.col("nd").alias("d"), F.col("nt").alias("t")).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("removed"))
    others = later.groupBy("d", "t").agg(F.collect_set("line").alias("others"))
    asking = lists.join(others, ["d", "t"]).join(gone, ["d", "t"], "left").select("d", "t", "lines", F.array_intersect("others", left).alias("left")).where(F.size("left") > 0)
    marked = lambda x, asked: F.transform(x, lambda v: F.struct(v.alias("line"), F.lit(asked).alias("asked")))
    own = asking.select(F.col("d").alias("nd"), F.col("t").alias("nt"), F.explode(F.concat(marked(F.array_except("lines", "left"), False), marked(F.col("left"), True))).alias("s"))
    own = kept(own.select(*new, "s.line", "s.asked").where("line <> 0"))
    spent = [own]
    own = kept(spread_join(own, counts.select("line", "_n"), ["line"], "_n", total))
    known = kept(own.groupBy("line").agg(F.max("_n").alias("_n"), F.max("asked").alias("asked")))
    met = kept(spread_join(lines, known, ["line"], "_n", total))

    near = met.where(F.col("_n") <= FEW).select("line", F.col("d").alias("od"), F.col("t").alias("ot")).join(own.where(F.col("_n") <= FEW).select("line", *new), "line")
    near = kept(near.where(_before(*old)).select(*old, *new).distinct())
    by_pairs = _hits(lists, kept(near.join(found, [*old, *new], "left_anti")))

    holding = met.where(F.col("_n") > FEW).groupBy("d", "t").agg(F.collect_set("line").alias("frequent"), F.max("asked").alias("asked")).where("asked")
    listed = lists.join(holding, ["d", "t"]).select("d", "t", "lines", "frequent").mapInArrow(_kinds, "d long, t long, kind array<long>, at array<long>")
    listed = kept(listed.withColumns({"h": F.xxhash64("kind"), "e": F.xxhash64(F.lit(1), "kind")}))
    kinds = listed.groupBy(*kind).agg(F.min(F.struct("d", "t")).alias("o"), F.first("kind").alias("kind"), F.count(F.lit(1)).alias("_n"))
    kinds = kept(kinds.select(*kind, F.col("o.d").alias("od"), F.col("o.t").alias("ot"), "kind", "_n"))
    members = kinds.agg(F.sum("_n")).first()[0] or 0
    asks = own.where(F.col("asked") & (F.col("_n") > FEW)).groupBy(*new).agg(F.collect_set("line").alias("asked"))
    asks = kept(asks.join(listed.select(F.col("d").alias("nd"), F.col("t").alias("nt"), "at", *kind), new))
    newer = asks.select(*kind, *new, F.explode("asked").alias("line")).groupBy(*kind, "line").agg(F.max(F.struct(*new)).alias("l"))
    newer = newer.groupBy(*kind).agg(F.collect_list("line").alias("asked"), F.max("l").alias("l")).join(kinds.select(*kind, "kind"), kind)
    newer = _salted(newer.select(*kind, F.col("l.nd").alias("nd"), F.col("l.nt").alias("nt"), "asked", F.col("kind").alias("new"), F.explode("asked").alias("line")))
    older = kinds.select(*old, F.col("h").alias("oh"), F.col("e").alias("oe"), F.col("kind").alias("old"), F.explode(F.array_distinct("kind")).alias("line")).where(~F.col("line").isin(0, _GAP))
    older = older.withColumn("_salt", F.pmod(F.xxhash64("oh", "oe"), F.lit(SALTS)).cast("int"))
    both = newer.join(older, ["line", "_salt"]).where(_before(*old) & (F.col("line") == F.array_min(F.array_intersect("asked", "old"))))
    both = both.select(*kind, *old, "oh", "oe", "old", "new").mapInArrow(_align_kinds, "h long, e long, od long, ot long, oh long, oe long, ks array<long>")
    got = kept(both.select(*kind, *old, "oh", "oe", F.explode("ks").alias("k")))

    odd = kept(near.join(kinds.select(*old), old).select(*new).distinct())
    best = got.groupBy(*kind, "k").agg(F.min(F.struct(*old)).alias("o")).groupBy(*kind).agg(F.collect_list(F.struct("o", "k")).alias("best"))
    best = kept(best.join(kinds.select(*kind, "_n"), kind))
    even = kept(asks.join(odd, new, "left_anti").select(*new, "at", *kind))
    place = F.array(F.element_at("at", (F.col("k") + 1).cast("int"))).alias("places")
    by_kinds = spread_join(even, best, kind, "_n", members).select(*new, "at", F.explode("best").alias("b")).select(*new, "at", F.col("b.o.od").alias("od"), F.col("b.o.ot").alias("ot"), F.col("b.k").alias("k"))
    by_kinds = by_kinds.where(_before(*old)).select(*new, "od", place)

    single = kept(asks.join(odd, new).select(*new, "at", *kind).join(got, kind).where(_before(*old)).select(*new, *old, "oh", "oe", "k", place))
    by_one = single.join(near, [*old, *new], "left_anti").select(*new, "od", "places")
    stands = listed.select(F.col("d").alias("od"), F.col("t").alias("ot"), F.col("h").alias("oh"), F.col("e").alias("oe")).withColumn("_salt", F.pmod(F.xxhash64(*old), F.lit(SALTS)).cast("int"))
    other = _salted(single.join(near, [*old, *new], "left_semi").drop(*old)).join(stands, ["oh", "oe", "_salt"]).where(_before(*old)).join(near, [*old, *new], "left_anti")
    by_other = other.groupBy(*new, "oh", "oe", "k", "places").agg(F.min("od").alias("od")).select(*new, "od", "places")
    out = kept(by_pairs.unionByName(by_kinds).unionByName(by_one).unionByName(by_other))
    dropped(*spent, own, known, met, near, listed, kinds, asks, got, odd, best, even, single)
    return out


def removals(docs: DataFrame, whole: bool = False) -> DataFrame:
    """d, t (see line_lists()), n_lines (not empty), removed: sorted places of the lines to delete, counted over lines that are not empty, and
    olds: doc_ids they are aligned with, one for each line at least.  A row for each document: rows alike in doc_id and text are one, which is no copy of itself.

    Earlier is: of smaller doc_id, null before all, or of the same and a smaller hash of the text.  Null texts have no lines.
    whole: what the first two holders of its lines leave of a document is aligned with all other earlier holders too.
    """
    lists = kept(line_lists(docs).dropDuplicates(["d", "t"]))
    found, *of, total = _linked(lists)
    hits = _hits(lists, found)
    if whole:
        hits = kept(hits)
        hits = hits.unionByName(_rest(lists, found, hits, *of, total))
    dropped(*of)
    gone = hits.groupBy("nd", "nt").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("removed"), F.array_sort(F.collect_set(F.when(F.col("od") != _NULL, F.col("od")))).alias("olds"))
    none = F.array().cast("array<long>")
    joined = lists.join(gone, (lists.d == gone.nd) & (lists.t == gone.nt), "left")
    return joined.select("d", "t", F.size("lines").cast("long").alias("n_lines"), F.coalesce("removed", none).alias("removed"), F.coalesce("olds", none).alias("olds"))


def applied(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, n_lines, removed, olds of every row of docs, repeated rows included: see removals()."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    return rows.join(removals(docs, whole), ["d", "t"]).select("doc_id", "n_lines", "removed", "olds")


def without(text, removed):
    """The text without the lines at these places (columns): see removals()."""
    lines = F.split(text, "\n")
    full = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.length(s.x) > 0)
    left = F.filter(F.transform(full, lambda s, i: F.struct(s.x.alias("x"), i.cast("long").alias("i"))), lambda s: ~F.array_contains(removed, s.i))
    return F.array_join(F.transform(left, lambda s: s.x), "\n")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: doc_id, n_lines, n_removed, removed, olds of every document."""
    out = applied(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), whole=True)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "olds")
