"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For every benchmark item of n words, each window of n words of a text is compared with it.  A window's 64-bit SimHash is
over its k-word shingles; the fingerprint is cut into BLOCKS blocks, and by the pigeonhole principle two fingerprints
within RADIUS differ by at most RADIUS // BLOCKS bits in some block.  So a table for each length and block, from block value to items,
yields all items within RADIUS: those under the values near the window's own.  At similarity 0.8 the expected distance is 10 of 64 bits, its
deviation 3; RADIUS is 23.
Candidates are verified: sum of minima over sum of maxima of the shingle weights (their counts) must reach `least`.

Windows without any shingle of an item of their length have similarity 0 with all of these and are not fingerprinted.
The items are broadcast, in groups of at most GROUP_BYTES of text each (and one more item), so that what the driver and a task hold has a bound
however large the benchmark is; each group is one pass over the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import LOWER, U64, runs, slices

RADIUS, BLOCKS = 23, 4
GROUP_BYTES = 8 << 20
_BITS = 64 // BLOCKS
_ONES = np.array([i.bit_count() for i in range(1 << 16)], np.uint8)
_SHIFTS = np.arange(64, dtype=np.uint64)
#: Shingles whose bits are held at once, 1 KB each.
SPAN = 1 << 14


def simhashes(shingles: np.ndarray, width: int) -> np.ndarray:
    """The SimHash of each run of `width` shingles: for every bit, whether most have it."""
    votes = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(((shingles[:, None] >> _SHIFTS) & U64(1)).astype(np.int32), 0, out=votes[1:])
    most = 2 * (votes[width:] - votes[:-width]) > width
    return np.packbits(most, axis=1, bitorder="little").view(np.uint64)[:, 0]


def simhashes_at(shingles: np.ndarray, width: int, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, their SimHashes) for the runs at sorted starts, a stretch of bounded length at a time."""
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(starts, starts[at] + SPAN))
        here = starts[at:to]
        yield here, simhashes(shingles[here[0] : here[-1] + width], width)[here - here[0]]
        at = to


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ONES[np.ascontiguousarray(a ^ b).view(np.uint16).reshape(len(a), 4)].sum(1)


class Items:
    """Benchmark items by number of words, with their fingerprints and block tables."""

    def __init__(self, ids: list[int], texts: list[str], k: int):
        self.k, self.ids, self.bags, of_length, shingles_of = k, [], [], {}, []
        for words in slices(pa.array(texts, pa.string()), bytes_map=LOWER):
            h = words.hashes()
            for d in range(len(words)):
                own = h[words.at[d] : words.at[d + 1]]
                if len(own):
                    of_length.setdefault(len(own), []).append(len(self.ids))
                    shingles_of.append(runs(own, min(k, len(own))))
                    self.ids.append(ids[words.first + d])
                    self.bags.append(Counter(shingles_of[-1].tolist()))
        self.by_length = {n: np.array(of) for n, of in of_length.items()}
        self.prints = {n: np.array([simhashes(shingles_of[i], len(shingles_of[i]))[0] for i in of], U64) for n, of in self.by_length.items()}
        self.known = {n: np.unique(np.concatenate([shingles_of[i] for i in of])) for n, of in self.by_length.items()}
        #: For each shingle size: a small table that rules out most shingles, all known ones, and for each of these the lengths of its items.
        self.sizes = {}
        for size in {min(k, n) for n in self.by_length}:
            lengths = [n for n in self.by_length if min(k, n) == size]
            pairs = np.unique(np.concatenate([np.stack([self.known[n], np.full(len(self.known[n]), n, U64)], 1) for n in lengths]), axis=0)
            mine, first = np.unique(pairs[:, 0], return_index=True)
            seen = np.zeros(1 << 20, bool)
            seen[mine >> U64(44)] = True
            self.sizes[size] = seen, mine, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)
        self.tables = {n: [self._table(n, b) for b in range(BLOCKS)] for n in self.by_length}

    def _table(self, n: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct values of a block (65,536 at most), where each one's items begin, and the items."""
        value = self._block(self.prints[n], block)
        order = np.argsort(value, kind="stable")
        distinct, first = np.unique(value[order], return_index=True)
        return distinct, np.append(first, len(order)), order

    @staticmethod
    def _block(prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> U64(_BITS * block)) & U64((1 << _BITS) - 1)).astype(np.int64)

    def near(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item of n words) pairs within RADIUS, sorted."""
        of = self.prints[n]
        pairs = [np.zeros(0, np.int64)]
        for b in range(BLOCKS):
            distinct, first, items = self.tables[n][b]
            mine, window_of = np.unique(self._block(prints, b), return_inverse=True)
            windows, bounds = np.argsort(window_of, kind="stable"), np.searchsorted(np.sort(window_of), np.arange(len(mine) + 1))
            for v in range(len(mine)):  # windows that follow each other share most block values
                hit = np.flatnonzero(_ONES[distinct ^ mine[v]] <= RADIUS // BLOCKS)
                if len(hit):
                    found = np.concatenate([items[first[x] : first[x + 1]] for x in hit.tolist()])
                    here = windows[bounds[v] : bounds[v + 1]]
                    some = (here[:, None] * len(of) + found[None, :]).ravel()
                    pairs.append(some[distances(prints[some // len(of)], of[some % len(of)]) <= RADIUS])
        both = np.unique(np.concatenate(pairs))
        return both // len(of), both % len(of)

    def lengths(self, hits: dict[int, np.ndarray]) -> np.ndarray:
        """The lengths of the items that have one of these shingles (numbers of known ones, by size)."""
        out = [np.zeros(0, np.int64)]
        for size, known in hits.items():
            _, _, first, lengths = self.sizes[size]
            out += [lengths[first[i] : first[i + 1]] for i in np.unique(known).tolist()]
        return np.unique(np.concatenate(out))

    def found(self, own: dict[int, np.ndarray], hits: dict[int, tuple[np.ndarray, np.ndarray]], least: float) -> dict[int, tuple[float, int]]:
        """For each item in a text: the largest similarity of a window, and where it starts.

        own: the text's shingles by size.  hits: the places of known ones and which they are.
        """
        best: dict[int, tuple[float, int]] = {}
        for n in self.lengths({size: which for size, (_, which) in hits.items()}).tolist():
            size = min(self.k, n)
            shingles, width = own[size], n - size + 1
            windows = len(shingles) - width + 1
            if windows <= 0:
                continue
            at, known = hits[size][0], self.known[n]
            at = at[known[np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)] == shingles[at]]
            mark = np.zeros(windows + 1, np.int64)
            np.add.at(mark, np.maximum(at - width + 1, 0), 1)
            np.add.at(mark, np.minimum(at + 1, windows), -1)
            starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            for here, prints in simhashes_at(shingles, width, starts):
                for w, j in zip(*(x.tolist() for x in self.near(n, prints)), strict=True):
                    i, at = int(self.by_length[n][j]), int(here[w])
                    bag = Counter(shingles[at : at + width].tolist())
                    low = sum((bag & self.bags[i]).values())
                    likeness = low / (2 * width - low)
                    if likeness >= least and likeness > best.get(i, (0.0, 0))[0]:
                        best[i] = likeness, at
        return best


def _groups(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The items, in groups of bounded size."""
    ids, texts, total = [], [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        total += len(r.text)
        if total >= GROUP_BYTES:
            yield ids, texts
            ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def _matches(items: Items, texts: pa.Array, least: float) -> Iterator[dict[int, tuple[float, int]]]:
    for words in slices(texts, bytes_map=LOWER):
        h, at = words.hashes(), words.at
        shingles, shared = {}, {}
        for size, (seen, known, _, _) in items.sizes.items():
            own = shingles[size] = runs(h, size)
            maybe = np.flatnonzero(seen[own >> U64(44)])
            which = np.minimum(np.searchsorted(known, own[maybe]), len(known) - 1)
            hit = known[which] == own[maybe]
            shared[size] = maybe[hit], which[hit]
        for d in range(len(words)):
            a, b = at[d], at[d + 1]
            hits = {}
            for size, (places, which) in shared.items():
                lo, hi = np.searchsorted(places, [a, max(a, b - size + 1)])
                if hi > lo:
                    hits[size] = places[lo:hi] - a, which[lo:hi]
            yield items.found({size: shingles[size][a : max(a, b - size + 1)] for size in hits}, hits, least) if hits else {}


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity, at (the word where the best window starts): every text against every item.

    Null or blank texts and items match nothing; an item of fewer than k words is one shingle; repeated rows are reported
    each; of the items with one item_id each text is compared.
    """
    out = None
    for ids, texts in _groups(benchmark):

        def rows(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            items = Items(ids, texts, k)
            for batch in batches:
                doc, item, likeness, at = [], [], [], []
                for d, found in enumerate(_matches(items, batch.column(1), least)):
                    for i, (s, a) in found.items():
                        doc.append(d), item.append(items.ids[i]), likeness.append(s), at.append(a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()), pa.array(likeness, pa.float64()), pa.array(at, pa.int64())], ["doc_id", "item_id", "similarity", "at"])

        part = docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, item_id long, similarity double, at long")
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, at long")


def stage(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """The documents without a window like an item, with all their columns."""
    columns, schema = docs.columns, docs.schema
    for ids, texts in _groups(benchmark):

        def clean(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            items = Items(ids, texts, k)
            for batch in batches:
                yield batch.filter(pa.array([not found for found in _matches(items, batch.column(columns.index("text")), least)], pa.bool_()))

        docs = docs.mapInArrow(clean, schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    """op4: doc_id, item_id, similarity and at of every document that holds a benchmark item."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    found = contamination(read("documents"), read("benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))
