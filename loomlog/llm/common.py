"""What several operators share: vectorised text splitting and hashes.  Tables and ranks come from the core.

Text is handled as one flat UTF-8 byte array for each slice of an Arrow batch.  The separators of
``[^\\x20\\x09-\\x0D]+`` are single ASCII bytes that never occur inside a longer UTF-8 sequence, so splitting bytes
is exact.  A word is hashed eight bytes at a time, all words of a slice at once; a long one (a line, say) as a tree of blocks: no
Python loop over words.  Every step is multiplied and folded by mix(), so that no arrangement of bytes cancels out, as it
can in a polynomial modulo 2^64.  These hashes are not keyed: equality that an adversary may attack needs fingerprints.digests().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators.tables import dropped, kept, ranked, shared_dir, shuffle_partitions

__all__ = ["dropped", "kept", "ranked", "shared_dir", "shuffle_partitions"]

#: Bytes of text that are split at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

U64 = np.uint64


#: Keys that hold more than one row in HOT are broadcast; there are HOT of them at most, whatever the input.
HOT = 20_000


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows joined with keyed, which has one row for each key and in `count` how many of the `total` rows have that key.

    A key with more than total / HOT rows would weigh down the task it is dealt to.  There are fewer than HOT such
    keys, so these are broadcast, a bound that holds for any input; all other rows meet their key by a shuffle.  Both
    sides are read twice: pass kept tables.
    """
    hot = F.col(count) > F.lit(total // HOT)
    often = F.broadcast(keyed.where(hot))
    columns = [*rows.columns, *(c for c in keyed.columns if c not in on)]
    rest = rows.join(F.broadcast(keyed.where(hot).select(*on)), on, "left_anti").join(keyed.where(~hot), on)
    return rows.join(often, on).select(*columns).unionByName(rest.select(*columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- text as bytes

#: Odd multipliers for the places of a short run of words.
_PLACES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
#: Masks that keep the first 0 to 8 bytes of a little-endian value.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
#: Values of one block of a tree hash.
_BLOCK = 8

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits; bytes of longer sequences count as letters.
NON_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def folded(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each range of values: blocks of _BLOCK are hashed in turn, then the hashes of the blocks, up to one."""
    count, level = ends - starts, seed
    length = count.astype(U64)
    while True:
        level += 1
        blocks = np.maximum(-(-count // _BLOCK), 1)
        single = len(blocks) == 0 or int(blocks.max()) == 1
        if single:
            lo, hi = starts, ends
        else:
            at = np.cumsum(blocks) - blocks
            step = (np.arange(int(blocks.sum())) - np.repeat(at, blocks)) * _BLOCK
            lo = np.repeat(starts, blocks) + step
            hi = np.minimum(lo + _BLOCK, np.repeat(ends, blocks))
        h = np.full(len(lo), U64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        for j in range(int((hi - lo).max()) if len(lo) else 0):
            some = np.flatnonzero(lo + j < hi)
            if len(some) == len(lo):
                h = mix((h ^ values[lo + j]) * _PLACES[j])
            else:
                h[some] = mix((h[some] ^ values[lo[some] + j]) * _PLACES[j])
        if single:
            return mix(h ^ length * U64(0xD6E8FEB86659FD93))
        values, starts = h, at
        ends, count = at + blocks, blocks


@dataclass
class Words:
    """The words of some consecutive texts: word i is buf[starts[i]:ends[i]]; text d has words at[d] to at[d + 1]."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    _padded: np.ndarray | None = field(default=None, repr=False)

    def __len__(self) -> int:
        """Number of texts."""
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def owner(self) -> np.ndarray:
        """Of each word, the text it is in."""
        return np.repeat(np.arange(len(self)), self.counts)

    def hashes(self, longest: int | None = None, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `longest` bytes; hashes of different seeds are independent."""
        if not len(self.starts):
            return np.zeros(0, U64)
        if self._padded is None:
            self._padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.buf) + 1, "<u8", self._padded, 0, (1,))
        starts, ends = self.starts, self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        size = ends - starts
        out = eight[starts] & _MASKS[np.minimum(size, 8)]
        out = mix((out ^ U64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * _PLACES[0] + size.astype(U64) * U64(0xD6E8FEB86659FD93))
        long = np.flatnonzero(size > 8)
        if len(long):
            pieces = -(-size[long] // 8)
            to = np.cumsum(pieces)
            step = (np.arange(int(to[-1])) - np.repeat(to - pieces, pieces)) * 8
            at = np.repeat(starts[long], pieces) + step
            values = eight[at] & _MASKS[np.minimum(np.repeat(ends[long], pieces) - at, 8)]
            out[long] = mix(out[long] ^ folded(values, to - pieces, to, seed))
        return out


def runs(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of k values; the result is shorter by k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64((seed + k) * 0x9E3779B97F4A7C15 % (1 << 64)))
    for j in range(k):
        out = mix((out ^ h[j : j + n]) * _PLACES[j % 64])
    return out


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offset of each text; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, first: int = 0) -> Words:
    word = ~separators[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    if len(buf):
        before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(len(buf), bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return Words(first, buf, offsets, starts, ends, np.searchsorted(starts, offsets))


def slices(texts: pa.Array, separators: np.ndarray = SPACES, bytes_map: np.ndarray | None = None, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of all texts, in slices of about `limit` bytes; Words.first is the index of a slice's first text."""
    buf, offsets = flat(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        piece = buf[offsets[at] : offsets[to]]
        yield split(piece if bytes_map is None else bytes_map[piece], offsets[at : to + 1] - offsets[at], separators, at)
        at = to


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's longs."""
    return h.view(np.int64)


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
