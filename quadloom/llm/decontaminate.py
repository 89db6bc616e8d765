"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

An item leaks into a document if some window of the item's length has a
weighted Jaccard similarity of 0.8 or more with it, where a bag of five-word
shingles weighs each shingle by how often it occurs.

1. Windows have an item's own size and start at every shingle. One that leaks
   shares 8/9 of its shingles with the item, so windows with fewer shingles of the
   items of that size are no candidates; in clean text none are left.
2. The others are fingerprinted: 128 bits, each what more than half of the
   window's shingles have there.
3. Four blocks of 32 bits index the items' fingerprints. One within `RADIUS` = 31
   bits agrees with the item in one of the blocks to 7 bits, and in one of the
   block's halves to 3. The halves are looked up by value, at the 697 values within 3 bits of
   the window's, so no item within the radius is missed, and about 0.4 % of unlike
   pairs get beyond the blocks.
4. Around each candidate all windows of the item's length are compared exactly.

A window at a similarity of exactly 0.8 differs by 19.4 bits on average, with a
deviation of 4.1; `RADIUS` is 2.8 deviations above, and a leak has several windows.

The benchmark is a query set: it is collected in blocks of at most `BLOCK_BYTES` of text (or
one item), each is built into one compact index that is broadcast, and passes over all documents.

Cases: null or empty texts and items match nothing; a text or an item of one to
four words has one shingle of them all; a document shorter than an item is
compared whole; repeated rows and items give repeated results; a null doc_id or
item_id stays null; extra columns are not read; empty tables give empty results.
A long text takes memory for its shingles (8 bytes each), not for its windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm import vectext as V
from quadloom.llm.scratch import tune

WORDS = 5
SIMILARITY = 0.8
BITS, RADIUS = 128, 31
#: Bytes of items' text that are indexed, and broadcast, at once: with its index a block is a few times as large.
BLOCK_BYTES = 32 << 20
#: Windows that are fingerprinted and looked up at once.
CHUNK = 64

_BLOCK_BITS, _HALF_RADIUS = 32, 3
_OTHER = np.uint64(0x9E3779B97F4A7C15)
#: All changes of up to _HALF_RADIUS bits of a half block.
_NEAR = np.array([sum(1 << b for b in c) for r in range(_HALF_RADIUS + 1) for c in combinations(range(16), r)], np.uint16)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """128 bits of each shingle, as bytes 0 and 1."""
    return np.unpackbits(np.stack([hashes, V.mix(hashes ^ _OTHER)], axis=1).view(np.uint8), axis=1)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The fingerprints, two 64-bit integers each, of the windows of `size` shingles at the given starts, in order."""
    out, at = np.empty((len(starts), BITS // 64), np.uint64), 0
    while at < len(starts):  # windows that are near each other share their sums
        to = at + max(1, int(np.searchsorted(starts[at : at + 4 * CHUNK], starts[at] + size + 4 * CHUNK)))
        base = starts[at]
        sums = np.zeros((starts[to - 1] + size - base + 1, BITS), np.int32)
        np.cumsum(_bits(hashes[base : starts[to - 1] + size]), axis=0, dtype=np.int32, out=sums[1:])
        here = starts[at:to] - base
        out[at:to] = np.packbits(sums[here + size] - sums[here] > size // 2, axis=1).view(np.uint64)
        at = to
    return out


def _least(item: int, size: int) -> int:
    """The least overlap of an item and a window of these sizes that reaches the threshold."""
    return max(1, ceil(SIMILARITY * (item + size) / (1 + SIMILARITY) - 1e-9))


class Index:
    """Arrays of the items of a block: their bags, fingerprints, half blocks in order of value, and which sizes have a shingle."""

    def __init__(self, rows: list[tuple]):
        doc, hashes = _shingled(pa.array([t for _, t in rows], pa.string()))
        doc, bag, times = V.counted(doc, hashes)
        total = np.bincount(doc, weights=times, minlength=len(rows)).astype(np.int64)
        some = np.flatnonzero(total)
        self.ids = [rows[i][0] for i in some]
        self.size = total[some]
        self.first = np.append(np.searchsorted(doc, some), len(doc))
        self.bag, self.times = bag, times
        own = (_bits(bag[a:b]).astype(np.int64) * times[a:b, None] for a, b in zip(self.first[:-1], self.first[1:], strict=True))
        sums = np.array([x.sum(axis=0) for x in own]).reshape(-1, BITS)
        self.prints = np.packbits(sums > (self.size // 2)[:, None], axis=1).view(np.uint64).reshape(-1, BITS // 64)
        halves = self.prints.view(np.uint16).T
        self.order = np.argsort(halves, axis=1, kind="stable").astype(np.int32)
        self.starts = np.stack([np.searchsorted(h[o], np.arange((1 << 16) + 1)) for h, o in zip(halves, self.order, strict=True)]).astype(np.int32)
        self.sizes = np.unique(self.size)
        self.keys, which = np.unique(bag, return_inverse=True)
        self.kinds = np.zeros(len(self.keys), np.uint64)  # bits of the items' sizes, modulo 64
        np.bitwise_or.at(self.kinds, which, np.uint64(1) << (total[doc] % 64).astype(np.uint64))
        width = min(24, max(10, (16 * len(self.keys)).bit_length()))
        self.shift = np.uint64(64 - width)
        self.maybe = np.zeros(1 << width, bool)
        self.maybe[self.keys >> self.shift] = True

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def near(self, prints: np.ndarray, item_sizes: tuple[int, int]) -> list[tuple[int, int]]:
        """(window, item) of all fingerprints within the radius, of items of these sizes (least, most)."""
        pairs = set()
        for a in range(0, len(prints), CHUNK):
            part = np.ascontiguousarray(prints[a : a + CHUNK])
            for h, halves in enumerate(part.view(np.uint16).T):
                values = (halves[:, None] ^ _NEAR).astype(np.int64)
                low = self.starts[h][values]
                n = self.starts[h][values + 1] - low
                who, where = np.nonzero(n)
                n, low = n[who, where], low[who, where]
                place = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
                who, item = np.repeat(who, n), self.order[h][place]
                fit = (self.size[item] >= item_sizes[0]) & (self.size[item] <= item_sizes[1])
                who, item = who[fit], item[fit]
                block = np.uint64(h // 2 % 2 * _BLOCK_BITS)  # the half's whole block, then all of the fingerprint
                differ = part[who] ^ self.prints[item]
                in_block = np.bitwise_count(differ[:, h // 4] >> block & np.uint64((1 << _BLOCK_BITS) - 1))
                close = (in_block <= RADIUS // (BITS // _BLOCK_BITS)) & (np.bitwise_count(differ).sum(axis=1) <= RADIUS)
                pairs.update(zip((who[close] + a).tolist(), item[close].tolist(), strict=True))
        return sorted(pairs)

    def find(self, texts: pa.Array) -> Iterator[tuple[int, object, float, int, int]]:
        """(row, item_id, similarity, first word, words) of the best window of each item that leaks into a text."""
        if not self.ids:
            return
        for a, b in V.pieces(texts, V.PIECE // 2):
            doc, hashes = _shingled(texts.slice(a, b - a))
            at = np.flatnonzero(self.maybe[hashes >> self.shift])
            key = np.searchsorted(self.keys, hashes[at])
            key[key == len(self.keys)] = 0
            known = self.keys[key] == hashes[at]
            at, kinds = at[known], self.kinds[key[known]]
            first, held = np.searchsorted(doc, np.arange(b - a + 1)), np.searchsorted(doc[at], np.arange(b - a + 1))
            for d in np.flatnonzero(np.diff(held) >= max(1, SIMILARITY * self.sizes[0] - 1e-9)):
                own = slice(held[d], held[d + 1])
                for n, (similarity, start, words) in sorted(self._leaks(hashes[first[d] : first[d + 1]], at[own] - first[d], kinds[own]).items()):
                    yield a + int(d), self.ids[n], similarity, start, words

    def _leaks(self, hashes: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """The first of the most similar windows of each item. at: places of shingles that items have; kinds: the sizes of those items."""
        best: dict[int, tuple[float, int, int]] = {}
        every = int(np.bitwise_or.reduce(kinds))
        for size in self.sizes[self.sizes * SIMILARITY <= len(hashes) + 1e-9].tolist():
            if not every >> size % 64 & 1:
                continue
            own = at[kinds >> np.uint64(size % 64) & np.uint64(1) == 1]
            window = min(size, len(hashes))
            need = _least(size, window)
            if len(own) < need:
                continue
            low, top = np.maximum(own[need - 1 :] - window + 1, 0), np.minimum(own[: len(own) - need + 1], len(hashes) - window)
            low[1:] = np.maximum(low[1:], np.maximum.accumulate(top)[:-1] + 1)  # what an earlier range has
            n = np.maximum(top - low + 1, 0)
            starts = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
            for a in range(0, len(starts), 16 * CHUNK):
                part = starts[a : a + 16 * CHUNK]
                searched: dict[int, int] = {}
                for i, item in self.near(fingerprints(hashes, part, window), (size, size)):
                    reach = window - need
                    begin = max(int(part[i]) - reach, searched.get(item, 0))
                    end = min(int(part[i]) + reach, len(hashes) - window)
                    searched[item] = end + 1
                    found = self._exact(item, hashes, begin, end, window) if begin <= end else None
                    if found and (item not in best or (-found[0], found[1]) < (-best[item][0], best[item][1])):
                        best[item] = found
        return best

    def _exact(self, item: int, hashes: np.ndarray, begin: int, end: int, size: int) -> tuple[float, int, int] | None:
        """The first of the most similar windows that start from `begin` to `end`: (similarity, first word, words)."""
        own = slice(self.first[item], self.first[item + 1])
        bag, times, total = self.bag[own], self.times[own], int(self.size[item])
        part = hashes[begin : end + size]
        where = np.searchsorted(bag, part)
        where[where == len(bag)] = 0
        known = bag[where] == part
        count = np.concatenate([[0], np.cumsum(known)])
        most = count[size:] - count[: len(count) - size]  # shingles that the item has: no overlap is larger
        best = None
        for o in np.flatnonzero(most >= _least(total, size)).tolist():
            kind, n = np.unique(where[o : o + size][known[o : o + size]], return_counts=True)
            both = int(np.minimum(n, times[kind]).sum())
            if both >= SIMILARITY * (total + size - both):
                found = (both / (total + size - both), begin + o, size + WORDS - 1)
                if best is None or found[0] > best[0]:
                    best = found
        return best


def _shingled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = V.text_bytes(V.lowered(texts))
    return V.shingles(V.split_words(data, offsets, V.ALNUM), WORDS)


def _indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The indexes of the blocks of the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    place = F.xxhash64("item_id", "text")
    k = 1
    while True:
        sizes = items.groupBy(F.pmod(place, F.lit(k)).alias("block")).agg(F.sum(F.octet_length("text")).alias("size"), F.countDistinct(place).alias("n"))
        large = sizes.where((F.col("size") > BLOCK_BYTES) & (F.col("n") > 1)).agg(F.max("size")).first()[0]
        if large is None:
            break
        k *= 2 ** max(1, ceil(np.log2(large / BLOCK_BYTES)))
    for b in range(k):
        rows = [tuple(r) for r in items.where(F.pmod(place, F.lit(k)) == b).collect()]  # of a size that was checked
        if rows:
            yield Index(rows)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words of every item that leaks into a document."""
    spark = docs.sparkSession
    tune(spark)
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def finder(index: Index) -> Callable:
        held = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(held.value.find(batch.column("text")))
                if found:
                    at, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *(pa.array(v, f.type) for v, f in zip(rest, list(kind)[1:], strict=True))], schema=kind)

        return find

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = spark.createDataFrame([], schema)
    for n, index in enumerate(_indexes(benchmark)):
        part = texts.mapInArrow(finder(index), schema)
        out = part if n == 0 else out.unionByName(part)
    return out


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` into which no item leaks, with all their columns."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def cleaner(index: Index) -> Callable:
        held = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[i for i, *_ in held.value.find(batch.column(at))]] = False
                yield batch.filter(pa.array(good))

        return clean

    for index in _indexes(benchmark):
        docs = docs.mapInArrow(cleaner(index), docs.schema)
    return docs


def sql(docs: str = "documents", benchmark: str = "benchmark") -> str:
    """The same rows in DuckDB, from all windows that hold enough of an item's shingles. Ids are not null and do not repeat."""
    words = "regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
    cut = f"CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END"
    return f"""
WITH ds AS (SELECT doc_id, {cut} AS s FROM (SELECT doc_id, {words} AS w FROM {docs}) WHERE len(w) > 0),
bs AS (SELECT item_id, {cut} AS s FROM (SELECT item_id, {words} AS w FROM {benchmark}) WHERE len(w) > 0),
dp AS MATERIALIZED (SELECT doc_id, unnest(s) AS h, generate_subscripts(s, 1) AS p FROM ds),
bn AS MATERIALIZED (SELECT item_id, h, count(*) AS n FROM (SELECT item_id, unnest(s) AS h FROM bs) GROUP BY ALL),
cand AS (SELECT doc_id, item_id, len(any_value(bs.s)) AS item, least(len(any_value(bs.s)), len(any_value(ds.s))) AS size, len(any_value(ds.s)) AS total FROM dp JOIN bn USING (h) JOIN ds USING (doc_id) JOIN bs USING (item_id)
  GROUP BY doc_id, item_id HAVING count(*) >= {SIMILARITY} * len(any_value(bs.s)) - 1e-9),
hit AS MATERIALIZED (SELECT doc_id, item_id, item, size, total, p, h, n FROM cand JOIN bn USING (item_id) JOIN dp USING (doc_id, h)),
wind AS (SELECT *, unnest(range(greatest(1, p - size + 1), least(p, total - size + 1) + 1)) AS o FROM hit),
held AS (SELECT doc_id, item_id, item, size, o, least(any_value(n), count(*)) AS n FROM wind GROUP BY doc_id, item_id, item, size, o, h),
sim AS (SELECT doc_id, item_id, size, o, sum(n) AS n, sum(n) / (item + size - sum(n)) AS similarity FROM held GROUP BY doc_id, item_id, item, size, o HAVING sum(n) >= {SIMILARITY} * (item + size - sum(n)))
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_min(o, (-similarity, o)) - 1 AS BIGINT) AS first_word, CAST(any_value(size) + {WORDS - 1} AS BIGINT) AS n_words FROM sim GROUP BY doc_id, item_id
"""
