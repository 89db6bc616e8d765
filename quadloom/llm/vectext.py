"""Words, shingles and their hashes for a whole Arrow batch at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    #: Multipliers of the first, second ... word of a shingle.
    PLACE = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _table(pattern) -> np.ndarray:
    return np.array([bool(pattern(b)) for b in range(256)])


#: Anything but space and the controls tab to carriage return.
SOLID = _table(lambda b: b != 0x20 and not 9 <= b <= 13)
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = _table(lambda b: chr(b).isalnum() if b < 128 else True)


class Words:
    """The words of some texts: `doc` (index of the text), byte `start` and `end`, `hash`; `first[i]` to `first[i + 1]` are those of text i."""

    def __init__(self, doc, start, end, hashes, n_docs):
        self.doc, self.start, self.end, self.hash = doc, start, end, hashes
        self.first = np.searchsorted(doc, np.arange(n_docs + 1))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n + 1 offsets; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `size` bytes of text, or one row."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = lengths[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(lengths, base + size, side="right")))
        yield at, to
        at = to


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """Maximal runs of the bytes in `table` within each text. cuts: positions at which a run is cut in addition."""
    size, edges = len(data), offsets[1:-1]
    edges = np.unique(edges[(edges > 0) & (edges < size)])
    if cuts is not None:
        edges = np.union1d(edges, cuts)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in range(0, size, 4 * PIECE):  # memory for a long text is that of its words
        y = min(x + 4 * PIECE, size)
        inside = np.zeros(y - x + 2, bool)
        low, top = max(x - 1, 0), min(y + 1, size)
        inside[low - x + 1 : top - x + 1] = table[data[low:top]]
        here = inside[1:-1]
        begins, stops = here & ~inside[:-2], here & ~inside[2:]
        first = edges[np.searchsorted(edges, x) : np.searchsorted(edges, y)] - x
        last = edges[np.searchsorted(edges, x + 1) : np.searchsorted(edges, y + 1)] - 1 - x
        begins[first] = here[first]
        stops[last] = here[last]
        starts.append(np.flatnonzero(begins) + x)
        ends.append(np.flatnonzero(stops) + x + 1)
    start, end = np.concatenate(starts), np.concatenate(ends)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(doc, start, end, _hashes(data, start, end), len(offsets) - 1)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of data[start:end] for each pair, by prefix sums over pieces that end where a word does."""
    out, at, piece = np.empty(len(start), np.uint64), 0, PIECE
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + piece, side="right")))
        base, top = int(start[at]), int(end[to - 1])
        if top - base > piece:  # one long word
            up, total = _power(piece)[0], 0
            for x in range(base, top, piece):
                part = _BYTE[data[x : min(x + piece, top)]]
                total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, x - base, 1 << 64)
            out[at] = mix(np.array([total + (top - base) * int(_ODD) & (1 << 64) - 1], np.uint64))[0]
        else:
            up, down = _power(top - base + 1)
            sums = np.zeros(top - base + 1, np.uint64)
            np.cumsum(_BYTE[data[base:top]] * up[: top - base], out=sums[1:])
            a, b = start[at:to] - base, end[at:to] - base
            out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _ODD)
        at = to
    return out


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of its first word, hash) of every run of k words within one text."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(n, np.uint64)
    for j in range(k):
        sums += words.hash[j : j + n] * PLACE[j]
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    return at, mix(sums[at])


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of k words, in order; a text of 1 to k - 1 words has one shingle of them all."""
    at, hashes = windows(words, k)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = words.counts[short] > j
            extra[has] += words.hash[words.first[short[has]] + j] * PLACE[j]
        doc = np.concatenate([doc, short])
        hashes = np.concatenate([hashes, mix(extra + np.uint64(1))])
        order = np.argsort(doc, kind="stable")
        doc, hashes = doc[order], hashes[order]
    return doc, hashes


def counted(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash), sorted, and how often each occurs."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))
