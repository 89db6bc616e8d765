"""Token ids in binary files: canonical, length-limited Huffman codes of the ids.

1. Documents are dealt to ranges of doc_id and sorted; each range is tokenized
   into blocks of whole documents, about `BLOCK` ids each.
2. Counts of ids over all blocks give code lengths of at most `LIMIT` bits
   (package-merge); codes are canonical, so the lengths are the code book.
3. Each block is coded on its own. Every `STRIDE` ids its bit offset is noted.
4. Reading needs the code book and one block: all strides of the block are
   decoded side by side, an id at a time, by one table look-up each.

A file set is a folder with two Parquet tables: `codebook` (id, bits) and
`blocks` (part, block, doc_ids, lengths, n_ids, offsets, payload), with blocks
in ascending doc_id order of (part, block). The payload's codes are packed from
the highest bit of its first byte.

Tokens come from the `tokenizers` library. As its pre-tokenizer never joins
text across ASCII white space, or between letters, digits and most punctuation,
distinct pieces are encoded once and remembered by a 64-bit hash in a bounded
cache of each worker.

Cases: a null or empty text has the end id alone; a null doc_id comes first;
rows that repeat a doc_id are ordered by their texts' hash; an empty table gives
an empty file set; extra columns are not read.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.llm import vectext as V
from quadloom.llm.scratch import Scratch, tune

VOCABULARY, END = "word_bpe_49k.json", 2
LIMIT, BLOCK, STRIDE = 20, 1 << 19, 256
#: Words and ids that a worker remembers before it forgets them all.
CACHE_WORDS, CACHE_IDS = 1_500_000, 12_000_000

#: Kinds of bytes: ASCII letters 1, digits 2, punctuation 3 (but for what special tokens and contractions are made of), the apostrophe 4, else 0; 5 is the end of a Latin letter beyond ASCII.
_KIND = np.array([0 if b > 126 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 4 if b == 39 else 3 if b > 32 and chr(b) not in "<|>" else 0 for b in range(256)], np.uint8)
#: Whether the pre-tokenizer splits between two kinds, whatever stands around them (index: 6 * first + second).
_SPLIT = np.zeros(36, bool)
_SPLIT[[6 * a + b for a, b in ((1, 2), (1, 3), (1, 4), (5, 2), (5, 3), (5, 4), (2, 1), (3, 1), (2, 2), (2, 3), (3, 2))]] = True
#: First bytes of the letters U+00C0 to U+027F.
_LATIN = V._table(lambda b: 0xC3 <= b <= 0xC9)


def borders(data: np.ndarray) -> np.ndarray:
    """Places within words where the pre-tokenizer splits, too."""
    kind = _KIND[data]
    first = np.flatnonzero(_LATIN[data])
    lead, tail = data[first], data[first + 1]
    odd = (lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7))  # the signs for times and divided by
    odd |= (lead == 0xC4) & (tail == 0xB0)  # a capital whose lower case ends in a mark
    kind[first[~odd] + 1] = 5
    return np.flatnonzero(_SPLIT[kind[:-1] * np.uint8(6) + kind[1:]]) + 1


#: The characters by which byte-level vocabularies name bytes: printable ones themselves, the others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: (b if b in _PRINTABLE else 256 + [x for x in range(256) if x not in _PRINTABLE].index(b)) for b in range(256)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The rules of a tokenizer for which words can be encoded one by one, and its special tokens.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SPECIAL = {"<|startoftext|>", "<|endoftext|>"}


class Encoder:
    """Ids of whole texts by the tokenizer in a file: word by word if its rules are those above, else text by text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        held = json.loads(self.tokenizer.to_str())
        self.by_words = (held["normalizer"], held["pre_tokenizer"], held["post_processor"]) == (NORMALIZER, PRE_TOKENIZER, None) and {t["content"] for t in held["added_tokens"]} <= SPECIAL
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def _learn(self, keys: list[int], words: list[str]) -> None:
        """Remember the ids of new words. Words of Latin letters are one token for the pre-tokenizer and go straight to the model."""
        rest: list[int] = []
        ids: list[list[int]] = [[]] * len(words)
        tokenize = self.model.tokenize
        for i, word in enumerate(words):
            low = word.lower()
            if low.isascii() and low.isalpha():
                ids[i] = [t.id for t in tokenize(low)]
            elif low.isalpha() and max(low) < "\u0250":
                ids[i] = [t.id for t in tokenize(low.encode().decode("latin-1").translate(_BYTE_NAMES))]
            else:
                rest.append(i)
        for i, found in zip(rest, self.tokenizer.encode_batch([words[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = found.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        n = len(self.known)
        while n + len(ids) > len(self.start):
            self.start, self.length = np.concatenate([self.start, self.start]), np.concatenate([self.length, self.length])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.length[n : n + len(ids)] = sizes
        self.used += len(flat)
        self.known.update(zip(keys, range(n, n + len(ids)), strict=True))

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For pieces of the texts: all their ids, and how many each text has."""
        for a, b in V.pieces(texts, 2 * V.PIECE):
            if not self.by_words:
                found = [x.ids for x in self.tokenizer.encode_batch([t or "" for t in texts.slice(a, b - a).to_pylist()], add_special_tokens=False)]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                yield np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes
                continue
            data, offsets = V.text_bytes(texts.slice(a, b - a))
            words = V.split_words(data, offsets, V.SOLID, borders(data) if len(data) else None)
            if len(self.known) > CACHE_WORDS or self.used > CACHE_IDS:
                self._forget()
            keys, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
            new = [i for i, k in enumerate(keys.tolist()) if k not in self.known]
            if new:
                raw = data.tobytes()
                self._learn([int(keys[i]) for i in new], [raw[words.start[at[i]] : words.end[at[i]]].decode() for i in new])
            entry = np.fromiter(map(self.known.__getitem__, keys.tolist()), np.int64, len(keys))[which]
            size = self.length[entry]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.pool[np.repeat(self.start[entry] - (ends - size), size) + np.arange(total)]
            ahead = np.concatenate([[0], ends])
            yield ids, ahead[words.first[1:]] - ahead[words.first[:-1]]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The optimal code lengths of at most `limit` bits for symbols with these counts (all above 0), by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    coins = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):  # from the deepest level up: coins and pairs of the level below, by weight
        row = np.concatenate([coins, packages])
        by = np.argsort(row, kind="stable")
        levels.append(by < n)
        row = row[by]
        even = len(row) // 2 * 2
        packages = row[:even:2] + row[1:even:2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_coin in reversed(levels):
        coined = int(is_coin[:take].sum())
        lengths[:coined] += 1
        take = 2 * (take - coined)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: by length, then by id."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = np.asarray(ids)[order].astype(np.uint32), np.asarray(bits)[order].astype(np.int64)
        self.most = int(self.bits[-1]) if len(bits) else 1
        width = np.uint64(1) << (self.most - self.bits).astype(np.uint64)
        begin = np.cumsum(width) - width if len(bits) else width
        self.code_of = np.zeros(int(self.ids.max()) + 1 if len(bits) else 1, np.uint64)
        self.bits_of = np.zeros(len(self.code_of), np.int64)
        self.code_of[self.ids] = begin >> (self.most - self.bits).astype(np.uint64)
        self.bits_of[self.ids] = self.bits
        self._width = width.astype(np.int64)
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The packed codes, and the bit offset of every STRIDE-th id."""
        bits = self.bits_of[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        words = int(ends[-1] + 31) // 32 if len(ids) else 0
        wide = self.code_of[ids] << (64 - bits - (at & 31)).astype(np.uint64)
        # the codes' bits do not overlap, so sums of 32-bit halves are exact in doubles
        high = np.bincount(at >> 5, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=words + 1)
        low = np.bincount((at >> 5) + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words + 1)
        packed = (high[: words + 1] + low[: words + 1]).astype(np.uint64).astype(">u4")[:words]
        return packed.tobytes(), at[::STRIDE].astype(np.uint32)

    def decode(self, payload: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block, its strides side by side."""
        if self._table is None:
            self._table = (np.repeat(self.ids, self._width), np.repeat(self.bits.astype(np.uint8), self._width))
        symbol, size = self._table
        words = np.concatenate([np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
        at, lanes = offsets.astype(np.int64), len(offsets)
        out = np.zeros((STRIDE, lanes), np.uint32)
        shift = np.uint64(64 - self.most)
        for step in range(min(STRIDE, n)):
            live = lanes if (lanes - 1) * STRIDE + step < n else lanes - 1
            pos = at[:live]
            w = pos >> 5
            peek = (words[w] << np.uint64(32) | words[w + 1]) << (pos & 31).astype(np.uint64) >> shift
            out[step, :live] = symbol[peek]
            at[:live] += size[peek]
        return out.T.ravel()[:n]


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        encoder = _encoder(path)
        small = np.uint16 if max(encoder.size - 1, end) < 1 << 16 else np.uint32
        docs: list = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held, counts = 0, np.zeros(max(encoder.size, end + 1), np.int64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int64()), "block": pa.array([block], pa.int64()),
                    "doc_ids": pa.array([docs], pa.list_(pa.int64())), "lengths": pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                    "wide": pa.array([small().itemsize], pa.int32()), "ids": pa.array([np.concatenate(ids).astype(small).tobytes()], pa.binary()), "counts": pa.nulls(1, pa.binary()),
                }
            )

        for batch in batches:
            at, names = 0, batch.column("doc_id").to_pylist()
            for flat, size in encoder.encode(batch.column("text")):
                ended = np.insert(flat, np.cumsum(size), end)
                docs += names[at : at + len(size)]
                at += len(size)
                sizes.append(size + 1)
                ids.append(ended.astype(np.uint32))
                counts += np.bincount(ended, minlength=len(counts))
                held += len(ended)
                if held >= BLOCK:
                    yield row()
                    docs, sizes, ids, held, block = [], [], [], 0, block + 1
        if docs:
            yield row()
        if counts.any():  # a row of its own, after the blocks
            docs, sizes, ids = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            last = row()
            yield last.set_column(last.schema.get_field_index("counts"), "counts", pa.array([counts.tobytes()], pa.binary()))

    return run


def _ids(raw: bytes, wide: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if wide == 2 else np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        for raw in batch.column("counts").to_pylist():
            n = np.frombuffer(raw, np.int64)
            total = np.concatenate([total, np.zeros(max(0, len(n) - len(total)), np.int64)])
            total[: len(n)] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": at, "n": total[at]})


def _pack(ids: np.ndarray, bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(ids, bits)
        for batch in batches:
            for i in range(batch.num_rows):
                flat = _ids(batch.column("ids")[i].as_py(), batch.column("wide")[i].as_py())
                payload, offsets = book.encode(flat)
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column("part"), one.column("block"), one.column("doc_ids"), one.column("lengths"), pa.array([len(flat)], pa.int64()), pa.array([offsets.astype(np.int64)], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                    names=["part", "block", "doc_ids", "lengths", "n_ids", "offsets", "payload"],
                )

    return run


_BLOCKS = "part long, block long, doc_ids array<long>, lengths array<long>, n_ids long, offsets array<long>, payload binary"


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Encode every whole text and write the file set at `path`."""
    spark = docs.sparkSession
    tune(spark)
    work = Scratch(spark, "tokens")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    staged = dealt.mapInArrow(_tokenize(vocabulary or vocabulary_path(), end), "part long, block long, doc_ids array<long>, lengths array<long>, wide int, ids binary, counts binary")
    staged.write.option("compression", "zstd").parquet(f"{work.path}/staged")
    staged = work.read("staged")
    counts = staged.where("counts IS NOT NULL").select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()  # at most one row for each id of the vocabulary
    ids, n = np.array([r["id"] for r in counts], np.int64), np.array([r["n"] for r in counts], np.int64)
    bits = code_lengths(n)
    book = spark.createDataFrame([(int(i), int(b)) for i, b in zip(ids, bits, strict=True)], "id long, bits int").coalesce(1)
    book.write.mode("overwrite").parquet(f"{path}/codebook")
    staged.where("counts IS NULL").drop("counts").mapInArrow(_pack(ids, bits), _BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")
    work.drop("staged")


def _unpack(ids: np.ndarray, bits: np.ndarray, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(ids, bits)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("doc_ids", "start", "n_ids", "payload")}
                sizes = np.array(batch.column("lengths")[i].values.to_numpy())
                flat = book.decode(row["payload"], batch.column("offsets")[i].values.to_numpy(), row["n_ids"]).astype("<u4")
                ends = np.cumsum(sizes)
                cut = [flat[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                out = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(row["start"] + ends - sizes), "n_tokens": pa.array(sizes)}
                if whole:
                    out["ids"] = pa.array([c.astype(np.int64) for c in cut], pa.list_(pa.int64()))
                else:
                    out["ids_crc32"] = pa.array([zlib.crc32(c) for c in cut], pa.int64())
                yield pa.RecordBatch.from_pydict(out)

    return run


def read(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, and the ids of every document; or their crc32, if not whole."""
    book = spark.read.parquet(f"{path}/codebook").orderBy("id").collect()  # at most one row for each id of the vocabulary
    ids, bits = np.array([r["id"] for r in book], np.int64), np.array([r["bits"] for r in book], np.int64)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a partition that was written
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("ahead")).join(base, "part")
    starts = starts.select("part", "block", (F.col("base") + F.col("ahead")).alias("start"))  # one row a block
    tune(spark)
    last = "ids array<long>" if whole else "ids_crc32 long"
    return blocks.join(starts, ["part", "block"]).mapInArrow(_unpack(ids, bits, whole), f"doc_id long, start long, n_tokens long, {last}")


def query(docs: DataFrame) -> DataFrame:
    path = Scratch(docs.sparkSession, "token-files").path
    write(docs, path)
    return read(docs.sparkSession, path, whole=False)
