"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger keeps the
measurements and one bit a rule; a policy is a versioned mask of rules, so
changing it, or asking what one rule alone rejects, reads the ledger and never
the texts.

Cases: a null or empty text has no words and fails `few_words`; a null doc_id
stays null; repeated rows give repeated rows; other columns are not read; an
empty table gives an empty ledger. Texts of any length are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quadloom.llm import vectext as V
from quadloom.llm.scratch import Scratch, tune

WINDOW = 5
_SYMBOL = V._table(lambda b: chr(b) in "#*$%&|<>")
_LETTER = V._table(lambda b: chr(b).isalpha() if b < 128 else True)
_LINE = V._table(lambda b: b != 10)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_loud_words"]

#: Rules in the order of their bits: name, and a test of the measurements as integers (true: the document fails).
RULES = [
    ("few_words", lambda m: m["n_words"] < 10),
    ("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ("symbols", lambda m: 100 * m["n_symbols"] > 10 * m["n_words"]),
    ("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    ("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    ("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    ("few_letters", lambda m: 100 * m["n_letter_words"] < 60 * m["n_words"]),
    ("loud_words", lambda m: 100 * m["n_loud_words"] > 30 * m["n_words"]),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: The two rules that no policy may leave out.
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versioned policies: the rules that count.
POLICIES = {"base": BASE, "v1": BASE | BIT["symbols"] | BIT["repeated_lines"], "v2": (1 << len(RULES)) - 1}
POLICY = "v2"


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text, as int64.

    n_lines: lines with a word. n_letter_words: words with a letter (any
    character beyond ASCII counts). n_loud_words: words that end in two
    exclamation marks.
    """
    out = {k: [] for k in MEASURES}
    for a, b in V.pieces(texts):
        data, offsets = V.text_bytes(texts.slice(a, b - a))
        n = b - a
        words = V.split_words(data, offsets, V.SOLID)

        def summed(flags: np.ndarray) -> np.ndarray:
            some, total = np.flatnonzero(np.diff(offsets)), np.zeros(n, np.int64)
            if len(some):
                total[some] = np.add.reduceat(flags, offsets[some], dtype=np.int64)
            return total

        def by_word(flags: np.ndarray) -> np.ndarray:
            return np.bincount(words.doc[flags], minlength=n)

        out["n_words"].append(words.counts)
        out["word_chars"].append(summed(V.SOLID[data] & ((data & 0xC0) != 0x80)))
        out["n_symbols"].append(summed(_SYMBOL[data]))
        lines = V.split_words(data, offsets, _LINE)
        worded = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
        doc, _, times = V.counted(lines.doc[worded], lines.hash[worded])
        out["n_lines"].append(np.bincount(lines.doc[worded], minlength=n))
        out["n_dup_lines"].append(np.bincount(doc, weights=times - 1, minlength=n).astype(np.int64))
        covered = np.zeros(len(words.hash) + 1, np.int64)
        at, hashes = V.windows(words, WINDOW)
        order = np.lexsort((hashes, words.doc[at]))
        h, d = hashes[order], words.doc[at][order]
        same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        hit = at[order[again]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
        out["n_repeat_words"].append(by_word(np.cumsum(covered[:-1]) > 0))
        lettered = np.logical_or.reduceat(_LETTER[data], words.start) if len(words.start) else np.zeros(0, bool)
        out["n_letter_words"].append(by_word(lettered))
        loud = (words.end - words.start >= 2) & (data[words.end - 1] == 33) & (data[words.end - 2] == 33) if len(words.end) else np.zeros(0, bool)
        out["n_loud_words"].append(by_word(loud))
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}


def fail_bits(m: dict[str, np.ndarray]) -> np.ndarray:
    bits = np.zeros(len(m["n_words"]), np.int64)
    for i, (_, fails) in enumerate(RULES):
        bits |= fails(m).astype(np.int64) << i
    return bits


def _ledger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = measure(batch.column("text"))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **m, "fail_bits": fail_bits(m)})


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and `fail_bits` of every document."""
    tune(docs.sparkSession)
    schema = ", ".join(["doc_id long", *(f"{k} long" for k in MEASURES), "fail_bits long"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_ledger, schema)


def apply_policy(book: DataFrame, version: str = POLICY) -> DataFrame:
    """The ledger with `base_failed` and `kept` under a policy."""
    bits = F.col("fail_bits")
    return book.withColumn("base_failed", bits.bitwiseAND(BASE) != 0).withColumn("kept", bits.bitwiseAND(POLICIES[version] | BASE) == 0)


def ablation(book: DataFrame, version: str = POLICY) -> DataFrame:
    """For each rule of a policy: documents it fails, and those that only it rejects (they would be kept without it)."""
    mask = POLICIES[version] | BASE
    hit = F.col("fail_bits").bitwiseAND(mask)
    counts = book.groupBy(hit.alias("bits")).agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BIT.items() if mask & bit]
    return (
        counts.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_alone"),
        )
    )


def overview(book: DataFrame) -> DataFrame:
    """One row: bits that any document fails, bits that all fail, and the sum of failed rules, by bitwise aggregation."""
    return book.agg(F.bit_or("fail_bits").alias("any_bits"), F.bit_and("fail_bits").alias("all_bits"), F.sum(F.bit_count("fail_bits")).alias("n_failures"))


def with_ledger(docs: DataFrame) -> tuple[DataFrame, str]:
    """Whole documents with their ledger in one column more, and its free name: a struct of the measurements and `fail_bits`."""
    tune(docs.sparkSession)
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("ledger", *(f"ledger_{i}" for i in range(1, len(taken) + 2))) if n not in taken)
    at, fields = docs.columns.index("text"), [*MEASURES, "fail_bits"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column(at).cast(pa.string()))
            book = pa.StructArray.from_arrays([*(pa.array(m[k]) for k in MEASURES), pa.array(fail_bits(m))], fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, book], names=[*batch.schema.names, name])

    book = StructType([StructField(f, LongType()) for f in fields])
    return docs.mapInArrow(measured, StructType([*docs.schema.fields, StructField(name, book)])), name


def keep(docs: DataFrame, version: str = POLICY) -> DataFrame:
    """The rows of `docs` that a policy keeps, with all their columns. The ledger is stored beside the documents; the policy reads its bits."""
    held, name = with_ledger(docs)
    held = Scratch(docs.sparkSession, "quality").write("ledger", held)
    return held.where(F.col(name)["fail_bits"].bitwiseAND(POLICIES[version] | BASE) == 0).select(docs.columns)


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns, then the ledger's bits."""
    book = apply_policy(ledger(docs))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


#: The same rows from the texts alone, in DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, p, array_to_string(ws[p:p+4], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS p FROM w)),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM rep) GROUP BY r),
ln AS (SELECT r, l FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln GROUP BY r),
m AS (SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
  len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS n_loud_words
  FROM w LEFT JOIN cov USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT
  + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
  + 64 * (100 * n_letter_words < 60 * n_words)::INT + 128 * (100 * n_loud_words > 30 * n_words)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
