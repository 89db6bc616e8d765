"""Language identification by rank-order n-gram profiles.

A profile lists the 300 most frequent letter n-grams (1 to 3 letters, words
padded with one blank each side) of a language or a document, by falling count
and then by code points. A document is of the language with the least
out-of-place distance: the sum, over the n-grams of its own profile, of how far
each is from its rank in the language's profile, or 300 where it is missing.

Profiles are learned from about `SAMPLE` documents a language at most: documents
with a language are taken by a hash of their doc_id, with the probability that
gives so many. Documents whose crc32(doc_id as text) mod 5 is 0 are held out.
Prediction reads the text alone, whole, in one pass.

Cases: a null text, or one without a letter, is `und` with score 0, as is every
text if nothing could be learned; of equally distant languages the first by
name wins; a null doc_id counts as the empty text and so as held out; repeated
rows give repeated rows; extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.llm import vectext as V
from quadloom.llm.duck import CRC_TABLE, crc32
from quadloom.llm.scratch import tune

TOP = 300
#: Documents a language from which profiles are learned, in expectation; languages that are told apart at most.
SAMPLE, MAX_LANGS = 2000, 1000
UNKNOWN = "und"
_BLANK = 32
_kinds: list[np.ndarray] = []


def _kind() -> np.ndarray:
    """For each code point: 2 a letter, 1 a mark, else 0."""
    if not _kinds:
        _kinds.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8))
    return _kinds[0]


def grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of the texts: (first row, rows, whether each has a letter, then of each distinct n-gram: text, code, count), sorted by text and code."""
    lower = V.lowered(texts)
    for a, b in V.pieces(texts, V.PIECE // 2):
        held = [x or "" for x in lower.slice(a, b - a).to_pylist()]
        if b - a > 1 or len(held[0]) <= V.PIECE:
            for x, n, *found in _counted(held):
                yield a + x, n, *found
            continue
        lettered, codes, counts = np.zeros(1, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in _parts(held[0]):  # a long text: counts of its parts
            for _, _, some, _, code, count in _counted([part]):
                lettered |= some
                codes, at = np.unique(np.concatenate([codes, code]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, count]), minlength=len(codes)).astype(np.int64)
        yield a, 1, lettered, np.zeros(len(codes), np.int64), codes, counts


def _parts(text: str) -> Iterator[str]:
    """Parts of about V.PIECE characters that end after a character that is no letter or mark."""
    at = 0
    while at < len(text):
        to = at + V.PIECE
        while to < len(text) and unicodedata.category(text[to - 1])[0] in "LM":
            to += 1
        yield text[at:to]
        at = to


def _counted(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What `grams` gives, of lower-case texts."""
    todo = [(0, len(texts))]
    while todo:
        a, b = todo.pop()
        n, held = b - a, texts[a:b]
        points = np.frombuffer((" " + "".join(x + " " for x in held)).encode("utf-32-le", "surrogatepass"), np.uint32)
        own = np.repeat(np.arange(n), [len(x) + 1 for x in held])
        own = np.concatenate([[0], own])
        kind = _kind()[points]
        lettered = np.bincount(own, weights=kind == 2, minlength=n) > 0
        inside = kind > 0
        stay = inside.copy()
        stay[0] = True
        stay[1:] |= inside[:-1]
        points, inside, own = points[stay], inside[stay], own[stay]
        letters, small = np.unique(np.where(inside, points, _BLANK), return_inverse=True)
        width = max(1, int(len(letters)).bit_length())
        if 3 * width + int(n).bit_length() > 63 and n > 1:
            todo += [(a + n // 2, b), (a, a + n // 2)]
            continue
        code = small.astype(np.uint64) + np.uint64(1)
        w = np.uint64(width)
        base = own.astype(np.uint64) << np.uint64(3 * width)
        if 3 * width + int(n).bit_length() > 64:
            base = np.zeros_like(base)
        full = [np.flatnonzero(inside)]
        parts = [base[full[0]] | code[full[0]] << w << w]
        parts.append(base[1:] | code[:-1] << w << w | code[1:] << w)
        mid = np.flatnonzero(inside[1:-1]) + 1
        parts.append(base[mid + 1] | code[mid - 1] << w << w | code[mid] << w | code[mid + 1])
        keys = np.concatenate(parts)
        keys.sort()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        keys, count = keys[at], np.diff(np.append(at, len(keys)))
        mask = np.uint64((1 << width) - 1)
        whole = np.concatenate([np.zeros(1, np.uint64), letters.astype(np.uint64)])
        out = np.zeros(len(keys), np.uint64)
        for j in range(3):
            out |= whole[(keys >> np.uint64(width * (2 - j)) & mask).astype(np.int64)] << np.uint64(21 * (2 - j))
        yield a, n, lettered, (keys >> np.uint64(3 * width)).astype(np.int64), out.view(np.int64), count


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, which = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
        for a, n, _, doc, code, count in grams(batch.column("text")):
            own = which[a : a + n][doc]
            order = np.lexsort((code, own))
            own, code, count = own[order], code[order], count[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (code[1:] != code[:-1])
            at = np.flatnonzero(new)
            if len(at):
                yield pa.RecordBatch.from_pydict({"lang": pa.array(langs[own[at]], pa.string()), "gram": code[at], "n": np.add.reduceat(count, at).astype(np.int64)})


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _draw() -> Column:
    """A number in [0, 1) from the doc_id."""
    digest = F.md5(F.concat(F.lit("learn|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list[int]]:
    """The n-grams of each language's profile, most frequent first."""
    tune(docs.sparkSession)
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string"))
    sizes = known.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return {}
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in sizes], "lang string, share double")
    drawn = known.join(F.broadcast(share), "lang").where(_draw() < F.col("share")).select("lang", "text")
    total = drawn.mapInArrow(_train, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the top of each of 16 parts first, so that no task holds all n-grams of a language
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(16))).orderBy(F.desc("n"), "gram"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = total.withColumn("r", part).where(F.col("r") <= TOP).withColumn("r", rank).where(F.col("r") <= TOP)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["r"])):  # at most MAX_LANGS * TOP rows
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Model:
    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, scores
        for a, n, lettered, doc, code, count in grams(texts):
            order = np.lexsort((-count, doc))  # stable: ties stay in the order of their codes
            first = np.searchsorted(doc, np.arange(n + 1))
            rank = np.arange(len(doc)) - first[doc]
            top = rank < TOP
            d, g, r = doc[order][top], code[order][top], rank[top]
            at = np.searchsorted(self.grams, g)
            at[at == len(self.grams)] = 0
            at[self.grams[at] != g] = len(self.grams)
            known = self.ranks[at]
            far = np.where(known < 0, TOP, np.abs(known - r[:, None]))
            starts = np.searchsorted(d, np.arange(n))
            size = np.bincount(d, minlength=n)
            for i in np.flatnonzero(lettered & (size > 0)):
                dist = far[starts[i] : starts[i] + size[i]].sum(axis=0)
                k = int(np.argmin(dist))
                names[a + i] = self.langs[k]
                scores[a + i] = 1 - dist[k] / (size[i] * TOP)
        return names, scores


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. profiles: of at most MAX_LANGS languages."""
    tune(docs.sparkSession)
    built: list[Model] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = built[0] if built else Model(profiles)
        for batch in batches:
            names, scores = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(names, pa.string()), "score": scores})

    read = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return read.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs))


def sql() -> str:
    """The same rows in DuckDB. doc_ids do not repeat."""
    gram = "list_concat(list_transform(range(2, length(w) + 2), lambda i: substr(x, i, 1)), list_transform(range(1, length(w) + 2), lambda i: substr(x, i, 2)), list_transform(range(1, length(w) + 1), lambda i: substr(x, i, 3)))"
    return f"""
WITH {CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, lang, text IS NOT NULL AS told, lower(coalesce(text, '')) AS t, {crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 0 AS held_out FROM documents, tab),
w AS (SELECT doc_id, w, ' ' || w || ' ' AS x FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]+')) AS w FROM d)),
g AS MATERIALIZED (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest({gram}) AS g FROM w) GROUP BY ALL),
known AS (SELECT doc_id, lang, least(1.0, {SAMPLE} / count(*) OVER (PARTITION BY lang)) AS share FROM d WHERE NOT held_out AND lang IS NOT NULL AND told),
drawn AS (SELECT doc_id, lang FROM known WHERE CAST('0x' || substr(md5('learn|' || doc_id), 1, 8) AS BIGINT) / {1 << 32}.0 < share),
profile AS MATERIALIZED (SELECT lang, g, r FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS r FROM g JOIN drawn USING (doc_id) GROUP BY lang, g) WHERE r < {TOP}),
own AS MATERIALIZED (SELECT doc_id, g, r FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS r FROM g) WHERE r < {TOP}),
size AS (SELECT doc_id, count(*) AS n FROM own GROUP BY doc_id),
near AS (SELECT doc_id, lang, sum({TOP} - abs(own.r - profile.r)) AS near FROM own JOIN profile USING (g) GROUP BY ALL),
far AS (SELECT s.doc_id, l.lang, s.n, {TOP} * s.n - coalesce(near, 0) AS far FROM size AS s CROSS JOIN (SELECT DISTINCT lang FROM profile) AS l LEFT JOIN near ON near.doc_id = s.doc_id AND near.lang = l.lang),
best AS (SELECT doc_id, arg_min(lang, (far, lang)) AS lang, 1 - min(far) / (any_value(n) * {TOP}) AS score FROM far GROUP BY doc_id)
SELECT d.doc_id, held_out, CASE WHEN regexp_matches(t, '\\p{{L}}') THEN coalesce(best.lang, '{UNKNOWN}') ELSE '{UNKNOWN}' END AS lang_pred,
  CASE WHEN regexp_matches(t, '\\p{{L}}') THEN coalesce(CAST(score AS DOUBLE), 0) ELSE 0 END AS score FROM d LEFT JOIN best ON best.doc_id = d.doc_id
"""
