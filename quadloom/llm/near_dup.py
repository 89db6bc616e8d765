"""Near-duplicates by BagMinHash signatures, bands and exact verification.

A document is the bag (multiset) of its five-word shingles; two documents are
linked when the weighted Jaccard similarity of their bags, sum of minima over
sum of maxima, is 0.8 or more. Words are maximal runs of ASCII letters, digits
and characters beyond ASCII, lower-cased; a text of one to four words has one
shingle. Classes are the connected components of all links.

1. Signatures. A shingle of weight w owns Poisson processes over the dyadic
   weight ranges (0, 1], (1, 2], (2, 4] ... that reach w. A point of a range has
   a time, a signature slot, and a unit cell that successive halvings of the
   range pick; it counts if its cell lies below w. The least time of a slot is
   the same in two documents with probability equal to their weighted Jaccard
   similarity. Points are drawn up to a time limit for each text, and the
   limit is doubled where slots stay empty, so work is m log m a text and not
   m a shingle.
2. Equal bags are one representative, named by a 128-bit key of the bag.
3. Bands. In each bucket each member is paired with the nearest by signature,
   in runs whose first members are dealt and paired again, so a bucket of any
   size has no task of its own. These pairs are verified.
4. Buckets that still hold more than one component are searched whole, in
   blocks: the members outside the bucket's largest component against all
   others. Signatures are compared in memory, then 16-bit hashes of all
   shingles, whose overlap is never less than the true one; pairs that may
   reach the threshold go to verification. No pair is dropped for the size of
   a bucket.
5. Components by contraction: nodes take their least neighbour, edges between
   what they took go on.

Cases: a row with a null doc_id has a null class and takes no part. A null
text, or one without words, is a class of its own. The class of a row that
repeats a doc_id is that of its own text; repeated rows give repeated rows.
Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm import vectext as V
from quadloom.llm.scratch import Scratch, tune

WORDS = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 24
SLOTS = ROWS * BANDS
#: Pairs of signatures that agree in a smaller share of slots are not verified: four standard deviations below 0.8.
SCREEN = 0.65
#: Members of a block of a bucket, and of the nearest members that each is compared with first.
BLOCK, NEAREST = 512, 3
#: Pairs of a first member that are verified in one place; more are dealt to several.
PER_PLACE = 64
#: Shingles whose points are drawn at once.
ELEMENTS = 1 << 20

_UNIT = 1 << 32
_FULL = np.int64(np.iinfo(np.int64).max)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """n x slots least times (int64 in units of 2**-32 of a slot's mean gap); the maximum where a text has no shingle."""
    best = np.full(n * slots, _FULL)
    mass = np.bincount(doc, weights=weights, minlength=n)
    worded = mass > 0
    limit = np.zeros(n)
    limit[worded] = (np.log(slots) + 4) * slots / mass[worded] * _UNIT
    lacks = worded
    while lacks.any():
        own = np.flatnonzero(lacks[doc])
        for a in range(0, len(own), ELEMENTS):
            part = own[a : a + ELEMENTS]
            _draw(doc[part], hashes[part], weights[part], limit, best, slots)
        lacks = worded & (best.reshape(n, slots) == _FULL).any(axis=1)
        limit[lacks] *= 2  # the points drawn before are drawn again, and then more
    return best.reshape(n, slots)


def _draw(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, limit: np.ndarray, best: np.ndarray, slots: int) -> None:
    """Put the points of the shingles' processes up to their texts' limits into `best`."""
    own, seed, low, top = [], [], [], []
    level, reach = 0, np.arange(len(doc))
    while len(reach):  # a process for each dyadic range that starts below the weight
        below = (1 << level - 1) if level else 0
        reach = reach[weights[reach] > below]
        own.append(reach)
        seed.append(V.mix(hashes[reach] + np.uint64(level * int(_STEP) & (1 << 64) - 1)))
        low.append(np.full(len(reach), below))
        top.append(np.full(len(reach), 1 << level if level else 1))
        level += 1
    own, seed, low, top = map(np.concatenate, (own, seed, low, top))
    text, most, rate = doc[own], weights[own], top - low
    clock = np.zeros(len(own), np.int64)
    drawn = np.zeros(len(own), np.int64)
    active = np.arange(len(own))
    while len(active):
        left = np.maximum(limit[text[active]] - clock[active], 0) / _UNIT * rate[active]
        take = np.ceil(left + np.sqrt(left)).astype(np.int64) + 1
        ends = np.cumsum(take)
        who = np.repeat(active, take)
        step = np.arange(ends[-1]) - np.repeat(ends - take, take) + drawn[who]
        bits = V.mix(seed[who] + step.astype(np.uint64) * _STEP)
        uniform = ((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
        gap = (-np.log(uniform) * _UNIT).astype(np.int64)
        total = np.cumsum(gap)
        before = np.concatenate([[0], total])[ends - take]
        time = (total - np.repeat(before, take)) // rate[who] + clock[who]
        more = V.mix(bits)
        good = time <= limit[text[who]]
        if (rate[who] > 1).any():
            cell = low[who] + 1 + ((more >> np.uint64(32)).astype(np.int64) & (rate[who] - 1))
            good &= cell <= most[who]
        slot = ((more & np.uint64(0xFFFFFFFF)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best, (text[who] * slots + slot)[good], time[good])
        clock[active] = time[ends - 1]
        drawn[active] += take
        active = active[clock[active] <= limit[text[active]]]


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle hash) and their counts."""
    data, offsets = V.text_bytes(V.lowered(texts))
    return V.counted(*V.shingles(V.split_words(data, offsets, V.ALNUM), WORDS))


def _summed(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    first = np.searchsorted(doc, np.arange(n + 1))
    return total[first[1:]] - total[first[:-1]]


def _keys(doc: np.ndarray, hashes: np.ndarray, times: np.ndarray, n: int) -> list[bytes]:
    """16 bytes for each text, equal for equal bags."""
    times = times.astype(np.uint64)
    both = np.stack([_summed(doc, V.mix(hashes) * times, n), _summed(doc, V.mix(hashes ^ _STEP) * times, n)], axis=1).tobytes()
    return [both[i : i + 16] for i in range(0, 16 * n, 16)]


def _bins(doc: np.ndarray, hashes: np.ndarray, times: np.ndarray, n: int) -> list[bytes]:
    """16 bits for each occurrence of each shingle: what two bags share, these share, too."""
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    small = (V.mix(np.repeat(hashes, times) + nth.astype(np.uint64) * _STEP) >> np.uint64(48)).astype(np.uint16).tobytes()
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=times, minlength=n).astype(np.int64))]) * 2
    return [small[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in V.pieces(texts, V.PIECE // 2):
            n = b - a
            doc, hashes, times = bags(texts.slice(a, n))
            value = V.mix(signatures(doc, hashes, times, n).view(np.uint64))
            rows = np.zeros((n, BANDS), np.uint64)
            for j in range(ROWS):
                rows += value[:, j::ROWS] * V.PLACE[j]
            rows = V.mix(rows + np.arange(BANDS, dtype=np.uint64) * _STEP)
            small = (value & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").slice(a, n),
                    "text_hash": batch.column("text_hash").slice(a, n),
                    "rep": pa.array(_keys(doc, hashes, times, n), pa.binary()),
                    "n_shingles": pa.array(_summed(doc, times.astype(np.uint64), n).view(np.int64)),
                    "bands": pa.FixedSizeListArray.from_arrays(pa.array(rows.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())),
                    "sig": pa.array([x.tobytes() for x in small], pa.binary()),
                }
            )


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, the key of the bag, its size, band keys, and a signature of one byte a slot."""
    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_hash().alias("text_hash")).mapInArrow(
        _sign, "doc_id long, text_hash long, rep binary, n_shingles long, bands array<long>, sig binary"
    )


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In sorted runs of (bucket, salt): each row's NEAREST rows by signature, of those that agree enough, as pairs; and the first row, if the bucket has more runs."""
    kind = pa.schema([("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("sig", pa.binary()), ("n", pa.int64())])
    held: list[tuple[bytes, bytes]] = []
    key: tuple | None = None
    found: set[tuple[bytes, bytes]] = set()
    tops: list[tuple] = []

    def close() -> None:
        if key is None:
            return
        if key[2] > 1:
            tops.append((key[0], held[0][0], None, held[0][1], key[2]))
        if len(held) < 2:
            return
        sig = np.frombuffer(b"".join(h[1] for h in held), np.uint8).reshape(len(held), -1)
        least = SCREEN * sig.shape[1]
        for x in range(len(held)):
            same = (sig == sig[x]).sum(axis=1)
            same[x] = -1
            near = np.flatnonzero(same >= least)
            if len(near) > NEAREST:
                near = near[np.argpartition(-same[near], NEAREST)[:NEAREST]]
            found.update((min(held[x][0], held[y][0]), max(held[x][0], held[y][0])) for y in near)

    def flush() -> pa.RecordBatch:
        rows = [*((None, a, b, None, None) for a, b in found if a != b), *tops]
        found.clear()
        tops.clear()
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, kind, strict=True)], schema=kind)

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("bucket", "salt", "runs", "rep", "sig")]
        for bucket, salt, runs, rep, sig in zip(*cols, strict=True):
            if (bucket, salt, runs) != key:
                close()
                held, key = [], (bucket, salt, runs)
            held.append((rep, sig))
        yield flush()
    close()
    yield flush()


def _first_pairs(shared: DataFrame, work: Scratch) -> DataFrame:
    """(a, b), a < b: for each member of a bucket the nearest whose signatures may be similar; shared: (bucket, n, rep, sig).

    A bucket is dealt to runs of about BLOCK members, and the runs' first members are dealt again, so no bucket is one task.
    """
    rows, found = shared, []
    while True:
        level = len(found)
        doubled = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BLOCK))).cast("int")
        dealt = rows.withColumn("runs", F.pow(F.lit(2.0), doubled).cast("long"))
        dealt = dealt.withColumn("salt", F.xxhash64("rep", F.lit(level)).bitwiseAND(F.col("runs") - 1))
        out = dealt.select("bucket", "salt", "rep", "sig", "runs").repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "rep").mapInArrow(_nearest, "bucket long, a binary, b binary, sig binary, n long")
        out = work.write(f"near-{level}", out)
        found.append(out.where("bucket IS NULL").select("a", "b"))
        rows = out.where("bucket IS NOT NULL").select("bucket", F.col("a").alias("rep"), "sig", "n")
        if not rows.limit(1).count():
            return reduce(DataFrame.unionByName, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        reps, texts = batch.column("rep"), batch.column("text")
        for x, y in V.pieces(texts):
            doc, hashes, times = bags(texts.slice(x, y - x))
            own = pa.array(_keys(doc, hashes, times, y - x), pa.binary())
            part = pa.RecordBatch.from_arrays([reps.slice(x, y - x).cast(pa.binary()), texts.slice(x, y - x), pa.array(_bins(doc, hashes, times, y - x), pa.binary())], names=["rep", "text", "bins"])
            yield part.filter(pc.equal(part.column("rep"), own))  # not another text with the same doc_id


def candidates(shared: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, text and bins of the representatives that share a bucket: the one time that texts are shuffled whole."""
    wanted = shared.select("rep").distinct().join(reps.select("rep", "doc_id"), "rep")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(wanted.hint("merge"), "doc_id").select("rep", "text").mapInArrow(_candidates, "rep binary, text string, bins binary")


def verify(pairs: DataFrame, texts: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(a, b, similarity) of the pairs whose bags reach the threshold; texts: (rep, text).

    Each text is sent to where its pairs' first members are. A first member is copied to as
    many places as it has pairs for, about PER_PLACE each, so no member's pairs are one task.
    """
    places = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / PER_PLACE)))).cast("int")
    firsts = work.write(f"{name}-firsts", pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", places.alias("places")))  # written, so that the join can split a member's pairs
    second = pairs.join(firsts.hint("merge"), "a").select(F.col("b").alias("rep"), "a", F.lit(1).alias("role"), F.array(F.pmod(F.xxhash64("b"), F.col("places")).cast("int")).alias("at"))
    first = firsts.select(F.col("a").alias("rep"), "a", F.lit(0).alias("role"), F.sequence(F.lit(0), F.col("places") - 1).alias("at"))
    held = texts.select("rep", "text").join(second.unionByName(first).hint("merge"), "rep")
    spread = held.select("a", "role", "rep", "text", F.explode("at").alias("salt"))
    return spread.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(_compare, "a binary, b binary, similarity double").dropDuplicates(["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lead: tuple | None = None  # place and bag of the first member at hand
    kind = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])
    for batch in batches:
        keys = list(zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(), strict=True))
        role, reps, texts = batch.column("role").to_numpy(), batch.column("rep").to_pylist(), batch.column("text")
        for x, y in V.pieces(texts):
            doc, hashes, times = bags(texts.slice(x, y - x))
            first = np.searchsorted(doc, np.arange(y - x + 1))
            size = _summed(doc, times.astype(np.uint64), y - x).astype(np.int64)
            found = []
            for i in range(y - x):
                mine, key = slice(first[i], first[i + 1]), keys[x + i]
                if role[x + i] == 0:
                    lead = (key, hashes[mine], times[mine], size[i])
                elif lead and lead[0] == key:
                    _, h, w, total = lead
                    if SIMILARITY * max(total, size[i]) > min(total, size[i]):
                        continue
                    at = np.searchsorted(h, hashes[mine])
                    at[at == len(h)] = 0
                    hit = h[at] == hashes[mine]
                    both = int(np.minimum(w[at], times[mine])[hit].sum())
                    if both >= SIMILARITY * (total + size[i] - both):
                        found.append((key[0], reps[x + i], both / (total + size[i] - both)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found, strict=True), kind, strict=True)], schema=kind)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(rep, class): one member of each connected component, for members of links.

    In each round every node takes the least of its neighbours and itself, and
    then that node's; edges between what nodes took are the next round's, so they
    and the nodes shrink by a factor, and all is joins on small keys.
    """
    names, step = None, 0
    while True:
        both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
        near = scratch.write(f"{name}-near-{step}", both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to")))
        jump = near.select(F.col("x").alias("to"), F.col("to").alias("far"))
        took = scratch.write(f"{name}-took-{step}", near.join(jump, "to", "left").select("x", F.coalesce("far", "to").alias("to")))
        if names is None:
            names = took.select(F.col("x").alias("rep"), F.col("to").alias("class"))
        else:
            names = names.join(took.select(F.col("x").alias("class"), "to"), "class", "left").select("rep", F.coalesce("to", "class").alias("class"))
        names = scratch.write(f"{name}-names-{step}", names)
        moved = edges.join(took.select(F.col("x").alias("a"), F.col("to").alias("ta")), "a").join(took.select(F.col("x").alias("b"), F.col("to").alias("tb")), "b")
        moved = moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        edges = scratch.write(f"{name}-edges-{step}", moved)
        scratch.drop(f"{name}-near-{step}", f"{name}-took-{step}", f"{name}-names-{step - 1}", f"{name}-edges-{step - 1}")
        if not edges.limit(1).count():
            return names
        step += 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in sorted runs of (bucket, i, j) whose signatures and shingles agree enough."""
    held: list[tuple] = []
    key = None
    kind = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def pairs() -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        cls = np.array([codes.setdefault(h[1], len(codes)) for h in held])
        if len(codes) < 2:
            return
        side = np.array([h[2] for h in held])
        sig = np.frombuffer(b"".join(h[3] for h in held), np.uint8).reshape(len(held), -1)
        bins = [np.frombuffer(h[4], np.uint16) for h in held]
        at, seen = np.arange(len(held)), np.zeros(1 << 16, np.int64)
        for x in np.flatnonzero(side == 0):
            others = np.flatnonzero((side == 1 if key[1] != key[2] else at > x) & (cls != cls[x]))
            near = others[(sig[others] == sig[x]).sum(axis=1) >= SCREEN * sig.shape[1]]
            if not len(near):
                continue
            seen[bins[x]] = 1
            sizes = np.array([len(bins[y]) for y in near])
            most = np.add.reduceat(seen[np.concatenate([bins[y] for y in near])], np.cumsum(sizes) - sizes)
            seen[bins[x]] = 0
            near = near[most >= SIMILARITY * (len(bins[x]) + sizes - most)]
            two = [sorted((held[x][0], held[y][0])) for y in near if held[x][0] != held[y][0]]
            if two:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in zip(*two, strict=True)], schema=kind)

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "rep", "class", "side", "sig", "bins")]
        for bucket, i, j, *row in zip(*cols, strict=True):
            if (bucket, i, j) != key:
                yield from pairs()
                held, key = [], (bucket, i, j)
            held.append(row)
    yield from pairs()


def _residue(shared: DataFrame, labels: DataFrame, bins: DataFrame, work: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and may be similar."""
    named = shared.join(labels, "rep", "left").select("bucket", "rep", F.coalesce("class", "rep").alias("class"), "sig")
    by_class = named.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    mixed = (
        by_class.groupBy("bucket")
        .agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("classes"))
        .where("classes > 1")
        .select("bucket", F.col("top.class").alias("major"), blocks(F.col("top.n")).alias("ks"), blocks(F.col("n") - F.col("top.n")).alias("ku"))
    )
    rows = work.write("mixed-rows", named.join(work.write("mixed", mixed), "bucket"))
    held = bins.join(rows.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep"])
    rows = rows.withColumn("s", F.col("class") == F.col("major")).withColumn("h", F.xxhash64("rep"))
    span = lambda k: F.sequence(F.lit(0), F.col(k) - 1)

    def cell(i: Column, j: Column, side: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    in_s, in_u = F.pmod("h", "ks"), F.pmod("h", "ku")
    minor = F.concat(
        F.transform(span("ks"), lambda o: cell(in_u, -1 - o, F.lit(0))),
        F.transform(span("ku"), lambda o: cell(F.least(in_u, o), F.greatest(in_u, o), (in_u > o))),
    )
    cells = F.when(F.col("s"), F.transform(span("ku"), lambda o: cell(o, -1 - in_s, F.lit(1)))).otherwise(minor)
    placed = rows.select("bucket", "rep", "class", "sig", F.explode(cells).alias("c")).select("bucket", "c.i", "c.j", "c.side", "rep", "class", "sig")
    placed = placed.join(held, "rep")
    return placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side").mapInArrow(_blocks, "a binary, b binary").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class, class_id, link_id and similarity of every row.

    class: a key of its class; class_id: the least doc_id there. link_id: the least doc_id of an
    equal bag, or for that document the greatest, with similarity 1; where no other has the bag, that of the most similar one to which
    a link was verified, or null. Links are verified until they make up the classes, not all within a class.
    """
    work = Scratch(docs.sparkSession, "near-dup")
    signed = work.write("signed", sign(docs))
    real = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = real.groupBy("rep").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last_id"))
    reps = work.write("reps", real.join(work.write("least", reps), ["rep", "doc_id"]).dropDuplicates(["rep"]))
    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    several = work.write("several", buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    # signatures come to the rows of shared buckets only; these joins grow with the corpus on both sides, so they always shuffle
    rows = work.write("rows", buckets.join(several.hint("merge"), "bucket"))
    shared = work.write("shared", rows.join(reps.select("rep", "sig").hint("merge"), "rep"))
    texts = work.write("texts", candidates(shared, reps, docs))
    links = work.write("links-1", verify(work.write("pairs-1", _first_pairs(shared, work)), texts, work, "pairs-1"))
    labels = work.write("labels-1", components(links, work, "cc1"))
    rest = work.write("pairs-2", _residue(shared, labels, texts.select("rep", "bins"), work))
    if rest.limit(1).count():
        more = work.write("links-2", verify(rest, texts, work, "pairs-2"))
        if more.limit(1).count():
            links = links.unionByName(more)
            labels = work.write("labels-2", components(links, work, "cc2"))
    both = links.select("a", "b", "similarity").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    most = both.groupBy(F.col("a").alias("rep")).agg(F.max(F.struct("similarity", "b")).alias("m")).select("rep", F.col("m.b").alias("other"), F.col("m.similarity").alias("similarity"))
    ids = reps.select(F.col("rep").alias("other"), F.col("doc_id").alias("link_id"))
    best = most.join(ids, "other").select("rep", "link_id", "similarity")  # few beside the documents: those with a link
    named = reps.select("rep", "doc_id", "last_id").join(labels, "rep", "left").join(best, "rep", "left").select("rep", "doc_id", "last_id", F.coalesce("class", "rep").alias("class"), "link_id", "similarity")
    named = work.write("named", named)
    ids = work.write("ids", named.groupBy("class").agg(F.min("doc_id").alias("class_id")))
    named = work.write("class-of", named.join(ids, "class").select("rep", F.col("doc_id").alias("first_id"), "last_id", "class", "class_id", "link_id", "similarity"))
    work.drop("least", "reps", "several", "shared", "mixed", "rows", "mixed-rows", "texts", "near-0", "near-1", "near-2", "near-3", "pairs-1", "pairs-2", "pairs-1-firsts", "pairs-2-firsts", "links-1", "links-2", "labels-1", "labels-2", "named", "ids")
    rows = signed.select("doc_id", "text_hash", "rep", "n_shingles")
    none = [F.lit(None).cast("binary").alias("class"), F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("link_id"), F.lit(None).cast("double").alias("similarity")]
    lone = rows.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "text_hash", *none)
    real = rows.where("doc_id IS NOT NULL AND n_shingles > 0").join(named, "rep")
    equal = F.when(F.col("doc_id") != F.col("first_id"), F.col("first_id")).when(F.col("last_id") != F.col("doc_id"), F.col("last_id"))
    link = [F.coalesce(equal, "link_id").alias("link_id"), F.when(equal.isNotNull(), 1.0).otherwise(F.col("similarity")).alias("similarity")]
    return real.select("doc_id", "text_hash", "class", "class_id", *link).unionByName(lone)


def query(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every document."""
    return classes(docs).select("doc_id", "class_id")


def keep(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns: that of the least (doc_id, hash of the text).

    Rows with a null doc_id, and those without words, all stay.
    """
    work = Scratch(docs.sparkSession, "near-dup-keep")
    rows = classes(docs)
    real = F.col("class").isNotNull()
    best = rows.where(real & (F.col("doc_id") == F.col("class_id"))).groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("m"), F.count("*").alias("n"))
    lone = rows.where(~real & F.col("doc_id").isNotNull()).select("doc_id", "text_hash", F.lit(1).alias("n")).distinct()
    stay = work.write("stay", best.select("m.doc_id", "m.text_hash", "n").unionByName(lone))
    token = f"_{work.path[-8:]}"
    mine = docs.withColumn(f"i{token}", F.col("doc_id").cast("long")).withColumn(f"t{token}", _text_hash())

    def those(which: DataFrame) -> DataFrame:
        on = which.select(F.col("doc_id").alias(f"i{token}"), F.col("text_hash").alias(f"t{token}"))
        return mine.join(on.hint("merge"), [f"i{token}", f"t{token}"], "left_semi")

    out = those(stay.where("n = 1"))
    if stay.where("n > 1").limit(1).count():  # the same doc_id and class in several rows
        out = out.unionByName(those(stay.where("n > 1")).dropDuplicates([f"i{token}", f"t{token}"]))
    return out.unionByName(mine.where(F.col("doc_id").isNull())).select(docs.columns)


def sql(docs: str = "documents") -> str:
    """The same rows in DuckDB, from all pairs of bags that share a shingle. `docs` names a relation whose doc_ids are not null and do not repeat."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {docs}),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) < {WORDS} THEN [hash(array_to_string(w, ' '))] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: hash(array_to_string(w[i:i + {WORDS - 1}], ' '))) END) AS h FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, h, count(*) AS n FROM s GROUP BY ALL),
size AS (SELECT doc_id, sum(n) AS size, md5(string_agg(h || ':' || n, ',' ORDER BY h)) AS bag FROM c GROUP BY doc_id),
rep AS (SELECT doc_id, size, min(doc_id) OVER (PARTITION BY bag) AS r FROM size),
one AS MATERIALIZED (SELECT c.* FROM c JOIN rep USING (doc_id) WHERE doc_id = r),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS n FROM one AS a JOIN one AS b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM met JOIN rep AS x ON a = x.doc_id JOIN rep AS y ON b = y.doc_id WHERE n >= {SIMILARITY} * (x.size + y.size - n) UNION ALL SELECT r, doc_id FROM rep WHERE r < doc_id),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS d, doc_id AS r FROM {docs} UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.d)
SELECT d AS doc_id, min(r) AS class_id FROM reach GROUP BY d
"""
