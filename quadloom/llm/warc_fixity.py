"""Fixity audit of WARC replicas by Merkle trees.

Pages become WARC records in segments; a segment's manifest gives each record's
offset and length. A tree over a replica has the records' SHA-256 hashes as
leaves; a node hashes up to 16 children in offset order with the offset range
they cover, up to one root for all segments. Each replica has its own records and
offsets; a record of the second has the number of the first's record of the same
page and URL (one of the same bytes, if there is), and one without has a number
after the segment's. Replicas are compared from the root down, and only children
of nodes that differ are read, until the records are found that are corrupt,
missing, extra, or shifted: the same bytes at another offset. Each level, and what
differs there, is a table, so plans do not grow with the levels.

`write` puts a segment into one WARC file, `read` gives back the records of such files
with their offsets, and `compare_files` audits two folders of them.

Cases: a null html is empty; a null or empty URL has no header; line ends in a URL
are percent-encoded; a null page_id is the text `null`; records
of repeated pages stand beside each other; extra columns are not read; an empty
table has no records. A WARC file that ends within a record fails its read, unless it is to
be audited: then the record is as long as its file has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.llm.scratch import Scratch, tune

#: Records of a segment, on average, and children of a node (16 = 2 ** FAN_BITS).
SEGMENT, FAN_BITS = 4096, 4
#: WARC-Date of records whose pages have no date of their own.
DATE = "1970-01-01T00:00:00Z"


def _text(name: str, null: str = "") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(null))


def _record(html: Column) -> Column:
    """The bytes of a record but for the two line ends after it: header block, blank line, payload."""
    url = F.replace(F.replace(_text("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), _text("page_id", "null"), F.lit(f">\r\nWARC-Date: {DATE}\r\n"),
        F.when(url == "", "").otherwise(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n"))),
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html,
    )


def _name() -> Column:
    return F.md5(F.concat(_text("page_id", "null"), F.lit(":"), _text("url")))


def warc(pages: DataFrame) -> DataFrame:
    """page_id, name (a hash of it and the URL, which deals pages to segments) and the record of each page."""
    return pages.select(F.col("page_id").cast("long"), _name().alias("name"), F.concat(_record(_text("html")), F.lit("\r\n\r\n")).alias("record"))


def _segments(n: int) -> int:
    return max(1, -(-n // SEGMENT))


def _segment(segments: int) -> Column:
    return F.pmod(F.conv(F.substring("name", 1, 8), 16, 10).cast("long"), F.lit(segments))


def manifest(pages: DataFrame, segments: int) -> DataFrame:
    """segment, record number, offset, length, digest, page_id and name of each page's record."""
    rows = warc(pages).select("page_id", "name", _segment(segments).alias("segment"), F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"))
    order = Window.partitionBy("segment").orderBy("page_id", "digest")
    return rows.select(
        "segment", (F.row_number().over(order) - 1).cast("long").alias("record"),
        F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), "length", "digest", "page_id", "name",
    )


def write(pages: DataFrame, path: str, segments: int | None = None) -> None:
    """WARC files, one a segment, in folders `segment=<n>`; the records are in the manifest's order."""
    segments = segments or _segments(pages.count())
    rows = pages.select(F.col("page_id").cast("long"), _name().alias("name"), _record(_text("html")).alias("value"))
    digest = F.sha2(F.concat("value", F.lit("\r\n\r\n")).cast("binary"), 256)
    dealt = rows.withColumn("segment", _segment(segments)).withColumn("digest", digest).repartition("segment").sortWithinPartitions("segment", "page_id", "digest")
    dealt.select("segment", "value").write.mode("overwrite").partitionBy("segment").option("lineSep", "\r\n\r\n").text(path)


_FILE = "segment long, record long, offset long, length long, page_id long, url string, payload binary, digest string"


def records(data: bytes, whole: bool = True) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers by lower-case name, payload) of the records of a WARC file. whole: a record that is cut off is an error."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or head < 0:
            if whole:
                raise ValueError(f"no WARC record at byte {at}")
            yield at, len(data) - at, {}, data[at:]
            return
        lines = data[at:head].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = headers.get("content-length", "")
        end = head + 4 + int(size if size.isdigit() else len(data)) + 4
        if end > len(data) or data[end - 4 : end] != b"\r\n\r\n":
            if whole:
                raise ValueError(f"the WARC record at byte {at} has no end")
            after = data.find(b"\r\n\r\nWARC/", at)  # the next record, whatever the damage
            end = after + 4 if after >= 0 else len(data)
        yield at, end - at, headers, data[head + 4 : end - 4]
        at = end


def read(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """segment, record, offset, length, page_id, url, payload and digest of the records of WARC files that `write` has written. A file must fit a task."""
    import hashlib

    tune(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in _FILE.split(", "))])
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                segment = int(file.rpartition("segment=")[2].partition("/")[0])
                rows = []
                for n, (offset, length, headers, payload) in enumerate(records(data, whole)):
                    page = headers.get("warc-record-id", "").removeprefix("<urn:page:").removesuffix(">")
                    known = int(page) if page.removeprefix("-").isdigit() else None
                    rows.append((segment, n, offset, length, known, headers.get("warc-target-uri"), payload, hashlib.sha256(data[offset : offset + length]).hexdigest()))
                for k in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 1000], strict=True), kind, strict=True)], schema=kind)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(parse, _FILE)


def numbered(other: DataFrame, book: DataFrame) -> DataFrame:
    """The second replica's manifest with the record numbers of the first's: of a record of the same name and bytes, else of the same name, else after the segment's last."""

    def rank(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("record")))

    same, named = ["segment", "name", "digest"], ["segment", "name"]
    a, b = (rank(rows, *same) for rows in (book, other))
    equal = b.join(a.select(*same, "k", F.col("record").alias("at")), [*same, "k"], "left").drop("k")
    left = rank(a.join(b.select(*same, "k"), [*same, "k"], "left_anti"), *named)
    unlike = rank(equal.where("at IS NULL").drop("at"), *named).join(left.select(*named, "k", F.col("record").alias("at")), [*named, "k"], "left").drop("k")
    last = book.groupBy("segment").agg(F.count("*").alias("n"))
    extra = unlike.where("at IS NULL").drop("at").join(last, "segment", "left")
    after = F.coalesce("n", F.lit(0)) + F.row_number().over(Window.partitionBy("segment").orderBy("record")) - 1
    held = equal.where("at IS NOT NULL").unionByName(unlike.where("at IS NOT NULL")).unionByName(extra.withColumn("at", after).drop("n"))
    return held.drop("record").withColumnRenamed("at", "record")


def _levels(n: int) -> int:
    """Levels above n nodes until there is one."""
    return -(-max(0, n - 1).bit_length() // FAN_BITS)


def tree(leaves: DataFrame, work: Scratch, name: str) -> tuple[list[DataFrame], int]:
    """Levels of a tree, leaves first, and how many of them are within segments.

    Rows are (replica, segment, node, first, last, digest), from (replica, segment, record, offset, length, digest). Nodes are
    numbered by position, so a missing record leaves its place empty; above a segment's one node, segments are joined in the same way.
    """
    held = leaves.select("replica", "segment", F.col("record").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"), "digest")
    levels = [work.write(f"{name}-0", held)]
    most = levels[0].agg(F.max("node"), F.max("segment")).first()
    inner, outer = (_levels(0 if n is None else n + 1) for n in most)
    for k in range(inner + outer):
        segment, node = _up(k, inner)
        child = F.struct("segment", "node", "digest", "first", "last")
        up = levels[-1].groupBy("replica", segment.alias("s"), node.alias("n")).agg(F.array_sort(F.collect_list(child)).alias("c"), F.min("first").alias("first"), F.max("last").alias("last"))  # at most 16 in a list
        text = F.array_join(F.transform("c", lambda c: F.concat_ws(":", c["segment"], c["node"], c["digest"], c["first"], c["last"])), ";")
        levels.append(work.write(f"{name}-{k + 1}", up.select("replica", F.col("s").alias("segment"), F.col("n").alias("node"), "first", "last", F.sha2(text.cast("binary"), 256).alias("digest"))))
    return levels, inner


def _up(level: int, inner: int) -> tuple[Column, Column]:
    """(segment, node) of the parent of a node of a level."""
    return (F.col("segment"), F.shiftright("node", FAN_BITS)) if level < inner else (F.shiftright("segment", FAN_BITS), F.col("node"))


def audit(levels: list[DataFrame], inner: int, a: str, b: str, work: Scratch) -> DataFrame:
    """segment, record, status of the records in which replica b differs from a: corrupt, missing, extra or shifted. Descends from the root through nodes that differ."""

    def differ(level: DataFrame) -> DataFrame:
        of = lambda r, c: F.max(F.when(F.col("replica") == r, c))
        span = F.struct("first", "last")
        both = level.groupBy("segment", "node").agg(of(a, F.col("digest")).alias("da"), of(b, F.col("digest")).alias("db"), of(a, span).alias("ra"), of(b, span).alias("rb"))
        status = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").when(F.col("da") != F.col("db"), "corrupt").otherwise("shifted")
        return both.where(~F.col("da").eqNullSafe(F.col("db")) | ~F.col("ra").eqNullSafe(F.col("rb"))).select("segment", "node", status.alias("status"))

    bad = work.write(f"bad-{len(levels) - 1}", differ(levels[-1]))
    for k in range(len(levels) - 2, -1, -1):
        segment, node = _up(k, inner)
        upper = bad.select(F.col("segment").alias("s"), F.col("node").alias("n"))
        below = levels[k].withColumn("s", segment).withColumn("n", node).join(upper, ["s", "n"], "left_semi")
        bad = work.write(f"bad-{k}", differ(below))
    return bad.withColumnRenamed("node", "record")


def _audited(book: DataFrame, other: DataFrame, work: Scratch) -> DataFrame:
    """All rows of the first replica's manifest and the extra ones of the second's, with their status."""
    other = work.write("numbered", numbered(other, book))
    both = [rows.select(F.lit(r).alias("replica"), "segment", "record", "offset", "length", "digest") for r, rows in (("a", book), ("b", other))]
    levels, inner = tree(both[0].unionByName(both[1]), work, "level")
    bad = audit(levels, inner, "a", "b", work)
    out = book.join(bad, ["segment", "record"], "left").unionByName(other.join(bad.where("status = 'extra'"), ["segment", "record"]))
    return out.select("page_id", "segment", "record", F.col("offset").alias("start"), "length", "digest", F.coalesce("status", F.lit("ok")).alias("status"))


def compare_files(spark: SparkSession, path: str, replica: str) -> DataFrame:
    """The audit of two folders of WARC files. Records are the same if page and URL are, so damage to these makes one missing and one extra."""
    work = Scratch(spark, "warc-files")
    of = lambda p: read(spark, p, whole=False).withColumn("name", _name()).select("segment", "record", "offset", "length", "digest", "page_id", "name")
    return _audited(work.write("manifest", of(path)), work.write("other", of(replica)), work)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica for the query: of every 256 pages about one has its first character changed, one is blank, and one is lost."""
    kind = F.substring(F.md5(F.concat(F.lit("damage:"), _text("page_id", "null"))), 1, 2)
    html = _text("html")
    changed = F.concat(F.when(html.startswith("#"), "%").otherwise("#"), F.expr("substring(coalesce(cast(html AS string), ''), 2)"))
    return pages.where(kind != "02").withColumn("html", F.when((kind == "00") & (html != ""), changed).when(kind == "01", F.expr("repeat(' ', length(coalesce(cast(html AS string), '')))")).otherwise(html))


def compare(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, segment, record, start, length, digest and status of every record of the first replica, and of the second's extra ones."""
    work = Scratch(pages.sparkSession, "warc")
    segments = _segments(pages.count())
    book = work.write("manifest", manifest(pages.select("page_id", "url", "html"), segments))
    return _audited(book, work.write("other", manifest(replica.select("page_id", "url", "html"), segments)), work)


def query(pages: DataFrame) -> DataFrame:
    """The records of the first replica, audited against a damaged one. A record that is shifted there by the loss of others is whole: `ok`."""
    pages = pages.select("page_id", "url", "html")
    return compare(pages, damaged(pages)).withColumn("status", F.when(F.col("status") == "shifted", "ok").otherwise(F.col("status")))


_END = "chr(13) || chr(10)"
SQL = f"""
WITH n AS (SELECT greatest(1, (count(*) + {SEGMENT - 1}) // {SEGMENT}) AS k FROM pages),
p AS (SELECT page_id, coalesce(CAST(page_id AS VARCHAR), 'null') AS i, coalesce(url, '') AS u, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS e, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, i, h, CAST('0x' || substr(md5(i || ':' || u), 1, 8) AS BIGINT) % k AS segment, 'WARC/1.0' || {_END} || 'WARC-Type: resource' || {_END} || 'WARC-Record-ID: <urn:page:' || i || '>' || {_END} || 'WARC-Date: {DATE}' || {_END}
  || CASE WHEN e = '' THEN '' ELSE 'WARC-Target-URI: ' || e || {_END} END || 'Content-Type: text/html' || {_END} || 'Content-Length: ' || strlen(h) || {_END} || {_END} || h || {_END} || {_END} AS rec FROM p, n),
s AS (SELECT page_id, segment, strlen(rec) AS length, sha256(rec) AS digest, substr(md5('damage:' || i), 1, 2) AS kind, h FROM r)
SELECT page_id, CAST(segment AS BIGINT) AS segment, row_number() OVER w - 1 AS record, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length AS BIGINT) AS length, digest,
  CASE WHEN kind = '02' THEN 'missing' WHEN kind IN ('00', '01') AND h <> '' THEN 'corrupt' ELSE 'ok' END AS status
FROM s WINDOW w AS (PARTITION BY segment ORDER BY page_id, digest)
"""
