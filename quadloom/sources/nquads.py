"""N-Quads files: read line by line in the JVM, and written as sorted or unsorted lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.literals import quad_text
from quadloom.model import terms as T
from quadloom.model.errors import LinkedDataError
from quadloom.schema import QUAD_COLUMNS

_IRI = r"<[^\x00-\x20<>\"{}|^`]*>"
_BLANK = r"_:[^\s<>\"#]*[^\s<>\"#.]"
_FRONT = rf"^[ \t]*({_IRI}|{_BLANK})[ \t]*({_IRI}|{_BLANK})[ \t]*"
_RESOURCE = rf"^({_IRI}|{_BLANK})"
_TAIL = rf"^(?:\^\^({_IRI})|@([a-zA-Z]+(?:-[a-zA-Z0-9]+)*))?[ \t]*({_IRI}|{_BLANK})?[ \t]*\.[ \t]*(?:#.*)?$"
_SKIP = r"^[ \t]*(?:#.*)?$"


def _bare(name: Column) -> Column:
    return F.when(name.startswith("<"), F.substring(name, 2, 1 << 30).substr(F.lit(1), F.length(name) - 2)).otherwise(name)


_TOKEN = r"""\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\[tbnrf"'\\]|[^\\]+|\\"""
_CHARS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescaped(text: Column) -> Column:
    """The characters that a literal's escapes stand for: the text is cut at its escapes, and each is read once."""

    def char(token: Column) -> Column:
        kind = F.substring(token, 2, 1)
        number = F.conv(F.substring(token, 3, 8), 16, 10).cast("int")
        out = F.when(~token.startswith("\\") | (F.length(token) == 1), token).when(kind.isin("u", "U"), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        for code, plain in _CHARS.items():
            out = out.when(kind == code, plain)
        return out

    return F.when(text.contains("\\"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), char), "")).otherwise(text)


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Quad rows of lines of N-Quads; empty lines and comments give none, and a line that is no quad fails the query."""
    line = F.regexp_replace(F.col(column), "\r$", "")
    front = F.regexp_extract(line, _FRONT, 0)
    rest = F.substr(line, F.length(front) + 1)
    held = lines.where(~line.rlike(_SKIP)).select(line.alias("line"), front.alias("front"), rest.alias("rest"))
    # the first quote that no escape stands for ends a literal; no pattern runs over its text, which may be long
    masked = F.replace(F.replace(F.col("rest"), F.lit("\\\\"), F.lit("\x00\x00")), F.lit('\\"'), F.lit("\x00\x01"))
    end = F.when(F.col("rest").startswith('"'), F.locate('"', masked, 2)).otherwise(F.length(F.regexp_extract("rest", _RESOURCE, 0)))
    held = held.withColumn("end", end).withColumn("tail", F.substr("rest", F.col("end") + 1))
    literal = F.col("rest").startswith('"')
    good = (F.col("front") != "") & (F.col("end") > 0) & F.col("tail").rlike(_TAIL) & (literal | ~F.col("tail").rlike(r"^(\^\^|@)"))
    bad = F.raise_error(F.concat(F.lit("not N-Quads: "), F.col("line"))).cast("string")
    datatype, language = F.regexp_extract("tail", _TAIL, 1), F.regexp_extract("tail", _TAIL, 2)
    tag = F.when(literal & (language != ""), F.lower(language))
    resource = F.substr("rest", F.lit(1), F.col("end"))
    return held.select(
        _bare(F.regexp_extract("tail", _TAIL, 3)).alias("graph"), F.when(good, _bare(F.regexp_extract("front", _FRONT, 1))).otherwise(bad).alias("subject"),
        _bare(F.regexp_extract("front", _FRONT, 2)).alias("predicate"),
        F.when(literal, "literal").when(F.col("rest").startswith("_:"), "blank").otherwise("iri").alias("kind"),
        F.when(literal, _unescaped(F.substr("rest", F.lit(2), F.col("end") - 2))).otherwise(_bare(resource)).alias("object"),
        F.when(literal, F.when(datatype != "", _bare(datatype)).when(tag.isNotNull(), T.RDF_LANG_STRING).otherwise(T.XSD_STRING)).alias("datatype"),
        tag.alias("language"),
    ).select(QUAD_COLUMNS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The quads of files; a file is split by lines."""
    return parsed(spark.read.text(path))


def lines(quads: DataFrame, name: str = "nquad") -> DataFrame:
    """One N-Quads line a quad."""
    return quads.select(quad_text().alias(name))


def write(quads: DataFrame, path: str, canonical: bool = False) -> None:
    """Lines in files; canonical: distinct and in order over all files."""
    out = lines(quads, "value")
    if canonical:
        out = out.distinct().sort("value")
    out.write.mode("overwrite").text(path)


#: Readers of other RDF formats: format -> function of (spark, path) to a quad table.
_FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"application/n-quads": read}


def register(kind: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    _FORMATS[kind] = reader


def unregister(kind: str) -> None:
    _FORMATS.pop(kind, None)


def load(spark: SparkSession, path: str, kind: str = "application/n-quads") -> DataFrame:
    if kind not in _FORMATS:
        raise LinkedDataError(f"unknown format {kind}", "ld.UnknownFormat", format=kind)
    return _FORMATS[kind](spark, path)
