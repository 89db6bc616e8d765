"""IRIs in columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.model import iri as I

ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.\-]*|_):\S*$"
# scheme, authority, path, query, fragment; the groups with their delimiters tell an absent part from an empty one
_PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#([\s\S]*))?$"


def is_absolute(iri: Column) -> Column:
    return F.coalesce(iri.rlike(ABSOLUTE), F.lit(False))


def iri_parts(iri: Column) -> Column:
    """struct(scheme, authority, path, query, fragment); absent parts are null, a default port is taken away."""

    def part(outer: int, inner: int) -> Column:
        return F.when(F.regexp_extract(iri, _PARTS, outer) != "", F.regexp_extract(iri, _PARTS, inner))

    scheme = part(1, 2)
    authority = part(3, 4)
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    return F.struct(scheme.alias("scheme"), authority.alias("authority"), F.regexp_extract(iri, _PARTS, 5).alias("path"), part(6, 7).alias("query"), part(8, 9).alias("fragment"))


def dot_segments_removed(path: Column) -> Column:
    """The path without `.` and `..` segments: a fold over its segments."""
    rooted = path.startswith("/")
    segments = F.split(F.when(rooted, F.substring(path, 2, 1 << 30)).otherwise(path), "/")
    none = F.array().cast("array<string>")

    def step(held: Column, segment: Column) -> Column:
        return F.when(segment == ".", held).when(segment == "..", F.when(F.size(held) > 0, F.slice(held, 1, F.size(held) - 1)).otherwise(held)).otherwise(F.concat(held, F.array(segment)))

    kept = F.aggregate(segments, none, step)
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path == "", "").when(F.array_join(ended, "/") == "", "/").otherwise(F.concat(F.when(rooted, "/").otherwise(""), F.array_join(ended, "/")))


def resolved(base: str, reference: Column) -> Column:
    """A reference against a constant base."""
    b = I.parse(base)
    parts = iri_parts(reference)
    front = F.lit(f"{b.scheme}:" if b.scheme is not None else "")
    authority = F.lit(f"//{b.authority}" if b.authority is not None else "")
    folder = b.path[: b.path.rfind("/") + 1] or ("/" if b.authority is not None else "")
    query = F.when(parts["query"].isNotNull(), F.concat(F.lit("?"), parts["query"])).otherwise("")
    fragment = F.when(parts["fragment"].isNotNull(), F.concat(F.lit("#"), parts["fragment"])).otherwise("")
    own_query = F.when(parts["query"].isNotNull(), query).otherwise(f"?{b.query}" if b.query is not None else "")
    path = parts["path"]
    whole = dot_segments_removed(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(folder), path)))
    return (
        F.when(reference.contains(":"), reference)
        .when(parts["authority"].isNotNull(), F.concat(front, F.lit("//"), parts["authority"], dot_segments_removed(path), query, fragment))
        .when(path == "", F.concat(front, authority, F.lit(I.remove_dot_segments(b.path)), own_query, fragment))
        .otherwise(F.concat(front, authority, whole, query, fragment))
    )


def relativized(base: str, iri: Column) -> Column:
    """The shortest reference to an IRI from a constant base: the base's folders are tried from the deepest on."""
    b = I.parse(base)
    here = I.remove_dot_segments(b.path)
    parts = iri_parts(iri)
    there = dot_segments_removed(parts["path"])
    tail = F.concat(F.coalesce(F.concat(F.lit("?"), parts["query"]), F.lit("")), F.coalesce(F.concat(F.lit("#"), parts["fragment"]), F.lit("")))
    path = None
    for end in [i + 1 for i in range(len(here) - 1, -1, -1) if here[i] == "/"]:
        short = F.concat(F.lit("../" * here.count("/", end)), F.substring(there, end + 1, 1 << 30))
        path = F.when(there.startswith(here[:end]), short) if path is None else path.when(there.startswith(here[:end]), short)
    rest = F.concat(F.lit("../" * here.count("/")), there)
    path = rest if path is None else path.otherwise(rest)
    whole = F.concat(path, tail)
    near = F.when((there == here) & (tail != ""), tail).otherwise(F.when(whole == "", "./").otherwise(whole))
    same = parts["scheme"].eqNullSafe(F.lit(b.scheme)) & (parts["authority"] == F.lit(b.authority or ""))
    return F.when(F.coalesce(same, F.lit(False)), near).otherwise(iri)


def compacted(iri: Column, prefixes: dict[str, str]) -> Column:
    """The shortest compact IRI under constant prefixes (IRI -> term), the least of equally short ones; else the IRI."""
    order = sorted(prefixes.items(), key=lambda p: (len(p[1]) - len(p[0]), p[1]))
    out = None
    for known, term in order:
        hit = iri.startswith(known) & (F.length(iri) > len(known))
        short = F.concat(F.lit(f"{term}:"), F.substring(iri, len(known) + 1, 1 << 30))
        out = F.when(hit, short) if out is None else out.when(hit, short)
    return iri if out is None else out.otherwise(iri)
