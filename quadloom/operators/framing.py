"""Framing over node-property tables: filters, embedding, defaults and reverse links as joins.

A pattern is a frame in expanded form (see quadloom.api.Processor.expand with
_frame) or the same as a dict; it compiles to one aggregate over the node table
and joins on identifiers. Patterns of any depth are trees of joins; what has no
fixed depth (implicit subframes, links of links) runs per document in
operators.documents.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.model.framing import check
from quadloom.model.terms import aslist, is_keyword

_KEY = ["graph", "subject"]


def value_predicate(pattern: Mapping) -> Column:
    """Whether a value row matches a value pattern: each of @value, @type and @language a list, a wildcard {} or nothing."""
    wanted = {k: aslist(pattern[k]) if k in pattern else [] for k in ("@value", "@type", "@language")}
    ok = F.col("kind") == "value"
    values = wanted["@value"]
    if values and values[0] != {}:
        ok &= F.col("value").isin([str(v) for v in values])
    xsd_string = "http://www.w3.org/2001/XMLSchema#string"
    own_type = F.when(~F.col("datatype").isin(xsd_string, "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"), F.col("datatype"))
    for own, want in ((own_type, wanted["@type"]), (F.col("language"), [w.lower() if isinstance(w, str) else w for w in wanted["@language"]])):
        if not want:
            if "@type" in pattern or "@language" in pattern or values:
                ok &= own.isNull()
        elif want[0] == {}:
            ok &= own.isNotNull()
        else:
            ok &= F.coalesce(own.isin(want), F.lit(False))
    return ok


def _any(cond: Column) -> Column:
    return F.coalesce(F.max(cond.cast("int")), F.lit(0)) == 1


def matching(nodes: DataFrame, pattern: Mapping | list, require_all: bool = False) -> DataFrame:
    """(graph, subject) of the nodes that pass a frame's filter.

    As in documents, without require_all the first @id or @type key decides; the
    other keys are alternatives, except that `[]` demands absence.
    """
    pattern = check(pattern) if isinstance(pattern, list) else dict(pattern)
    tests: list[tuple[str, Column | None]] = []  # how it counts, and an aggregate over the node's rows; None for the next of `joins`
    joins: list[tuple[str, Mapping]] = []
    for key, raw in pattern.items():
        wanted = [raw] if isinstance(raw, dict) else aslist(raw)
        wild = wanted == [{}]
        if key == "@id":
            tests.append(("decides", F.lit(True) if wild or not wanted else F.first("subject").isin(wanted)))
        elif key == "@type":
            types = F.col("property") == "@type"
            if not wanted:
                tests.append(("absent", ~_any(types)))
            elif wild:
                tests.append(("decides", _any(types)))
            elif isinstance(wanted[0], dict) and "@default" in wanted[0]:
                tests.append(("decides", F.lit(True)))
            else:
                tests.append(("decides", _any(types & F.col("value").isin(wanted))))
        elif is_keyword(key):
            continue
        else:
            own = F.col("property") == key
            first = wanted[0] if wanted else None
            if not wanted:
                tests.append(("absent", ~_any(own)))
            elif isinstance(first, dict) and "@list" in first:
                want = first["@list"][0]
                item = F.col("items")
                hit = F.exists(item, _item_matches(want))
                tests.append(("or", _any(own & F.coalesce(hit, F.lit(False)))))
            elif isinstance(first, dict) and "@value" in first or isinstance(first, dict) and {"@language"} & first.keys():
                tests.append(("or", _any(own & value_predicate(first))))
            elif isinstance(first, dict) and ("@id" in first or "@type" in first or any(not is_keyword(k) for k in first)):
                joins.append((key, first))
                tests.append(("or", None))
            elif isinstance(first, dict) and "@default" in first:
                tests.append(("neutral", _any(own)))
            else:
                tests.append(("or", _any(own)))
    if not tests:
        return nodes.select(_KEY).distinct()
    held = nodes.groupBy(_KEY).agg(*[(F.lit(False) if t is None else t).alias(f"_t{i}") for i, (_, t) in enumerate(tests)])
    for (key, inner), i in zip(joins, [i for i, (_, t) in enumerate(tests) if t is None], strict=True):
        # only the references of this property are sent to the nodes they lead to; literals are not references, whatever their text
        found = matching(nodes, inner, require_all).select("graph", F.col("subject").alias("value"))
        hits = nodes.where((F.col("property") == key) & (F.col("kind") == "ref")).select(*_KEY, "value").join(found, ["graph", "value"], "left_semi").select(_KEY).distinct()
        held = held.drop(f"_t{i}").join(hits.withColumn(f"_t{i}", F.lit(True)), _KEY, "left").withColumn(f"_t{i}", F.coalesce(f"_t{i}", F.lit(False)))
    flags = [(how, F.col(f"_t{i}")) for i, (how, _) in enumerate(tests)]
    if require_all:
        ok = reduce(lambda a, b: a & b, [f for how, f in flags if how != "neutral"], F.lit(True))
    else:
        ok = None
        ors = [f for how, f in flags if how in ("or", "neutral")]
        absent = [f for how, f in flags if how == "absent"]
        decides = next((f for how, f in flags if how == "decides"), None)
        if decides is not None:
            ok = decides
        elif ors:
            ok = reduce(lambda a, b: a | b, ors)
        else:
            ok = F.lit(True)
        for f in absent:
            ok = ok & f if decides is None else ok
        if not ors and decides is None and absent:
            ok = reduce(lambda a, b: a & b, absent)
        elif absent and decides is None:
            ok = (ok | reduce(lambda a, b: a | b, absent)) & reduce(lambda a, b: a & b, absent)
    return held.where(ok).select(_KEY)


def _item_matches(want: Mapping) -> Callable[[Column], Column]:
    def test(x: Column) -> Column:
        if "@value" in want and aslist(want["@value"])[0] != {}:
            return (x["kind"] == "value") & x["value"].isin([str(v) for v in aslist(want["@value"])])
        if "@id" in want:
            return (x["kind"] == "ref") & x["value"].isin(aslist(want["@id"]))
        return x["kind"] == ("value" if "@value" in want else "ref")

    return test


def explicit(nodes: DataFrame, properties: list[str]) -> DataFrame:
    """Only the framed properties, and types: the filter reaches the scan."""
    return nodes.where(F.col("property").isin("@type", *properties))


def property_of(nodes: DataFrame, prop: str, name: str, default: object = None) -> DataFrame:
    """(graph, subject, name) of one-valued properties."""
    return nodes.where(F.col("property") == prop).select(*_KEY, F.col("value").alias(name))


def tree(nodes: DataFrame, matches: DataFrame, shape: Mapping, prefix: str = "") -> DataFrame:
    """One row for each match and combination of its framed values.

    shape: output column -> property IRI; or -> (property IRI, default); or ->
    (property IRI, shape below) to embed the node that the value refers to. A
    property that is missing gives its default, or null.
    """
    out = matches.select(_KEY)
    wanted = [spec if isinstance(spec, str) else spec[0] for spec in shape.values()]
    rows = nodes.where(F.col("property").isin(wanted)).select(*_KEY, "property", "kind", "value")
    for name, spec in shape.items():
        prop, more = (spec, None) if isinstance(spec, str) else spec
        own = rows.where(F.col("property") == prop)
        if isinstance(more, Mapping):  # only nodes that are referred to are looked up; a literal stays a value
            to = F.when(F.col("kind") == "ref", F.col("value"))
            lead = own.select(*_KEY, F.col("value").alias(name), to.alias("_to"))
            below = tree(nodes, lead.where("_to IS NOT NULL").select("graph", F.col("_to").alias("subject")).distinct(), more).withColumnRenamed("subject", "_to")
            out = out.join(lead.join(below, ["graph", "_to"], "left").drop("_to"), _KEY, "left")
            continue
        out = out.join(own.select(*_KEY, F.col("value").alias(name)), _KEY, "left")
        if more is None:
            continue
        out = out.withColumn(name, F.coalesce(name, F.lit(more)))
    return out


def reverse_of(nodes: DataFrame, matches: DataFrame, prop: str, name: str) -> DataFrame:
    """(graph, subject, name): for each match the nodes that refer to it by a property."""
    back = nodes.where((F.col("property") == prop) & (F.col("kind") == "ref")).select("graph", F.col("value").alias("subject"), F.col("subject").alias(name))
    return matches.join(back, _KEY)
