"""Tables as linked data: a context compiled to one projection, without shuffles.

A row is a node. Its columns are terms of a context: unmapped columns are never
read, coercions, datatypes and languages become literals of the plan.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.literals import canonical_double, canonical_json
from quadloom.model import terms as T
from quadloom.model.context import UNSET, Context, initial, process
from quadloom.schema import DEFAULT, ITEM, NODE_COLUMNS


@dataclass(frozen=True)
class Mapped:
    """A table and what makes nodes of its rows.

    context     terms for columns
    id          the node's identifier, as a column expression
    types       type IRIs, as column expressions
    columns     column name -> term; by default each column is its own term
    references  column -> prefix of the identifiers that its values complete
    languages   column -> column that holds its values' language
    graph       the graph, as a column expression
    """

    context: Mapping
    id: Column
    types: list[Column] = field(default_factory=list)
    columns: Mapping[str, str] | None = None
    references: Mapping[str, str] = field(default_factory=dict)
    languages: Mapping[str, str] = field(default_factory=dict)
    graph: Column | None = None


def compiled(context: Mapping) -> Context:
    return process(initial(""), dict(context))


def _native_text(col: Column, kind: str) -> tuple[Column, str | None]:
    """(lexical form, datatype) of a column of a Spark type, without a coercion."""
    if kind in ("double", "float"):
        number = col.cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < 1e21)
        return F.when(whole, F.format_string("%.0f", number)).otherwise(canonical_double(number)), "number"
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return col.cast("string"), T.XSD_INTEGER
    if kind == "boolean":
        return col.cast("string"), T.XSD_BOOLEAN
    if kind.startswith("timestamp"):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"), T.XSD_STRING
    return col.cast("string"), T.XSD_STRING


def _null() -> Column:
    return F.lit(None).cast("string")


def _value(col: Column, kind: str, ctx: Context, term: str, prefix: str | None, language: Column | None) -> tuple[Column, Column, Column, Column]:
    """(kind, value, datatype, language) of a column under its term."""
    coercion = ctx.value(term, "type")
    if coercion in ("@id", "@vocab"):
        text = col.cast("string")
        front = prefix if prefix is not None else ctx.vocab if coercion == "@vocab" and ctx.vocab else ""
        return F.lit("ref"), F.concat(F.lit(front), text) if front else text, _null(), _null()
    if coercion == "@json":
        return F.lit("value"), canonical_json(col.cast("string")), F.lit(T.RDF_JSON), _null()
    text, datatype = _native_text(col, kind)
    if coercion == T.XSD_DOUBLE or (coercion is None and datatype == "number"):
        number = col.cast("double")
        if coercion == T.XSD_DOUBLE:
            return F.lit("value"), canonical_double(number), F.lit(T.XSD_DOUBLE), _null()
        whole = (number == F.floor(number)) & (F.abs(number) < 1e21)
        return F.lit("value"), text, F.when(whole, T.XSD_INTEGER).otherwise(T.XSD_DOUBLE), _null()
    if coercion and coercion != "@none":
        return F.lit("value"), text, F.lit(coercion), _null()
    if datatype == T.XSD_STRING:
        tag = F.lower(language) if language is not None else F.lit(ctx.value(term, "language"))
        return F.lit("value"), text, F.when(tag.isNotNull(), T.RDF_LANG_STRING).otherwise(T.XSD_STRING), tag.cast("string")
    return F.lit("value"), text, F.lit(datatype), _null()


def nodes(df: DataFrame, m: Mapped) -> DataFrame:
    """The node-property rows of a table: one explode over an array that the context compiled to. Null columns have no row."""
    ctx = compiled(m.context)
    kinds = dict(df.dtypes)
    rows = [_entry("@type", F.lit("ref"), t, _null(), _null()) for t in m.types]
    for column, term in (m.columns or {c: c for c in df.columns}).items():
        iri = ctx.expand(term, vocab=True)
        if column not in kinds or not isinstance(iri, str) or ":" not in iri or T.is_keyword(iri):
            continue  # unmapped: the column is pruned
        language = F.col(m.languages[column]) if column in m.languages else None
        rows.append(_entry(iri, *_value(F.col(column), kinds[column], ctx, term, m.references.get(column), language)))
    graph = m.graph if m.graph is not None else F.lit(DEFAULT)
    each = df.select(graph.alias("graph"), m.id.alias("subject"), F.explode(F.array(*rows)).alias("r"))
    out = each.select("graph", "subject", "r.property", F.lit(0).alias("pos"), "r.kind", "r.value", "r.datatype", "r.language", F.lit(None).cast(f"array<{ITEM}>").alias("items"))
    return out.where("value IS NOT NULL").select(NODE_COLUMNS)


def _entry(iri: str, kind: Column, value: Column, datatype: Column, language: Column) -> Column:
    return F.struct(F.lit(iri).alias("property"), kind.alias("kind"), value.alias("value"), datatype.alias("datatype"), language.alias("language"))


def lists(rows: DataFrame, subject: Column, prop: str, order: Column, value: Column, datatype: str = T.XSD_STRING, by: list[str] | None = None) -> DataFrame:
    """Node-property rows whose value is the ordered list of each group's values."""
    item = F.struct(F.lit("value").alias("kind"), value.cast("string").alias("value"), F.lit(datatype).alias("datatype"), _null().alias("language"))
    grouped = rows.select(subject.alias("subject"), order.alias("o"), item.alias("item")).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("o", "item"))).alias("l"))
    return grouped.select(
        F.lit(DEFAULT).alias("graph"), "subject", F.lit(prop).alias("property"), F.lit(0).alias("pos"), F.lit("list").alias("kind"),
        _null().alias("value"), _null().alias("datatype"), _null().alias("language"), F.transform("l", lambda x: x["item"]).alias("items"),
    )


def typed(ctx: Context, term: str) -> bool:
    """Whether a term's definition says a type, language or direction."""
    found = ctx.terms.get(term)
    return bool(found and (found.type or found.language is not UNSET or found.direction is not UNSET))


def replaced(m: Mapped, **changes: object) -> Mapped:
    """A mapping with some of its parts changed."""
    return replace(m, **changes)


def collapsed(nodes: DataFrame, context: Mapping) -> DataFrame:
    """subject, term, value and whether it is a scalar: values compacted under a flat context, by literals of the plan.

    Each property takes the first of its terms, shorter and then lesser ones
    first; properties without a term are left out.
    """
    ctx = compiled(context)
    by_iri: dict[str, str] = {}
    for name in sorted(ctx.terms, key=lambda t: (len(t), T.utf16(t))):
        if ctx.terms[name].iri:
            by_iri.setdefault(ctx.terms[name].iri, name)
    if not by_iri:
        return nodes.limit(0).select("subject", F.lit("").alias("term"), "value", F.lit(True).alias("scalar"))
    term = scalar = None
    for iri, name in by_iri.items():
        kind, language = ctx.value(name, "type"), ctx.value(name, "language")
        typed_value = F.coalesce(F.col("datatype") == kind, F.lit(False)) if kind and kind not in ("@id", "@vocab") else F.lit(False)
        plain = (F.col("datatype") == T.XSD_STRING) & F.col("language").isNull() if not language and (not kind or kind in ("@id", "@vocab")) else F.lit(False)
        tagged = F.coalesce(F.col("language") == language, F.lit(False)) if language and not kind else F.lit(False)
        ok = F.when(F.col("kind") == "ref", F.lit(kind in ("@id", "@vocab"))).otherwise(typed_value | plain | tagged)
        hit = F.col("property") == iri
        term = F.when(hit, name) if term is None else term.when(hit, name)
        scalar = F.when(hit, ok) if scalar is None else scalar.when(hit, ok)
    return nodes.where(F.col("property").isin(list(by_iri))).select("subject", term.alias("term"), "value", scalar.alias("scalar"))
