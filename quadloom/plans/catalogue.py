"""Queries over the test tables, one or more for each operator, and the same in DuckDB over the raw tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import functions as L
from quadloom.functions.iris import compacted
from quadloom.model import terms as T
from quadloom.model.terms import RDF_LANG_STRING, XSD, XSD_STRING
from quadloom.operators import canonize, documents, framing, nodes, rdf
from quadloom.plans import table as P
from quadloom.plans.views import EX, mapped, table, view
from quadloom.schema import ITEM, QUAD_COLUMNS
from quadloom.sources import nquads

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its DuckDB equivalent if SQL can say it."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_DOUBLE = XSD + "double"


def _sql_double(x: str) -> str:
    """The canonical double of a DuckDB expression."""
    return rf"regexp_replace(printf('%.15e', {x}), '^(-?\d\.\d+?)0*e\+?(-?)0*(\d+)$', '\1E\2\3')"


def _doc(spark: SparkSession, sf_dir: str, name: str, doc_id: Column, json: Column) -> DataFrame:
    """Documents made of a table's rows."""
    return table(spark, sf_dir, name).select(doc_id.cast("string").alias("doc_id"), F.to_json(json).alias("json"))


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"urn:{kind}:"), F.col(key).cast("string"))


_CUSTOMER_NODES = f"""
SELECT 'urn:customer:' || c_custkey AS subject, '@type' AS property, 'ref' AS kind, '{EX}Customer' AS value, NULL AS datatype FROM customer
UNION ALL SELECT 'urn:customer:' || c_custkey, '{EX}name', 'value', c_name, '{XSD_STRING}' FROM customer
UNION ALL SELECT 'urn:customer:' || c_custkey, '{EX}balance', 'value', {_sql_double("c_acctbal")}, '{_DOUBLE}' FROM customer
UNION ALL SELECT 'urn:customer:' || c_custkey, '{EX}nation', 'ref', 'urn:nation:' || c_nationkey, NULL FROM customer
UNION ALL SELECT 'urn:customer:' || c_custkey, '{EX}segment', 'value', c_mktsegment, '{XSD_STRING}' FROM customer"""


def _as_quads(sql: str) -> str:
    """Quads of rows (subject, property, kind, value, datatype)."""
    return f"""SELECT '' AS graph, subject, CASE property WHEN '@type' THEN '{_TYPE}' ELSE property END AS predicate,
CASE kind WHEN 'ref' THEN 'iri' ELSE 'literal' END AS kind, value AS object, datatype, CAST(NULL AS VARCHAR) AS language FROM ({sql})"""


_STAR_NODES = f"""{_CUSTOMER_NODES}
UNION ALL SELECT 'urn:nation:' || n_nationkey, '@type', 'ref', '{EX}Nation', NULL FROM nation
UNION ALL SELECT 'urn:nation:' || n_nationkey, '{EX}name', 'value', n_name, '{XSD_STRING}' FROM nation
UNION ALL SELECT 'urn:nation:' || n_nationkey, '{EX}region', 'ref', 'urn:region:' || n_regionkey, NULL FROM nation
UNION ALL SELECT 'urn:region:' || r_regionkey, '@type', 'ref', '{EX}Region', NULL FROM region
UNION ALL SELECT 'urn:region:' || r_regionkey, '{EX}name', 'value', r_name, '{XSD_STRING}' FROM region"""


# expansion


@query(f"""SELECT 'urn:customer:' || c_custkey AS subject, '{EX}name' AS property, c_name AS value FROM customer
UNION ALL SELECT 'urn:customer:' || c_custkey, '{EX}segment', c_mktsegment FROM customer""")
def e11_drop_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context of two terms: the other columns are not read."""
    context = {"name": EX + "name", "segment": EX + "segment"}
    m = P.Mapped(context, _id("customer", "c_custkey"), columns={"c_name": "name", "c_mktsegment": "segment", "c_acctbal": "unknown", "c_nationkey": "missing"})
    return P.nodes(table(spark, sf_dir, "customer"), m).select("subject", "property", "value")


@query(f"SELECT 'urn:event:' || event_id AS subject, '{EX}event/' || event_type AS value FROM events")
def e14_type_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events").where("property = '@type'").select("subject", "value")


@query(f"SELECT 'urn:event:' || event_id AS subject, regexp_replace(props, '\\s', '', 'g') AS value, '{T.RDF_JSON}' AS datatype FROM events WHERE props IS NOT NULL")
def e17_json_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events").where(F.col("property") == EX + "props").select("subject", "value", "datatype")


@query(f"SELECT 'urn:nation:' || c_nationkey AS subject, '{EX}nationOf' AS property, 'urn:customer:' || c_custkey AS value FROM customer")
def e20_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.reversed_(view(spark, sf_dir, "customer"), EX + "nation", EX + "nationOf").select("subject", "property", "value")


@query(f"SELECT 'urn:part:' || p_partkey AS subject, '{EX}name' AS property, p_name AS value FROM part UNION ALL SELECT 'urn:part:' || p_partkey, '{EX}brand', p_brand FROM part")
def e21_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties under a nesting term belong to the node itself."""
    json = F.struct(_id("part", "p_partkey").alias("@id"), F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")).alias("labels"))
    context = {"labels": "@nest", "name": {"@id": EX + "name", "@nest": "labels"}, "brand": EX + "brand"}
    return documents.to_nodes(_doc(spark, sf_dir, "part", F.col("p_partkey"), json), expandContext=context).select("subject", "property", "value")


@query("SELECT 'urn:doc:' || doc_id AS subject, text AS value, lower(lang) AS language FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def e22_language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = F.struct(_id("doc", "doc_id").alias("@id"), F.create_map(F.upper("lang"), F.col("text")).alias("label"))
    docs = _doc(spark, sf_dir, "documents", F.col("doc_id"), json).where(F.get_json_object("json", "$.label").isNotNull())
    return documents.to_nodes(docs, expandContext={"label": {"@id": EX + "label", "@container": "@language"}}).select("subject", "value", "language")


@query("SELECT 'urn:turn:' || conv_id || '-' || turn AS subject, role AS value FROM conversations")
def e23_index_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in a map by role, whose keys become a property of each."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", F.concat(F.lit("urn:turn:"), F.concat_ws("-", "conv_id", "turn")).alias("@id"))
    by_role = turns.groupBy("conv_id", "role").agg(F.collect_list(F.struct("@id")).alias("turns"))  # the turns of one conversation
    docs = by_role.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "turns"))).alias("turns"))
    json = docs.select(F.col("conv_id").cast("string").alias("doc_id"), F.to_json(F.struct(_id("conv", "conv_id").alias("@id"), "turns")).alias("json"))
    context = {"turns": {"@id": EX + "turn", "@container": "@index", "@index": "role"}, "role": EX + "role"}
    return documents.to_nodes(json, expandContext=context).where(F.col("property") == EX + "role").select("subject", "value")


@query("SELECT 'urn:nation:' || n_nationkey AS subject, n_name AS value FROM nation")
def e24_id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(_id("nation", "n_nationkey").alias("key"), F.struct(F.col("n_name").alias("name")).alias("value"))
    grouped = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(entry)).alias("nations"))
    json = grouped.select(F.col("n_regionkey").cast("string").alias("doc_id"), F.to_json(F.struct(_id("region", "n_regionkey").alias("@id"), "nations")).alias("json"))
    context = {"nations": {"@id": EX + "nation", "@container": "@id"}, "name": EX + "name"}
    return documents.to_nodes(json, expandContext=context).where(F.col("property") == EX + "name").select("subject", "value")


@query(f"SELECT 'urn:event:' || event_id AS subject, '{EX}' || event_type AS value FROM events")
def e25_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = F.struct(_id("user", "user_id").alias("@id"), F.create_map(F.col("event_type"), F.struct(_id("event", "event_id").alias("@id"), F.lit(1).alias("seen"))).alias("events"))
    context = {"@vocab": EX, "events": {"@id": EX + "event", "@container": "@type"}}
    return documents.to_nodes(_doc(spark, sf_dir, "events", F.col("event_id"), json), expandContext=context).where("property = '@type'").select("subject", "value")


@query("SELECT 'urn:conv:' || conv_id AS subject, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, text AS value FROM conversations")
def e27_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _turn_lists(spark, sf_dir, "text")
    return listed.select("subject", F.posexplode("items").alias("pos", "item")).select("subject", "pos", F.col("item.value").alias("value"))


def _turn_lists(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return P.lists(table(spark, sf_dir, "conversations"), _id("conv", "conv_id"), EX + column, F.col("turn"), F.col(column))


@query(f"""SELECT 'urn:order:' || o_orderkey AS subject, '@type' AS property, 'ref' AS kind, '{EX}Order' AS value, NULL AS datatype, NULL AS language FROM orders
UNION ALL SELECT 'urn:order:' || o_orderkey, '{EX}customer', 'ref', 'urn:customer:' || o_custkey, NULL, NULL FROM orders
UNION ALL SELECT 'urn:order:' || o_orderkey, '{EX}status', 'value', o_orderstatus, '{XSD_STRING}', NULL FROM orders
UNION ALL SELECT 'urn:order:' || o_orderkey, '{EX}date', 'value', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '{XSD}dateTime', NULL FROM orders
UNION ALL SELECT 'urn:order:' || o_orderkey, '{EX}priority', 'value', o_orderpriority, '{RDF_LANG_STRING}', 'en' FROM orders""")
def e30_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, datatypes, languages and plain strings, by each term's definition."""
    return view(spark, sf_dir, "orders").select("subject", "property", "kind", "value", "datatype", "language")


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id FROM customer WHERE c_acctbal >= 5000")
def e9_drop_id_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that say no more than an identifier expand to nothing."""
    json = F.struct(_id("customer", "c_custkey").alias("@id"), F.when(F.col("c_acctbal") >= 5000, F.col("c_name")).alias("name"))
    out = documents.apply(_doc(spark, sf_dir, "customer", F.col("c_custkey"), json), "expand", expandContext={"name": EX + "name"})
    return out.where("result <> '[]'").select("doc_id")


# compaction


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS doc_id, CASE WHEN count(*) = 1 THEN min('urn:supplier:' || s_suppkey) ELSE '[' || string_agg('"urn:supplier:' || s_suppkey || '"', ',' ORDER BY s_suppkey) || ']' END AS suppliers FROM supplier GROUP BY s_nationkey""")
def k3_single_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One supplier is a scalar, several an array."""
    grouped = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("keys"))
    refs = F.transform("keys", lambda k: F.struct(F.concat(F.lit("urn:supplier:"), k.cast("string")).alias("@id")))
    docs = grouped.select(F.col("s_nationkey").cast("string").alias("doc_id"), F.to_json(F.struct(_id("nation", "s_nationkey").alias("@id"), refs.alias(EX + "supplier"))).alias("json"))
    out = documents.apply(docs, "compact", context={"suppliers": {"@id": EX + "supplier", "@type": "@id"}})
    return out.select("doc_id", F.get_json_object("result", "$.suppliers").alias("suppliers"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lower(lang) AS language, source AS value, 'rest' AS other FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def k11_language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged values put back into a map by language."""
    tagged = lambda v, tag: F.struct(v.alias("@value"), tag.alias("@language"))
    json = F.struct(_id("doc", "doc_id").alias("@id"), F.array(tagged(F.col("source"), F.col("lang")), tagged(F.lit("rest"), F.lit("xx"))).alias(EX + "source"))
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.lower("lang").alias("language"), F.to_json(json).alias("json"))
    out = documents.apply(docs, "compact", context={"source": {"@id": EX + "source", "@container": "@language"}}).join(docs.select("doc_id", "language"), "doc_id")
    held = F.from_json(F.get_json_object("result", "$.source"), "map<string,string>")
    return out.select("doc_id", "language", held[F.col("language")].alias("value"), held["xx"].alias("other"))


@query("SELECT CAST(event_id AS VARCHAR) AS doc_id, event_type AS key, 'urn:event:' || event_id AS id FROM events")
def k11_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes put back into a map by type."""
    event = F.struct(_id("event", "event_id").alias("@id"), F.array(F.concat(F.lit(EX), F.col("event_type"))).alias("@type"), F.col("value").alias(EX + "n"))
    json = F.struct(_id("user", "user_id").alias("@id"), F.array(event).alias(EX + "event"))
    context = {"@vocab": EX, "event": {"@id": EX + "event", "@container": "@type"}}
    out = documents.apply(_doc(spark, sf_dir, "events", F.col("event_id"), json), "compact", context=context)
    held = F.from_json(F.get_json_object("result", "$.event"), "map<string,string>")
    key = F.element_at(F.map_keys(held), 1)
    return out.select("doc_id", key.alias("key"), F.get_json_object(held[key], "$['@id']").alias("id"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN 'words' ELSE 'http://example.org/words' END AS term FROM supplier".replace("http://example.org/words", EX + "words"))
def k14_list_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term for lists of a language takes a list of such words and a node, but not one with words of another language."""
    word = F.struct(F.col("s_name").alias("@value"), F.when(F.col("s_suppkey") % 2 == 0, "en").otherwise("fr").alias("@language"))
    items = F.array(F.to_json(F.struct(F.col("s_name").alias("@value"), F.lit("en").alias("@language"))), F.to_json(word), F.to_json(F.struct(_id("nation", "s_nationkey").alias("@id"))))
    text = F.concat(F.lit('{"@id":"urn:s","' + EX + 'words":{"@list":['), F.array_join(items, ","), F.lit("]}}"))
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), text.alias("json"))
    out = documents.apply(docs, "compact", context={"words": {"@id": EX + "words", "@container": "@list", "@language": "en"}})
    keys = F.filter(F.json_object_keys("result"), lambda k: ~k.startswith("@"))
    return out.select("doc_id", F.element_at(keys, 1).alias("term"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, ['date', 'english', 'aa', 'id_of'][1 + p_partkey % 4] AS term FROM part")
def k15_select_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of many terms of one property the one whose type or language fits; of equal ones the shortest, then the least."""
    iri = EX + "about"
    context = {"date": {"@id": iri, "@type": XSD + "date"}, "english": {"@id": iri, "@language": "en"}, "aaa": iri, "ab": iri, "aa": iri, "id_of": {"@id": iri, "@type": "@id"}}
    kinds = [F.struct(F.lit("2020-01-01").alias("@value"), F.lit(XSD + "date").alias("@type")), F.struct(F.col("p_name").alias("@value"), F.lit("en").alias("@language")), F.struct(F.col("p_name").alias("@value")), F.struct(F.lit("urn:x").alias("@id"))]
    value = F.element_at(F.array(*map(F.to_json, kinds)), (1 + F.col("p_partkey") % 4).cast("int"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.concat(F.lit('{"@id":"urn:p","' + iri + '":'), value, F.lit("}")).alias("json"))
    out = documents.apply(docs, "compact", context=context)
    keys = F.filter(F.json_object_keys("result"), lambda k: ~k.startswith("@"))
    return out.select("doc_id", F.element_at(keys, 1).alias("term"))


PREFIXES = {"http://": "h", "https://": "s", "https://www.": "w", "https://blog.": "b", "http://blog.": "hb"}


@query("SELECT page_id, url, CASE " + " ".join(f"WHEN starts_with(url, '{iri}') AND length(url) > {len(iri)} THEN '{name}:' || substr(url, {len(iri) + 1})" for iri, name in sorted(PREFIXES.items(), key=lambda p: len(p[1]) - len(p[0]))) + " ELSE url END AS compacted FROM pages")
def k13_compact_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest compact IRI under constant prefixes."""
    return table(spark, sf_dir, "pages").select("page_id", "url", compacted(F.col("url"), PREFIXES).alias("compacted"))


_COLLAPSE = {"status": {"@id": EX + "status"}, "date": {"@id": EX + "date", "@type": XSD + "dateTime"}, "priority": {"@id": EX + "priority"}, "customer": {"@id": EX + "customer", "@type": "@id"}}


@query(f"""SELECT 'urn:order:' || o_orderkey AS subject, 'status' AS term, o_orderstatus AS value, true AS scalar FROM orders
UNION ALL SELECT 'urn:order:' || o_orderkey, 'date', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), true FROM orders
UNION ALL SELECT 'urn:order:' || o_orderkey, 'priority', o_orderpriority, false FROM orders
UNION ALL SELECT 'urn:order:' || o_orderkey, 'customer', 'urn:customer:' || o_custkey, true FROM orders""")
def k16_value_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values become scalars where the term's definition says the rest: a tagged string under a plain term does not."""
    return P.collapsed(view(spark, sf_dir, "orders"), _COLLAPSE).select("subject", "term", "value", "scalar")


# node maps


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) + count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY ALL)
SELECT 'urn:line:' || l_orderkey || '-' || l_linenumber AS subject, CAST(3 AS BIGINT) AS n_properties, n AS n_values FROM v""")
def f2_group_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the same identifier are one node; its values are distinct."""
    return nodes.node_sizes(view(spark, sf_dir, "lineitem")).select("subject", "n_properties", "n_values")


@query(f"""WITH v AS (SELECT 'urn:order:' || o_orderkey AS s, '@type' AS p, '{EX}Order' AS v FROM orders UNION SELECT 'urn:order:' || o_orderkey, 'customer', 'urn:customer:' || o_custkey FROM orders
UNION SELECT 'urn:order:' || o_orderkey, 'status', o_orderstatus FROM orders UNION SELECT 'urn:order:' || o_orderkey, 'date', CAST(o_orderdate AS VARCHAR) FROM orders
UNION SELECT 'urn:order:' || o_orderkey, 'priority', o_orderpriority FROM orders UNION SELECT 'urn:order:' || o_orderkey, 'note', 'copied' FROM orders WHERE o_orderstatus = 'F')
SELECT s AS subject, count(DISTINCT p) AS n_properties, count(*) AS n_values FROM v GROUP BY s""")
def f10_merge_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a graph for each status, and notes on some in another graph, as one graph."""
    orders = table(spark, sf_dir, "orders")
    by_status = P.nodes(orders, P.replaced(mapped("orders"), graph=F.concat(F.lit("urn:graph:"), F.col("o_orderstatus"))))
    again = P.nodes(orders.where("o_orderstatus = 'F'"), P.replaced(mapped("orders"), graph=F.lit("urn:graph:copy")))
    notes = P.nodes(orders.where("o_orderstatus = 'F'").withColumn("note", F.lit("copied")), P.Mapped({"note": EX + "note"}, _id("order", "o_orderkey"), columns={"note": "note"}, graph=F.lit("urn:graph:notes")))
    return nodes.node_sizes(nodes.in_one_graph(nodes.union(by_status, again, notes))).select("subject", "n_properties", "n_values")


@query(f"""SELECT DISTINCT subject, property, value FROM (SELECT 'urn:customer:' || c_custkey AS subject, '{EX}name' AS property, c_name AS value FROM customer
UNION ALL SELECT 'urn:customer:' || c_custkey, '{EX}nation', 'urn:nation:' || c_nationkey FROM customer
UNION ALL SELECT 'urn:nation:' || n_nationkey, '{EX}name', n_name FROM nation JOIN (SELECT DISTINCT c_nationkey FROM customer) ON n_nationkey = c_nationkey
UNION ALL SELECT 'urn:nation:' || n_nationkey, '{EX}region', 'urn:region:' || n_regionkey FROM nation JOIN (SELECT DISTINCT c_nationkey FROM customer) ON n_nationkey = c_nationkey
UNION ALL SELECT 'urn:region:' || r_regionkey, '{EX}name', r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON n_nationkey = c_nationkey))""")
def f11_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation and its region nested inside, as flat nodes."""
    joined = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 nations, 5 regions
    region = F.struct(_id("region", "r_regionkey").alias("@id"), F.col("r_name").alias("name"))
    nation = F.struct(_id("nation", "n_nationkey").alias("@id"), F.col("n_name").alias("name"), region.alias("region"))
    json = F.struct(_id("customer", "c_custkey").alias("@id"), F.col("c_name").alias("name"), nation.alias("nation"))
    docs = joined.select(F.col("c_custkey").cast("string").alias("doc_id"), F.to_json(json).alias("json"))
    rows = documents.well_formed(documents.to_nodes(docs, expandContext={"@vocab": EX})).drop("doc_id")
    return nodes.flatten(rows).select("subject", "property", "value")


@query("""WITH d AS (SELECT doc_id, count(DISTINCT text) + count(DISTINCT source) AS n, 2 AS p FROM documents GROUP BY doc_id),
l AS (SELECT doc_id, count(DISTINCT quality) + count(DISTINCT toxic) AS n, 2 AS p FROM labels GROUP BY doc_id)
SELECT 'urn:doc:' || coalesce(d.doc_id, l.doc_id) AS subject, CAST(coalesce(d.p, 0) + coalesce(l.p, 0) AS BIGINT) AS n_properties, CAST(coalesce(d.n, 0) + coalesce(l.n, 0) AS BIGINT) AS n_values FROM d FULL JOIN l ON d.doc_id = l.doc_id""")
def f13_merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = nodes.merge(view(spark, sf_dir, "documents"), view(spark, sf_dir, "labels"))
    return nodes.node_sizes(merged).select("subject", "n_properties", "n_values")


@query(f"""SELECT 'urn:doc:' || doc_id AS subject, '{EX}quality' AS property, CAST(quality AS VARCHAR) AS value FROM labels
UNION ALL SELECT 'urn:doc:' || doc_id, '{EX}toxic', CAST(toxic AS VARCHAR) FROM labels
UNION ALL SELECT 'urn:doc:' || doc_id, '{EX}source', source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def f13_merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node is whole from labels if it is there, else from documents."""
    sources = P.nodes(table(spark, sf_dir, "documents"), P.replaced(mapped("documents"), columns={"source": "source"}))
    return nodes.merge_first_wins(view(spark, sf_dir, "labels"), sources).select("subject", "property", "value")


@query("SELECT conv_id, 't' || role AS name, '_:b' || (row_number() OVER (PARTITION BY conv_id ORDER BY first) - 1) AS label FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL)")
def f7_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers as blank nodes, named by their first turn."""
    visits = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("t"), "role").alias("name"))
    return nodes.relabelled(visits, ["turn"], ["conv_id"])


# framing


@query("SELECT 'urn:nation:' || n_nationkey AS subject FROM nation WHERE n_nationkey IN (3, 5, 7)")
def q6_id_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.matching(view(spark, sf_dir, "nation"), {"@id": ["urn:nation:3", "urn:nation:5", "urn:nation:7"]}).select("subject")


@query("SELECT 'urn:event:' || event_id AS subject FROM events WHERE event_type IN ('click', 'view')")
def q7_type_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.matching(view(spark, sf_dir, "events"), {"@type": [EX + "event/click", EX + "event/view"]}).select("subject")


@query("SELECT 'urn:event:' || event_id AS subject FROM events WHERE event_type NOT IN ('click', 'view')")
def q7_type_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without a type."""
    some = F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit(EX), F.col("event_type")))
    rows = P.nodes(table(spark, sf_dir, "events"), P.replaced(mapped("events"), types=[some]))
    return framing.matching(rows, {"@type": []}).select("subject")


@query("SELECT 'urn:order:' || o_orderkey AS subject FROM orders WHERE o_orderstatus <> 'O'")
def q8_match_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that lack a property."""
    rows = view(spark, sf_dir, "orders")
    open_ = P.nodes(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").withColumn("open", F.lit("yes")), P.Mapped({"open": EX + "open"}, _id("order", "o_orderkey"), columns={"open": "open"}))
    return framing.matching(rows.unionByName(open_), {EX + "open": []}).select("subject")


@query("SELECT DISTINCT 'urn:doc:' || doc_id AS subject FROM documents WHERE lower(lang) = 'de' AND text IS NOT NULL")
def q9_value_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.matching(view(spark, sf_dir, "documents"), {EX + "text": [{"@value": [{}], "@language": ["de"]}]}).select("subject")


@query("SELECT DISTINCT 'urn:conv:' || conv_id AS subject FROM conversations WHERE role = 'system'")
def q10_list_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.matching(_turn_lists(spark, sf_dir, "role"), {EX + "role": [{"@list": [{"@value": ["system"]}]}]}).select("subject")


@query("SELECT 'urn:customer:' || c_custkey AS subject FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')")
def q11_node_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose nation's region is named EUROPE: two semi-joins."""
    rows = view(spark, sf_dir, "customer", "nation", "region")
    pattern = {EX + "nation": [{EX + "region": [{EX + "name": [{"@value": ["EUROPE"]}]}]}]}
    return framing.matching(rows, pattern).select("subject")


@query("""SELECT 'any' AS mode, 'urn:order:' || o_orderkey AS subject FROM orders WHERE o_orderstatus = 'O' OR o_orderpriority = '1-URGENT'
UNION ALL SELECT 'all', 'urn:order:' || o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def q12_require_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "orders")
    pattern = {EX + "status": [{"@value": ["O"]}], EX + "priority": [{"@value": ["1-URGENT"], "@language": ["en"]}]}
    one = framing.matching(rows, pattern).select(F.lit("any").alias("mode"), "subject")
    return one.unionByName(framing.matching(rows, pattern, require_all=True).select(F.lit("all").alias("mode"), "subject"))


@query("SELECT 'urn:customer:' || c_custkey AS subject, c_name AS name, 'urn:nation:' || n_nationkey AS nation, n_name AS nation_name, 'urn:region:' || r_regionkey AS region, r_name AS region_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def q13_embed_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation and its region embedded."""
    rows = view(spark, sf_dir, "customer", "nation", "region")
    found = framing.matching(rows, {"@type": [EX + "Customer"]})
    shape = {"name": EX + "name", "nation": (EX + "nation", {"nation_name": EX + "name", "region": (EX + "region", {"region_name": EX + "name"})})}
    return framing.tree(rows, found, shape).drop("graph")


@query("SELECT 'urn:customer:' || c_custkey AS subject, c_name AS name, 'urn:nation:' || c_nationkey AS nation FROM customer")
def q13_embed_never(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "customer")
    return framing.tree(rows, framing.matching(rows, {"@type": [EX + "Customer"]}), {"name": EX + "name", "nation": EX + "nation"}).drop("graph")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def q13_embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same embedding from each document's own graph, by the complete mapper."""
    joined = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 nations, 5 regions
    ref = lambda kind, key: F.struct(_id(kind, key).alias("@id"))
    graph = F.struct(
        F.struct(_id("customer", "c_custkey").alias("@id"), F.lit("Customer").alias("@type"), ref("nation", "n_nationkey").alias("nation")).alias("a"),
        F.struct(_id("nation", "n_nationkey").alias("@id"), F.col("n_name").alias("name"), ref("region", "r_regionkey").alias("region")).alias("b"),
        F.struct(_id("region", "r_regionkey").alias("@id"), F.col("r_name").alias("name")).alias("c"),
    )
    text = F.concat(F.lit('{"@graph":['), F.array_join(F.array(*[F.to_json(graph[k]) for k in "abc"]), ","), F.lit("]}"))
    docs = joined.select(F.col("c_custkey").cast("string").alias("doc_id"), text.alias("json"))
    frame = {"@context": {"@vocab": EX}, "@type": "Customer", "nation": {"region": {}}}
    out = documents.apply(docs, "frame", frame=frame, expandContext={"@vocab": EX})
    return out.select("doc_id", F.get_json_object("result", "$.nation.name").alias("nation"), F.get_json_object("result", "$.nation.region.name").alias("region"))


@query(f"SELECT 'urn:part:' || p_partkey AS subject, '{EX}brand' AS property, p_brand AS value FROM part UNION ALL SELECT 'urn:part:' || p_partkey, '@type', '{EX}Part' FROM part")
def q15_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.explicit(view(spark, sf_dir, "part"), [EX + "brand"]).select("subject", "property", "value")


@query("SELECT 'urn:doc:' || d.doc_id AS subject, d.source, coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q20_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their label's quality, or a default."""
    rows = view(spark, sf_dir, "documents", "labels")
    found = framing.matching(rows, {EX + "source": [{}]})
    return framing.tree(rows, found, {"source": EX + "source", "quality": (EX + "quality", "unknown")}).drop("graph")


@query("SELECT 'urn:nation:' || n_nationkey AS subject, count(c_custkey) AS n_customers, CAST(sum(c_custkey) AS BIGINT) AS sum_keys FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def q21_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "customer", "nation")
    back = framing.reverse_of(rows, framing.matching(rows, {"@type": [EX + "Nation"]}), EX + "nation", "customer")
    key = F.substring_index("customer", ":", -1).cast("long")
    return back.groupBy("subject").agg(F.count("*").alias("n_customers"), F.sum(key).alias("sum_keys"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'nation of ' || c_name AS name, c_custkey % 2 = 0 AS named FROM customer")
def q24_prune_bnodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank nodes of framed documents keep their identifiers only where these occur twice."""
    lead = F.struct(F.lit("_:n").alias("@id"))
    one = F.struct(_id("customer", "c_custkey").alias("@id"), F.lit("Customer").alias("@type"), lead.alias("nation"), F.when(F.col("c_custkey") % 2 == 0, lead).alias("other"))
    two = F.struct(F.lit("_:n").alias("@id"), F.concat(F.lit("nation of "), F.col("c_name")).alias("name"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.concat(F.lit('{"@graph":['), F.to_json(one), F.lit(","), F.to_json(two), F.lit("]}")).alias("json"))
    out = documents.apply(docs, "frame", frame={"@context": {"@vocab": EX}, "@type": "Customer"}, expandContext={"@vocab": EX})
    return out.select("doc_id", F.get_json_object("result", "$.nation.name").alias("name"), F.get_json_object("result", "$.nation['@id']").isNotNull().alias("named"))


@query("SELECT 'urn:order:' || o_orderkey AS subject FROM orders WHERE o_orderkey % 2 = 0")
def q11_literal_like_an_iri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that refer to a customer: those with the customer's identifier as a text do not."""
    text = F.col("o_orderkey") % 2 == 1
    link = F.struct(F.lit("@default").alias("graph"), _id("order", "o_orderkey").alias("subject"), F.lit(EX + "by").alias("property"), F.lit(0).alias("pos"), F.when(text, "value").otherwise("ref").alias("kind"), _id("customer", "o_custkey").alias("value"), F.when(text, XSD_STRING).alias("datatype"))
    kind = F.struct(F.lit("@default").alias("graph"), _id("customer", "o_custkey").alias("subject"), F.lit("@type").alias("property"), F.lit(0).alias("pos"), F.lit("ref").alias("kind"), F.lit(EX + "Customer").alias("value"), F.lit(None).cast("string").alias("datatype"))
    rows = table(spark, sf_dir, "orders").select(F.explode(F.array(link, kind)).alias("r")).select("r.*", F.lit(None).cast("string").alias("language"), F.lit(None).cast(f"array<{ITEM}>").alias("items"))
    return framing.matching(rows, {EX + "by": {"@type": [EX + "Customer"]}}).select("subject")


# RDF


@query(_as_quads(_CUSTOMER_NODES))
def r3_tordf_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: customers as quads, one scan and no shuffle."""
    return rdf.to_quads(view(spark, sf_dir, "customer"))


@query(f"SELECT DISTINCT * FROM ({_as_quads(_STAR_NODES)})")
def r3_tordf_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.to_quads(nodes.distinct_values(view(spark, sf_dir, "customer", "nation", "region")))


@query("""SELECT 'urn:conv:' || conv_id AS subject, row_number() OVER w - 1 AS i, text AS first, lead(turn) OVER w IS NOT NULL AS has_next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def r4_list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as chains of cells, read back cell by cell."""
    quads = rdf.to_quads(_turn_lists(spark, sf_dir, "text"))
    head = quads.where(F.col("predicate") == EX + "text").select(F.col("subject").alias("owner"), F.regexp_extract("object", "^(.*)-[0-9]+$", 1).alias("chain"))
    first = quads.where(F.col("predicate") == T.RDF_FIRST).select(F.col("subject").alias("cell"), F.col("object").alias("first"))
    rest = quads.where(F.col("predicate") == T.RDF_REST).select(F.col("subject").alias("cell"), (F.col("object") != T.RDF_NIL).alias("has_next"))
    cells = first.join(rest, "cell").select(F.regexp_extract("cell", "^(.*)-[0-9]+$", 1).alias("chain"), F.regexp_extract("cell", "-([0-9]+)$", 1).cast("long").alias("i"), "first", "has_next")
    return cells.join(head, "chain").select(F.col("owner").alias("subject"), "i", "first", "has_next")


@query(f"SELECT 'urn:doc:' || doc_id AS subject, text AS object, '{T.I18N}' || lower(lang) || '_ltr' AS datatype FROM documents WHERE text IS NOT NULL")
def r6_i18n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a direction, which their datatype carries."""
    quads = rdf.to_quads(view(spark, sf_dir, "documents").where(F.col("property") == EX + "text"))
    return quads.select("subject", "object", rdf.i18n(F.col("object"), F.col("language"), F.lit("ltr")).alias("datatype"))


@query(f"SELECT 'urn:customer:' || c_custkey AS subject, c_name AS name, {_sql_double('c_acctbal')} AS balance, 'urn:nation:' || c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def r9_fromrdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' quads pivoted back to rows."""
    back = rdf.from_quads(rdf.to_quads(view(spark, sf_dir, "customer")))
    cols = {k: F.max(F.when(F.col("property") == EX + k, F.col("value"))).alias(k) for k in ("name", "balance", "nation", "segment")}
    return back.groupBy("subject").agg(*cols.values())


@query("SELECT 'urn:conv:' || conv_id AS subject, count(*) AS n, string_agg(role, ' ' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def r10_list_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists reassembled from their cells."""
    lists = rdf.rebuilt_lists(rdf.to_quads(_turn_lists(spark, sf_dir, "role")))
    return lists.select("subject", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x["value"]), " ").alias("roles"))


@query(f"""SELECT 'urn:order:' || o_orderkey AS subject, 'count' AS name, CAST(o_custkey AS VARCHAR) AS native, CAST(NULL AS VARCHAR) AS rest_type FROM orders
UNION ALL SELECT 'urn:order:' || o_orderkey, 'padded', NULL, NULL FROM orders
UNION ALL SELECT 'urn:order:' || o_orderkey, 'open', CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END, NULL FROM orders
UNION ALL SELECT 'urn:order:' || o_orderkey, 'status', NULL, '{XSD_STRING}' FROM orders""")
def r13_native_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native values of literals: an integer that is not canonical stays text and loses its type."""
    orders = table(spark, sf_dir, "orders")
    lit = lambda name, value, kind: F.struct(F.lit(name).alias("name"), value.cast("string").alias("object"), F.lit(kind).alias("datatype"))
    rows = F.array(
        lit("count", F.col("o_custkey"), XSD + "integer"), lit("padded", F.concat(F.lit("0"), F.col("o_custkey").cast("string"), F.lit("")), XSD + "integer"),
        lit("open", F.when(F.col("o_orderstatus") == "O", "1").otherwise("false"), XSD + "boolean"), lit("status", F.col("o_orderstatus"), XSD_STRING),
    )
    quads = orders.select(_id("order", "o_orderkey").alias("subject"), F.explode(rows).alias("r")).select("subject", "r.name", F.lit("literal").alias("kind"), "r.object", "r.datatype", F.lit(None).cast("string").alias("language"))
    return rdf.native_value(quads).select("subject", "name", "native", "rest_type")


def _sql_line(predicate: str, o: str) -> str:
    return f"'<urn:customer:' || c_custkey || '> <{EX}{predicate}> ' || {o} || ' .' || chr(10)"


@query(f"""WITH t AS (SELECT c_custkey, unnest([{_sql_line("name", "'\"' || c_name || '\"'")}, {_sql_line("nation", "'<urn:nation:' || c_nationkey || '>'")}, {_sql_line("segment", "'\"' || c_mktsegment || '\"'")},
{_sql_line("balance", f"'\"' || {_sql_double('c_acctbal')} || '\"^^<{_DOUBLE}>'")}, '<urn:customer:' || c_custkey || '> <{_TYPE}> <{EX}Customer> .' || chr(10)]) AS line FROM customer)
SELECT 'urn:customer:' || c_custkey AS subject, sha256(string_agg(line, '' ORDER BY line)) AS hash FROM t GROUP BY c_custkey""")
def r15_canon_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a dataset without blank nodes."""
    quads = rdf.to_quads(view(spark, sf_dir, "customer")).withColumn("key", F.col("subject"))
    return canonize.canonize(quads, "key").select(F.col("key").alias("subject"), "hash")


@query(f"""WITH t AS (SELECT o_orderkey, unnest(['_:a <{EX}customer> <urn:customer:' || o_custkey || '> .' || chr(10), '_:a <{EX}status> "' || o_orderstatus || '" .' || chr(10),
'<urn:order:' || o_orderkey || '> <{EX}detail> _:a .' || chr(10)]) AS line FROM orders)
SELECT 'urn:order:' || o_orderkey AS key, sha256(string_agg(line, '' ORDER BY line)) AS hash FROM t GROUP BY o_orderkey""")
def r15_canon_first_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a blank node each: the first-degree hash of the node."""
    return canonize.first_degree(_detailed(spark, sf_dir), "key").select("key", "hash")


def _detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.concat(F.lit("_:o"), F.col("o_orderkey").cast("string"))
    null = F.lit(None).cast("string")
    row = lambda s, p, k, o, d: F.struct(F.lit("").alias("graph"), s.alias("subject"), F.lit(EX + p).alias("predicate"), F.lit(k).alias("kind"), o.alias("object"), d.alias("datatype"), null.alias("language"))
    rows = F.array(row(blank, "customer", "iri", _id("customer", "o_custkey"), null), row(blank, "status", "literal", F.col("o_orderstatus"), F.lit(XSD_STRING)), row(_id("order", "o_orderkey"), "detail", "blank", blank, null))
    return table(spark, sf_dir, "orders").select(_id("order", "o_orderkey").alias("key"), F.explode(rows).alias("r")).select("key", "r.*")


#: The canonical text of a ring of three blank nodes, whatever their names.
_RING = "".join(f"_:c14n{a} <{EX}next> _:c14n{b} .\n" for a, b in ((0, 2), (1, 0), (2, 1)))


@query(f"SELECT 'urn:nation:' || n_nationkey AS key, t AS nquads, sha256(t) AS hash FROM nation, (SELECT '{_RING}' AS t)")
def r15_canon_ndegree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation as a ring of three blank nodes, which only n-degree hashes can name."""
    blank = lambda i: F.concat(F.lit("_:n"), F.col("n_nationkey").cast("string"), F.lit(f"x{i % 3}"))
    rows = F.array(*[F.struct(blank(i).alias("subject"), blank(i + 1).alias("object")) for i in range(3)])
    quads = table(spark, sf_dir, "nation").select(_id("nation", "n_nationkey").alias("key"), F.explode(rows).alias("r"))
    quads = quads.select("key", F.lit("").alias("graph"), "r.subject", F.lit(EX + "next").alias("predicate"), F.lit("blank").alias("kind"), "r.object", F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("language"))
    return canonize.canonize(quads, "key").select("key", "nquads", "hash")


def _two_blanks(algorithm: str) -> str:
    """The canonical text of two blank nodes with a status each, named in the order of their first-degree hashes."""
    lines = [f'_:a <{EX}status> "{x}" .\n' for x in "FOPQRS"]
    order = sorted(lines, key=lambda line: hashlib.new(algorithm, line.encode()).hexdigest())
    return "".join(sorted(line.replace("_:a", f"_:c14n{i}") for i, line in enumerate(order)))


@query(f"SELECT 'urn:nation:' || n_nationkey AS key, '{_two_blanks('sha256')}' AS sha256, '{_two_blanks('sha384')}' AS sha384 FROM nation")
def r15_canon_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank nodes named by first-degree hashes of either algorithm, which order them differently."""
    rows = F.array(*[F.struct(F.concat(F.lit("_:n"), F.col("n_nationkey").cast("string"), F.lit(x)).alias("subject"), F.lit(x).alias("object")) for x in "FOPQRS"])
    quads = table(spark, sf_dir, "nation").select(_id("nation", "n_nationkey").alias("key"), F.explode(rows).alias("r"))
    quads = quads.select("key", F.lit("").alias("graph"), "r.subject", F.lit(EX + "status").alias("predicate"), F.lit("literal").alias("kind"), "r.object", F.lit(XSD_STRING).alias("datatype"), F.lit(None).cast("string").alias("language"))
    one, two = (canonize.canonize(quads, "key", a).select("key", F.col("nquads").alias(a)) for a in ("sha256", "sha384"))
    return one.join(two, "key")


@query(r"SELECT 'urn:doc:' || doc_id AS subject, 'A\u0041 ' || source || '\ A\n' AS object FROM documents WHERE source IS NOT NULL")
def s10_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes are read once: a backslash that one stands for begins no other."""
    text = F.concat(F.lit(r'\u0041\u005Cu0041 '), F.col("source"), F.lit(r"\\ \U00000041\u005Cn"))
    line = F.concat(F.lit("<"), _id("doc", "doc_id"), F.lit(f'> <{EX}text> "'), text, F.lit('" .'))
    return nquads.parsed(table(spark, sf_dir, "documents").where("source IS NOT NULL").select(line.alias("value"))).select("subject", "object")


@query(_as_quads(_CUSTOMER_NODES))
def s10_nquads_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to N-Quads lines and back."""
    return nquads.parsed(nquads.lines(rdf.to_quads(view(spark, sf_dir, "customer")), "value")).select(QUAD_COLUMNS)


@query("SELECT 'urn:doc:' || doc_id AS subject, text AS object, lower(lang) AS language FROM documents WHERE text IS NOT NULL")
def s11_escaped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line ends and quotes to N-Quads lines and back."""
    quads = rdf.to_quads(view(spark, sf_dir, "documents").where(F.col("property") == EX + "text"))
    return nquads.parsed(nquads.lines(quads, "value")).select("subject", "object", "language")


# functions


@query(r"""SELECT page_id, regexp_extract(url, '^([^:/?#]+):', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS authority, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
CASE WHEN contains(url, '?') THEN regexp_extract(url, '\?([^#]*)', 1) END AS query, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment FROM pages""")
def u1_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", L.iri_parts(F.col("url")).alias("p")).select("page_id", "p.*")


BASE = "http://example.com/a/b/c?q"


@query(f"SELECT page_id, '{BASE[:-4]}/x' || page_id || '?p#f' AS child, 'http://example.com/a/x' || page_id AS up, url AS absolute FROM pages".replace(f"{BASE[:-4]}/x", "http://example.com/a/b/x"))
def u2_prepend_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    refs = {"child": F.concat(F.lit("x"), key, F.lit("?p#f")), "up": F.concat(F.lit("./../x"), key), "absolute": F.col("url")}
    return table(spark, sf_dir, "pages").select("page_id", *(L.resolved(BASE, r).alias(n) for n, r in refs.items()))


@query("SELECT page_id, 'x' || page_id AS child, '../x' || page_id AS up, url AS other FROM pages")
def u3_remove_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    iris = {"child": F.concat(F.lit("http://example.com/a/b/x"), key), "up": F.concat(F.lit("http://example.com/a/x"), key), "other": F.col("url")}
    return table(spark, sf_dir, "pages").select("page_id", *(L.relativized(BASE, i).alias(n) for n, i in iris.items()))


@query("SELECT doc_id, '/' || source || '/' || lang AS path, '/' || lang || '/' AS folder, '/' || lang AS above FROM documents")
def u4_dot_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), lambda *parts: L.dot_segments_removed(F.concat(*(F.col(p) if p.isalpha() else F.lit(p) for p in parts)))
    return docs.select("doc_id", path("/", "source", "/./x/../", "lang").alias("path"), path("/./", "source", "/../", "lang", "/.").alias("folder"), path("/../", "source", "/../../", "lang").alias("above"))


@query("SELECT doc_id, doc_id % 3 = 0 AS absolute FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def u5_is_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a scheme; without one; and with white space."""
    kinds = F.array(F.concat("lang", F.lit(":"), "source"), F.concat("source", F.lit("/"), "lang", F.lit(":x")), F.concat("lang", F.lit(": "), "source"))
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    return docs.select("doc_id", L.is_absolute(F.element_at(kinds, (1 + F.col("doc_id") % 3).cast("int"))).alias("absolute"))


@query(f"SELECT l_orderkey, l_linenumber, {_sql_double('l_extendedprice')} AS price, {_sql_double('l_discount')} AS discount FROM lineitem")
def u16_canonical_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", L.canonical_double(F.col("l_extendedprice")).alias("price"), L.canonical_double(F.col("l_discount")).alias("discount"))


@query("SELECT event_id, regexp_replace(props, '\\s', '', 'g') AS json FROM events")
def u17_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", L.canonical_json(F.col("props")).alias("json"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'invalid @language value' WHEN doc_id % 3 = 1 THEN 'invalid property' END AS event, CASE WHEN doc_id % 3 < 2 THEN 'ld.ValidationError' END AS error FROM documents")
def x_safe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe mode on documents with a bad language tag, an unknown property, or neither."""
    tag = F.when(F.col("doc_id") % 3 == 0, "not a tag").otherwise(F.col("lang"))
    json = F.struct(_id("doc", "doc_id").alias("@id"), F.struct(F.col("source").alias("@value"), tag.alias("@language")).alias("source"), F.when(F.col("doc_id") % 3 == 1, "x").alias("unknown"))
    out = documents.apply(_doc(spark, sf_dir, "documents", F.col("doc_id"), json), "expand", safe=True, expandContext={"source": EX + "source"})
    return out.select("doc_id", F.when(F.size("events") > 0, F.element_at("events", 1)).alias("event"), "error")


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def k2_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents expanded and compacted with the same context."""
    context = {"@vocab": EX, "nation": {"@type": "@id"}}
    json = F.struct(_id("customer", "c_custkey").alias("@id"), F.col("c_name").alias("name"), _id("nation", "c_nationkey").alias("nation"))
    docs = _doc(spark, sf_dir, "customer", F.col("c_custkey"), json)
    expanded = documents.apply(docs, "expand", expandContext=context).select("doc_id", F.col("result").alias("json"))
    out = documents.apply(expanded, "compact", context=context, skipExpansion=True)
    return out.select("doc_id", F.get_json_object("result", "$.name").alias("name"), F.substring_index(F.get_json_object("result", "$.nation"), ":", -1).alias("nation"))


@query(f"""SELECT 'urn:vec:' || vec_id AS subject, count(*) AS n, min(e) AS least FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings) GROUP BY vec_id""".replace("min(e)", "CAST(min(e) AS DOUBLE)"))
def r4_embedding_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as lists of doubles, through quads and back."""
    each = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    listed = P.lists(each, _id("vec", "vec_id"), EX + "embedding", F.col("i"), F.col("x").cast("double"), _DOUBLE)
    firsts = rdf.to_quads(listed).where(F.col("predicate") == T.RDF_FIRST)
    chains = rdf.to_quads(listed).where(F.col("predicate") == EX + "embedding").select("subject", F.regexp_extract("object", "^(.*)-[0-9]+$", 1).alias("chain"))
    cells = firsts.select(F.regexp_extract("subject", "^(.*)-[0-9]+$", 1).alias("chain"), F.col("object").cast("double").alias("x"))
    return cells.join(chains, "chain").groupBy("subject").agg(F.count("*").alias("n"), F.min("x").alias("least"))


# documents with graphs, inclusions and lists, by the complete mapper


@query("SELECT 'urn:graph:' || c_nationkey AS graph, 'urn:customer:' || c_custkey AS subject, c_name AS value FROM customer")
def e16_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the named graph of their nation."""
    inner = F.struct(_id("customer", "c_custkey").alias("@id"), F.col("c_name").alias("name"))
    json = F.struct(_id("graph", "c_nationkey").alias("@id"), F.array(inner).alias("@graph"))
    rows = documents.to_nodes(_doc(spark, sf_dir, "customer", F.col("c_custkey"), json), expandContext={"@vocab": EX})
    return rows.select("graph", "subject", "value")


@query("SELECT 'urn:customer:' || c_custkey AS subject, c_name AS value FROM customer UNION ALL SELECT 'urn:nation:' || c_nationkey || '-' || c_custkey, 'nation of ' || c_name FROM customer")
def e15_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are included beside another."""
    other = F.struct(F.concat(_id("nation", "c_nationkey"), F.lit("-"), F.col("c_custkey").cast("string")).alias("@id"), F.concat(F.lit("nation of "), F.col("c_name")).alias("name"))
    json = F.struct(_id("customer", "c_custkey").alias("@id"), F.col("c_name").alias("name"), F.array(other).alias("@included"))
    return documents.to_nodes(_doc(spark, sf_dir, "customer", F.col("c_custkey"), json), expandContext={"@vocab": EX}).select("subject", "value")


_GRAPHS = {"@vocab": EX, "said": {"@id": EX + "said", "@container": ["@graph", "@id"]}}


@query("SELECT 'urn:order:' || o_orderkey AS graph, 'urn:customer:' || o_custkey AS subject, o_orderstatus AS value FROM orders")
def e26_graph_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of graphs by identifier."""
    inner = F.struct(_id("customer", "o_custkey").alias("@id"), F.col("o_orderstatus").alias("status"))
    json = F.struct(F.lit("urn:all").alias("@id"), F.create_map(_id("order", "o_orderkey"), inner).alias("said"))
    rows = documents.to_nodes(_doc(spark, sf_dir, "orders", F.col("o_orderkey"), json), expandContext=_GRAPHS)
    return rows.where(F.col("property") == EX + "status").select("graph", "subject", "value")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderstatus AS status FROM orders")
def k10_graph_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same map after expansion and compaction."""
    inner = F.struct(_id("customer", "o_custkey").alias("@id"), F.col("o_orderstatus").alias("status"))
    json = F.struct(F.lit("urn:all").alias("@id"), F.create_map(_id("order", "o_orderkey"), inner).alias("said"))
    out = documents.apply(_doc(spark, sf_dir, "orders", F.col("o_orderkey"), json), "compact", context=_GRAPHS, expandContext=_GRAPHS)
    held = F.from_json(F.get_json_object("result", "$.said"), "map<string,struct<status:string>>")
    return out.select("doc_id", F.element_at(held, F.concat(F.lit("urn:order:"), "doc_id"))["status"].alias("status"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, 'urn:nation:' || s_nationkey AS nation FROM supplier")
def k6_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reverse link under a reverse term."""
    context = {"@vocab": EX, "memberOf": {"@reverse": EX + "hasMember", "@type": "@id"}}
    json = F.struct(_id("supplier", "s_suppkey").alias("@id"), F.struct(F.array(F.struct(_id("nation", "s_nationkey").alias("@id"))).alias(EX + "hasMember")).alias("@reverse"))
    out = documents.apply(_doc(spark, sf_dir, "supplier", F.col("s_suppkey"), json), "compact", context=context)
    return out.select("doc_id", F.get_json_object("result", "$.memberOf").alias("nation"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_name AS name, p_brand AS brand FROM part")
def k8_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties put back under their nesting term."""
    context = {"labels": "@nest", "name": {"@id": EX + "name", "@nest": "labels"}, "brand": {"@id": EX + "brand", "@nest": "labels"}}
    json = F.struct(_id("part", "p_partkey").alias("@id"), F.col("p_name").alias(EX + "name"), F.col("p_brand").alias(EX + "brand"))
    out = documents.apply(_doc(spark, sf_dir, "part", F.col("p_partkey"), json), "compact", context=context)
    return out.select("doc_id", F.get_json_object("result", "$.labels.name").alias("name"), F.get_json_object("result", "$.labels.brand").alias("brand"))


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, count(*) AS n, first(role ORDER BY turn) AS first, last(role ORDER BY turn) AS last FROM conversations GROUP BY conv_id")
def k9_list_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the bare array of a list container, in order, after expansion and compaction."""
    context = {"@vocab": EX, "roles": {"@id": EX + "roles", "@container": "@list"}}
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    docs = grouped.select(F.col("conv_id").cast("string").alias("doc_id"), F.to_json(F.struct(_id("conv", "conv_id").alias("@id"), "roles")).alias("json"))
    roles = F.from_json(F.get_json_object("result", "$.roles"), "array<string>")
    out = documents.apply(docs, "compact", context=context, expandContext=context).withColumn("r", roles)
    return out.select("doc_id", F.size("r").cast("long").alias("n"), F.element_at("r", 1).alias("first"), F.element_at("r", -1).alias("last"))


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, count(*) AS n, first(text ORDER BY turn) AS first_text FROM conversations GROUP BY conv_id")
def q19_list_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that a list refers to, embedded in its order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("urn:turn:"), F.concat_ws("-", "conv_id", "turn")).alias("id"), "text")
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "id", "text"))).alias("t"))
    node = F.to_json(F.struct(_id("conv", "conv_id").alias("@id"), F.lit("Talk").alias("@type"), F.struct(F.transform("t", lambda x: F.struct(x["id"].alias("@id"))).alias("@list")).alias("turns")))
    rest = F.transform("t", lambda x: F.to_json(F.struct(x["id"].alias("@id"), x["text"].alias("text"))))
    docs = grouped.select(F.col("conv_id").cast("string").alias("doc_id"), F.concat(F.lit('{"@graph":['), F.array_join(F.concat(F.array(node), rest), ","), F.lit("]}")).alias("json"))
    frame = {"@context": {"@vocab": EX, "turns": {"@id": EX + "turns", "@container": "@list"}}, "@type": "Talk"}
    out = documents.apply(docs, "frame", frame=frame, expandContext={"@vocab": EX})
    held = F.from_json(F.get_json_object("result", "$.turns"), "array<struct<text:string>>")
    return out.select("doc_id", F.size(held).cast("long").alias("n"), F.element_at(held, 1)["text"].alias("first_text"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'urn:customer:' || o_custkey AS inner_id, o_orderstatus AS status FROM orders")
def q17_named_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame with a graph: the nodes of the graph that a node names."""
    inner = F.struct(_id("customer", "o_custkey").alias("@id"), F.col("o_orderstatus").alias("status"))
    json = F.struct(_id("order", "o_orderkey").alias("@id"), F.lit("Order").alias("@type"), F.array(inner).alias("@graph"))
    frame = {"@context": {"@vocab": EX}, "@type": "Order", "@graph": {}}
    out = documents.apply(_doc(spark, sf_dir, "orders", F.col("o_orderkey"), json), "frame", frame=frame, expandContext={"@vocab": EX})
    return out.select("doc_id", F.get_json_object("result", "$['@graph'][0]['@id']").alias("inner_id"), F.get_json_object("result", "$['@graph'][0].status").alias("status"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 'urn:customer:' || c_custkey AS id, 'urn:nation:' || c_nationkey AS included FROM customer")
def q18_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame that includes other nodes beside its match."""
    graph = F.array(F.to_json(F.struct(_id("customer", "c_custkey").alias("@id"), F.lit("Customer").alias("@type"))), F.to_json(F.struct(_id("nation", "c_nationkey").alias("@id"), F.lit("Nation").alias("@type"))))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.concat(F.lit('{"@graph":['), F.array_join(graph, ","), F.lit("]}")).alias("json"))
    frame = {"@context": {"@vocab": EX}, "@type": "Customer", "@included": [{"@type": "Nation"}]}
    out = documents.apply(docs, "frame", frame=frame, expandContext={"@vocab": EX})
    return out.select("doc_id", F.get_json_object("result", "$['@id']").alias("id"), F.get_json_object("result", "$['@included']['@id']").alias("included"))


@query("SELECT graph, id, bool_or(said) AS has_properties FROM (SELECT '@default' AS graph, 'urn:customer:' || c_custkey AS id, true AS said FROM customer UNION ALL SELECT '@default', 'urn:nation:' || c_nationkey, false FROM customer) GROUP BY ALL")
def f12_node_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes, those that are only referred to included."""
    return nodes.subjects(view(spark, sf_dir, "customer"))


@query("SELECT page_id, 'http://example.org/base/' || page_id AS id FROM pages")
def s2_remote_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose context is a URL, from a table of remote documents; identifiers are relative to a base."""
    remote = {"http://example.org/context": '{"@context": {"url": {"@id": "http://example.org/url", "@type": "@id"}}}'}
    json = F.struct(F.lit("http://example.org/context").alias("@context"), F.col("page_id").cast("string").alias("@id"), F.col("url"))
    rows = documents.to_nodes(_doc(spark, sf_dir, "pages", F.col("page_id"), json), remote=remote, base="http://example.org/base/x")
    return rows.select(F.col("doc_id").cast("long").alias("page_id"), F.col("subject").alias("id"))


# contexts and failures


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, unnest(['{EX}partName', '{EX}brandName', '{EX}name']) AS property, unnest([p_name, p_brand, p_type]) AS value FROM part""")
def c23_scoped_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One term with three meanings: by the node's type, by the property it is under, and by neither, as a type's context does not reach nodes below."""
    context = {"@vocab": EX, "Part": {"@id": EX + "Part", "@context": {"name": EX + "partName"}}, "maker": {"@id": EX + "maker", "@context": {"name": EX + "brandName"}}}
    json = F.struct(_id("part", "p_partkey").alias("@id"), F.lit("Part").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("maker"), F.struct(F.col("p_type").alias("name")).alias("kind"))
    rows = documents.to_nodes(_doc(spark, sf_dir, "part", F.col("p_partkey"), json), expandContext=context)
    return rows.where("kind = 'value'").select("doc_id", "property", "value")


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, unnest(['{EX}name', '{EX}label']) AS property, s_name AS value FROM supplier")
def c7_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context that does not propagate ends with its node."""
    context = {"name": EX + "label", "of": EX + "of"}
    json = F.concat(F.lit('{"@context":{"@propagate":false,"name":"' + EX + 'name"},"@id":"urn:s","name":'), F.to_json(F.array("s_name")), F.lit(',"of":{"name":'), F.to_json(F.array("s_name")), F.lit("}}"))
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), json.alias("json"))
    return documents.to_nodes(docs, expandContext=context).where("kind = 'value'").select("doc_id", "property", "value")


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, '{EX}imported' AS property, s_name AS value FROM supplier")
def c8_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context that imports another, and overrides one of its terms."""
    remote = {"http://example.org/base-context": '{"@context": {"name": "' + EX + 'imported", "size": "http://example.org/no"}}'}
    local = F.struct(F.lit(1.1).alias("@version"), F.lit("http://example.org/base-context").alias("@import"), F.lit(EX + "size").alias("size"))
    json = F.struct(local.alias("@context"), _id("supplier", "s_suppkey").alias("@id"), F.col("s_name").alias("name"))
    return documents.to_nodes(_doc(spark, sf_dir, "supplier", F.col("s_suppkey"), json), remote=remote).select("doc_id", "property", "value")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN 'protected term redefinition' END AS error FROM supplier")
def c19_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A protected term may be defined again as it was, and not otherwise."""
    context = {"name": {"@id": EX + "name", "@protected": True}}
    again = F.when(F.col("s_suppkey") % 2 == 0, EX + "other").otherwise(EX + "name")
    json = F.struct(F.struct(again.alias("name")).alias("@context"), _id("supplier", "s_suppkey").alias("@id"), F.col("s_name").alias("name"))
    return documents.apply(_doc(spark, sf_dir, "supplier", F.col("s_suppkey"), json), "expand", expandContext=context).select("doc_id", "error")


_BROKEN = ["'loading document failed'", "'invalid @id value'", "'ld.TooDeep'", "'invalid value object'", "NULL"]


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS doc_id, [{', '.join(_BROKEN)}][1 + p_partkey % 5] AS error FROM part")
def x_bad_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are no JSON, break the rules, or are nested a thousand levels deep cost their own row only."""
    texts = ["no JSON", '{"@id": 5}', '{"a":' * 1000 + "1" + "}" * 1000, '{"a": {"@value": 1, "x": 2}}', '{"@id": "urn:p", "a": 1}']
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.element_at(F.array(*map(F.lit, texts)), (1 + F.col("p_partkey") % 5).cast("int")).alias("json"))
    return documents.to_nodes(docs, expandContext={"@vocab": EX}).select("doc_id", "error")


_EVENTS = {
    "reserved term": '{"@context": {"@odd": "urn:x"}, "@id": "urn:p", "urn:a": 1}', "relative @id reference": '{"@id": "relative", "urn:a": 1}', "relative @type reference": '{"@id": "urn:p", "@type": "relative"}',
    "reserved @id value": '{"@id": "@odd", "urn:a": 1}', "free-floating scalar": '["scalar"]', "null @value value": '{"@id": "urn:p", "urn:a": [{"@value": null}, 1]}', "object with only @id": '{"@id": "urn:p"}',
    "invalid property": '{"@id": "urn:p", "a": 1}', "invalid @language value": '{"@id": "urn:p", "urn:a": {"@value": "x", "@language": "a b"}}', "object with only @language": '{"@id": "urn:p", "urn:a": {"@language": "en"}}',
}


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS doc_id, {list(_EVENTS)}[1 + p_partkey % {len(_EVENTS)}] AS code FROM part")
def x_event_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event that each loss of data raises."""
    texts = F.array(*map(F.lit, _EVENTS.values()))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.element_at(texts, (1 + F.col("p_partkey") % len(_EVENTS)).cast("int")).alias("json"))
    return documents.apply(docs, "expand").select("doc_id", F.element_at("events", 1).alias("code"))


__all__ = ["oracle_sql", "queries"]
