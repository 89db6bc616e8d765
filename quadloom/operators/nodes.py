"""Node maps over node-property tables: grouping, distinct values, merging, flattening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.schema import DEFAULT, NODE_COLUMNS
from quadloom.scratch import many_tasks

_VALUE = ["graph", "subject", "property", "kind", "value", "datatype", "language"]


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def distinct_values(nodes: DataFrame) -> DataFrame:
    """Each value of a property once, at its first position; lists are never equal, so all stay."""
    single = nodes.where("kind <> 'list'").groupBy(*_VALUE).agg(F.min("pos").alias("pos"))
    lists = nodes.where("kind = 'list'")
    return single.withColumn("items", F.lit(None).cast(lists.schema["items"].dataType)).select(NODE_COLUMNS).unionByName(lists.select(NODE_COLUMNS))


def grouped(nodes: DataFrame) -> DataFrame:
    """One row a node: graph, subject and its properties with their distinct values."""
    value = F.struct("pos", "kind", "value", "datatype", "language")
    each = distinct_values(nodes).groupBy("graph", "subject", "property").agg(F.array_sort(F.collect_list(value)).alias("values"))
    return each.groupBy("graph", "subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "values")))).alias("properties"))


def _sized(column: str) -> Column:
    """A text after its length, or a sign for null: texts one after the other are equal only if each is."""
    return F.coalesce(F.concat(F.length(column).cast("string"), F.lit(":"), F.col(column)), F.lit("-"))


_LIST = "4:list"


def node_sizes(nodes: DataFrame) -> DataFrame:
    """graph, subject, and how many properties and distinct values each node has; each list is a value of its own.

    Rows go to their node's task once, whole, and are counted there in order: a sort spills where an
    aggregate on either side of a shuffle would hold all rows that it has seen.
    """
    # two columns are shuffled: what is alike in most rows is one run of text, which compresses well
    row = F.concat(*map(_sized, ("graph", "property", "kind", "datatype", "language", "value"))).alias("_row")
    shown = F.concat(_sized("graph"), _sized("property"))
    rows = nodes.select("subject", row, F.length(shown).alias("_n")).repartition(many_tasks(nodes.sparkSession), "subject")
    # the hash only makes the sort fast; the subject itself decides
    rows = rows.withColumns({"_h": F.xxhash64("subject"), "_p": F.substr("_row", F.lit(1), F.col("_n"))})
    before = Window.partitionBy("_h", "subject").orderBy("_row")
    rows = rows.withColumns({"_p0": F.lag("_p").over(before), "_row0": F.lag("_row").over(before)})
    fresh = ~F.col("_p0").eqNullSafe(F.col("_p"))
    listed = F.substr("_row", F.col("_n") + 1, F.lit(len(_LIST))) == _LIST
    size = F.regexp_extract("_row", "^([0-9]+):", 1).cast("int")
    graph = F.substr("_row", F.length(size.cast("string")) + 2, size).alias("graph")
    each = rows.select("_h", graph, "subject", fresh.alias("p"), (listed | ~F.col("_row0").eqNullSafe(F.col("_row"))).alias("v"))
    return each.groupBy("_h", "graph", "subject").agg(F.count_if("p").alias("n_properties"), F.count_if("v").alias("n_values")).drop("_h")


def reversed_(nodes: DataFrame, prop: str, as_property: str) -> DataFrame:
    """References of a property as rows of the nodes they lead to: subject and object swapped."""
    refs = nodes.where((F.col("property") == prop) & (F.col("kind") == "ref"))
    swapped = refs.withColumns({"subject": F.col("value"), "value": F.col("subject"), "property": F.lit(as_property)})
    return swapped.select(NODE_COLUMNS)


def in_one_graph(nodes: DataFrame) -> DataFrame:
    """The nodes of all graphs as one graph, in which values may occur more than once."""
    return nodes.withColumn("graph", F.lit("@merged"))


def merged_graphs(nodes: DataFrame) -> DataFrame:
    """The nodes of all graphs as one graph."""
    return distinct_values(in_one_graph(nodes))


def isolated(nodes: DataFrame, source: Column) -> DataFrame:
    """Blank nodes renamed so that those of different sources stay apart."""

    def name(c: str) -> Column:
        return F.when(F.col(c).startswith("_:"), F.concat(F.lit("_:"), source.cast("string"), F.lit("-"), F.substring(c, 3, 1 << 30))).otherwise(F.col(c))

    value = F.when(F.col("kind") == "ref", name("value")).otherwise(F.col("value"))
    return nodes.withColumns({"graph": name("graph"), "subject": name("subject"), "value": value})


def merge(*parts: DataFrame) -> DataFrame:
    """Node tables of several documents as one: blank nodes apart, equal identifiers together."""
    return distinct_values(union(*(isolated(p, F.lit(i)) for i, p in enumerate(parts))))


def merge_first_wins(*parts: DataFrame) -> DataFrame:
    """As merge, but a node is taken whole from the first source that has it."""
    tagged = union(*(isolated(p, F.lit(i)).withColumn("_source", F.lit(i)) for i, p in enumerate(parts)))
    first = tagged.groupBy("graph", "subject").agg(F.min("_source").alias("_source"))
    return distinct_values(tagged.join(first, ["graph", "subject", "_source"]).drop("_source"))


def flatten(nodes: DataFrame) -> DataFrame:
    """The nodes of all documents as one list, each once with its distinct values. A node that is only mentioned has no rows, and so is not in it."""
    return distinct_values(nodes)


def subjects(nodes: DataFrame) -> DataFrame:
    """(graph, id, has_properties) of every node, those only referred to included."""
    own = nodes.select("graph", F.col("subject").alias("id"), F.lit(1).alias("said"))
    refs = nodes.where("kind = 'ref' AND property <> '@type'").select("graph", F.col("value").alias("id"), F.lit(0).alias("said"))
    return own.unionByName(refs).groupBy("graph", "id").agg((F.max("said") == 1).alias("has_properties"))


def relabelled(visits: DataFrame, order: list[str], by: list[str], name: str = "name", prefix: str = "_:b") -> DataFrame:
    """Each blank node of a document named by its first visit: visits has a row for each mention."""
    first = visits.groupBy(*by, name).agg(F.min(F.struct(*order)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_first")) - 1
    return first.select(*by, name, F.concat(F.lit(prefix), rank.cast("string")).alias("label"))


def single_use(mentions: DataFrame, by: list[str]) -> DataFrame:
    """Blank node identifiers that occur once: those a frame's output drops."""
    return mentions.groupBy(*by).agg(F.count("*").alias("n")).where("n = 1").drop("n")


def named_graphs(nodes: DataFrame) -> DataFrame:
    """graph and its number of nodes, for all but the default graph."""
    return nodes.where(F.col("graph") != DEFAULT).groupBy("graph").agg(F.count_distinct("subject").alias("n_nodes"))
