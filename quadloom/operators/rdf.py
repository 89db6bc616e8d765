"""Between node-property tables and quads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.iris import is_absolute
from quadloom.model import terms as T
from quadloom.schema import DEFAULT, NODE_COLUMNS, QUAD_COLUMNS
from quadloom.scratch import Scratch

def _null() -> Column:
    return F.lit(None).cast("string")


def _named(name: Column) -> Column:
    return is_absolute(name)


def to_quads(nodes: DataFrame, generalized: bool = False) -> DataFrame:
    """The quads of nodes. Relative subjects, predicates, graphs and objects are left out, as are blank predicates unless generalized. Lists become chains of cells."""
    graph = F.when(F.col("graph") == DEFAULT, "").otherwise(F.col("graph"))
    predicate = F.when(F.col("property") == "@type", T.RDF_TYPE).otherwise(F.col("property"))
    good = nodes.withColumns({"graph": graph, "predicate": predicate}).where(((F.col("graph") == "") | _named(F.col("graph"))) & _named(F.col("subject")) & _named(F.col("predicate")))
    if not generalized:
        good = good.where(~F.col("predicate").startswith("_:"))
    plain = good.where("kind <> 'list'").select("graph", "subject", "predicate", _object_kind(F.col("kind"), F.col("value")).alias("kind"), F.col("value").alias("object"), "datatype", "language")
    plain = plain.where((F.col("kind") == "literal") | _named(F.col("object")))
    lists = good.where("kind = 'list'")
    return plain.select(QUAD_COLUMNS).unionByName(_cells(lists))


def _object_kind(kind: Column, value: Column) -> Column:
    return F.when(kind == "ref", F.when(value.startswith("_:"), "blank").otherwise("iri")).otherwise("literal")


def cell_name(i: Column) -> Column:
    """The blank node of the i-th cell of a list, from its place in the node."""
    return F.concat(F.lit("_:l"), F.substring(F.sha1(F.concat_ws("\x1f", "graph", "subject", "predicate", F.col("pos").cast("string"))), 1, 24), F.lit("-"), i.cast("string"))


def _cells(lists: DataFrame) -> DataFrame:
    """Head, rdf:first and rdf:rest of each list: its length is known in the row, so the next cell needs no window."""
    n = F.size("items")
    head = F.struct(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.when(n > 0, "blank").otherwise("iri").alias("k"), F.when(n > 0, cell_name(F.lit(0))).otherwise(F.lit(T.RDF_NIL)).alias("o"), _null().alias("d"), _null().alias("l"))

    def first(x: Column, i: Column) -> Column:
        return F.struct(cell_name(i).alias("s"), F.lit(T.RDF_FIRST).alias("p"), _object_kind(x["kind"], x["value"]).alias("k"), x["value"].alias("o"), x["datatype"].alias("d"), x["language"].alias("l"))

    def rest(x: Column, i: Column) -> Column:
        more = i + 1 < n
        return F.struct(cell_name(i).alias("s"), F.lit(T.RDF_REST).alias("p"), F.when(more, "blank").otherwise("iri").alias("k"), F.when(more, cell_name(i + 1)).otherwise(F.lit(T.RDF_NIL)).alias("o"), _null().alias("d"), _null().alias("l"))

    each = lists.select("graph", F.explode(F.concat(F.array(head), F.transform("items", first), F.transform("items", rest))).alias("q"))
    return each.select("graph", F.col("q.s").alias("subject"), F.col("q.p").alias("predicate"), F.col("q.k").alias("kind"), F.col("q.o").alias("object"), F.col("q.d").alias("datatype"), F.col("q.l").alias("language")).select(QUAD_COLUMNS)


def from_quads(quads: DataFrame, rdf_type: bool = False) -> DataFrame:
    """Node-property rows of quads, list cells as they are. Duplicate quads stay duplicate values."""
    graph = F.when(F.coalesce(F.col("graph"), F.lit("")) == "", DEFAULT).otherwise(F.col("graph"))
    is_type = (F.col("predicate") == T.RDF_TYPE) & (F.col("kind") != "literal") if not rdf_type else F.lit(False)
    return quads.select(
        graph.alias("graph"), "subject", F.when(is_type, "@type").otherwise(F.col("predicate")).alias("property"), F.lit(0).alias("pos"),
        F.when(F.col("kind") == "literal", "value").otherwise("ref").alias("kind"), F.col("object").alias("value"), "datatype", "language",
        F.lit(None).cast("array<struct<kind:string,value:string,datatype:string,language:string>>").alias("items"),
    ).select(NODE_COLUMNS)


def rebuilt_lists(quads: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(graph, subject, predicate, items) of the well-formed lists in quads: items in order.

    A cell is well formed if it is a blank node that one quad of all graphs leads
    to and that has one first, one rest and nothing else. Cells find the end of
    their list by pointer doubling, so a list of n cells takes log2(n) joins, and
    no list is walked by one task.
    """
    work = Scratch(quads.sparkSession, "lists")
    uses = quads.where("kind = 'blank'").groupBy(F.col("object").alias("cell")).agg(F.count("*").alias("uses"))
    shape = quads.where(F.col("subject").startswith("_:")).groupBy("graph", F.col("subject").alias("cell")).agg(
        F.sum((F.col("predicate") == T.RDF_FIRST).cast("int")).alias("firsts"), F.sum((F.col("predicate") == T.RDF_REST).cast("int")).alias("rests"),
        F.sum((~F.col("predicate").isin(T.RDF_FIRST, T.RDF_REST) & ~((F.col("predicate") == T.RDF_TYPE) & (F.col("object") == T.RDF_LIST))).cast("int")).alias("others"),
        F.max(F.when(F.col("predicate") == T.RDF_FIRST, F.struct("kind", F.col("object").alias("value"), "datatype", "language"))).alias("item"),
        F.max(F.when(F.col("predicate") == T.RDF_REST, F.col("object"))).alias("next"),
    )
    cells = work.write("cells", shape.where("firsts = 1 AND rests = 1 AND others = 0").join(uses.where("uses = 1"), "cell").select("graph", "cell", "item", "next"))
    # to: where the pointer leads, far: over how many cells
    state = work.write("0", cells.select("graph", "cell", F.col("next").alias("to"), F.lit(1).alias("far")))
    for step in range(1, max_rounds + 1):
        ahead = state.select("graph", F.col("cell").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"))
        state = work.write(str(step), state.join(ahead, ["graph", "to"], "left").select("graph", "cell", F.coalesce("to2", "to").alias("to"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("to2").isNotNull().alias("moved")))
        work.drop(str(step - 1))
        if not state.where("moved").limit(1).count():
            break
        state = state.drop("moved")
    ended = state.where(F.col("to") == T.RDF_NIL).select("graph", "cell", "far")
    # a list's head is a cell that something other than rdf:rest leads to
    heads = quads.where((F.col("kind") == "blank") & (F.col("predicate") != T.RDF_REST)).select("graph", "subject", "predicate", F.col("object").alias("head"))
    owned = work.write("owned", ended.withColumnRenamed("cell", "head").join(heads, ["graph", "head"]).select("graph", "subject", "predicate", "head", F.col("far").alias("n")))
    # each cell's head: the pointers of heads, doubled again, would do; cells of one list share the cell before rdf:nil
    last = ended.where("far = 1").select("graph", F.col("cell").alias("last"))
    chain = work.write("chain", _with_last(cells, last, work, max_rounds))
    of_head = owned.join(chain.select("graph", F.col("cell").alias("head"), "last"), ["graph", "head"])
    items = chain.join(ended, ["graph", "cell"]).join(cells.select("graph", "cell", "item"), ["graph", "cell"]).join(of_head.select("graph", "last", "subject", "predicate", "n"), ["graph", "last"]).where("far <= n")
    listed = items.groupBy("graph", "subject", "predicate", "last").agg(F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("o"), "item"))).alias("l"))
    empty = quads.where((F.col("object") == T.RDF_NIL) & (F.col("kind") == "iri") & (F.col("predicate") != T.RDF_REST)).select("graph", "subject", "predicate", F.array().cast("array<struct<kind:string,value:string,datatype:string,language:string>>").alias("items"))
    return listed.select("graph", "subject", "predicate", F.transform("l", lambda x: x["item"]).alias("items")).unionByName(empty)


def _with_last(cells: DataFrame, last: DataFrame, work: Scratch, max_rounds: int) -> DataFrame:
    """The last cell of each cell's list, by pointer doubling that stops one cell before rdf:nil."""
    state = work.write("l0", cells.select("graph", "cell", F.when(F.col("next") == T.RDF_NIL, F.col("cell")).otherwise(F.col("next")).alias("last")))
    for step in range(1, max_rounds + 1):
        ahead = state.select("graph", F.col("cell").alias("last"), F.col("last").alias("last2"))
        state = work.write(f"l{step}", state.join(ahead, ["graph", "last"]).select("graph", "cell", F.col("last2").alias("last"), (F.col("last2") != F.col("last")).alias("moved")))
        work.drop(f"l{step - 1}")
        if not state.where("moved").limit(1).count():
            break
        state = state.drop("moved")
    return state.join(last, ["graph", "last"], "left_semi").select("graph", "cell", "last")


def native_value(quads: DataFrame) -> DataFrame:
    """quads with `native` (JSON text of the native value, null if it stays text) and `rest_type` (the datatype that remains).

    An integer whose text is not canonical loses its type; strings keep xsd:string.
    """
    text, kind = F.col("object"), F.col("datatype")
    boolean = text.isin("true", "1", "false", "0")
    integer = text.rlike("^(0|-?[1-9][0-9]*)$")
    double = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    native = F.when((kind == T.XSD_BOOLEAN) & boolean, F.when(text.isin("true", "1"), "true").otherwise("false")).when((kind == T.XSD_INTEGER) & integer, text).when((kind == T.XSD_DOUBLE) & double, text)
    rest = F.when((F.col("kind") != "literal") | native.isNotNull() | F.col("language").isNotNull(), None).when(kind == T.XSD_INTEGER, None).otherwise(kind)
    return quads.withColumns({"native": native, "rest_type": rest})


def i18n(value: Column, language: Column, direction: Column) -> Column:
    """The datatype that carries a language and direction."""
    return F.concat(F.lit(T.I18N), F.lower(F.coalesce(language, F.lit(""))), F.lit("_"), direction)


__all__ = ["from_quads", "i18n", "native_value", "rebuilt_lists", "to_quads"]
