"""The test tables as linked data: one Mapped a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.model.terms import XSD
from quadloom.plans.table import Mapped, nodes

EX = "http://example.org/"
_ID = {"@type": "@id"}


def _term(name: str, **more: object) -> dict:
    return {"@id": EX + name, **more}


def _urn(kind: str, *columns: str):
    return F.concat(F.lit(f"urn:{kind}:"), F.concat_ws("-", *(F.col(c).cast("string") for c in columns)))


CONTEXTS: dict[str, dict] = {
    "region": {"name": EX + "name"},
    "nation": {"name": EX + "name", "region": _term("region", **_ID)},
    "customer": {"name": EX + "name", "balance": _term("balance", **{"@type": XSD + "double"}), "nation": _term("nation", **_ID), "segment": EX + "segment"},
    "supplier": {"name": EX + "name", "nation": _term("nation", **_ID)},
    "part": {"name": EX + "name", "brand": EX + "brand", "size": EX + "size", "price": _term("price", **{"@type": XSD + "decimal"})},
    "orders": {"customer": _term("customer", **_ID), "status": EX + "status", "date": _term("date", **{"@type": XSD + "dateTime"}), "priority": _term("priority", **{"@language": "en"})},
    "lineitem": {"part": _term("part", **_ID), "supplier": _term("supplier", **_ID), "flag": EX + "flag"},
    "events": {"user": _term("user", **_ID), "props": _term("props", **{"@type": "@json"})},
    "documents": {"text": EX + "text", "source": EX + "source"},
    "labels": {"quality": EX + "quality", "toxic": EX + "toxic"},
}


def mapped(name: str) -> Mapped:
    t = F.lit
    return {
        "region": lambda: Mapped(CONTEXTS[name], _urn("region", "r_regionkey"), [t(EX + "Region")], {"r_name": "name"}),
        "nation": lambda: Mapped(CONTEXTS[name], _urn("nation", "n_nationkey"), [t(EX + "Nation")], {"n_name": "name", "n_regionkey": "region"}, {"n_regionkey": "urn:region:"}),
        "customer": lambda: Mapped(CONTEXTS[name], _urn("customer", "c_custkey"), [t(EX + "Customer")], {"c_name": "name", "c_acctbal": "balance", "c_nationkey": "nation", "c_mktsegment": "segment"}, {"c_nationkey": "urn:nation:"}),
        "supplier": lambda: Mapped(CONTEXTS[name], _urn("supplier", "s_suppkey"), [t(EX + "Supplier")], {"s_name": "name", "s_nationkey": "nation"}, {"s_nationkey": "urn:nation:"}),
        "part": lambda: Mapped(CONTEXTS[name], _urn("part", "p_partkey"), [t(EX + "Part")], {"p_name": "name", "p_brand": "brand", "p_size": "size", "p_retailprice": "price"}),
        "orders": lambda: Mapped(CONTEXTS[name], _urn("order", "o_orderkey"), [t(EX + "Order")], {"o_custkey": "customer", "o_orderstatus": "status", "o_orderdate": "date", "o_orderpriority": "priority"}, {"o_custkey": "urn:customer:"}),
        "lineitem": lambda: Mapped(CONTEXTS[name], _urn("line", "l_orderkey", "l_linenumber"), [], {"l_partkey": "part", "l_suppkey": "supplier", "l_returnflag": "flag"}, {"l_partkey": "urn:part:", "l_suppkey": "urn:supplier:"}),
        "events": lambda: Mapped(CONTEXTS[name], _urn("event", "event_id"), [F.concat(t(EX + "event/"), F.col("event_type"))], {"user_id": "user", "props": "props"}, {"user_id": "urn:user:"}),
        "documents": lambda: Mapped(CONTEXTS[name], _urn("doc", "doc_id"), [], {"text": "text", "source": "source"}, {}, {"text": "lang"}),
        "labels": lambda: Mapped(CONTEXTS[name], _urn("doc", "doc_id"), [], {"quality": "quality", "toxic": "toxic"}),
    }[name]()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The node-property rows of tables, together."""
    out = None
    for name in names:
        part = nodes(table(spark, sf_dir, name), mapped(name))
        out = part if out is None else out.unionByName(part)
    return out
