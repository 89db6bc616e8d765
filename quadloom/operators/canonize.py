"""Canonical text of datasets, one for each value of a key column.

First-degree hashes are native. Datasets in which they tell all blank nodes
apart are named and written without Python; the rest, whose blank nodes need
n-degree hashes, run per dataset. The lines of one node, and those of one dataset, are one
string, and the names of one dataset are issued in one sequence: each must fit one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.functions.literals import quad_text
from quadloom.model import canon
from quadloom.model.errors import LinkedDataError
from quadloom.model.rdf import parse_nquads

_BLANKS = ("subject", "object", "graph")
#: Bits of the hash algorithms.
_BITS = {"sha256": 256, "sha384": 384}


def _bits(algorithm: str) -> int:
    if algorithm not in _BITS:
        raise LinkedDataError(f"unknown hash algorithm {algorithm}", "ld.InvalidAlgorithm", algorithm=algorithm)
    return _BITS[algorithm]


def _is_blank(name: str) -> Column:
    return F.coalesce(F.col(name).startswith("_:"), F.lit(False)) & (F.lit(True) if name != "object" else F.col("kind") != "literal")


def first_degree(quads: DataFrame, key: str, algorithm: str = "sha256") -> DataFrame:
    """key, node, hash of the node's sorted quads, in which it is `_:a` and other blank nodes `_:z`."""
    quads = quads.select(key, "graph", "subject", "predicate", "kind", "object", "datatype", "language").distinct()
    mentioned = F.array_distinct(F.filter(F.array(*[F.when(_is_blank(c), F.col(c)) for c in _BLANKS]), lambda x: x.isNotNull()))
    each = quads.withColumn("node", F.explode(mentioned))
    for c in _BLANKS:
        each = each.withColumn(f"_{c}", F.when(_is_blank(c), F.when(F.col(c) == F.col("node"), "_:a").otherwise("_:z")).otherwise(F.col(c)))
    shown = each.select(key, "node", F.col("_graph").alias("graph"), F.col("_subject").alias("subject"), "predicate", "kind", F.col("_object").alias("object"), "datatype", "language")
    lines = shown.select(key, "node", F.concat(quad_text(), F.lit("\n")).alias("line"))
    return lines.groupBy(key, "node").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "").cast("binary"), _bits(algorithm)).alias("hash"))


def names(quads: DataFrame, key: str, algorithm: str = "sha256") -> DataFrame:
    """key, node, name of the blank nodes of datasets in which no two have the same first-degree hash; others get null names."""
    hashes = first_degree(quads, key, algorithm)
    whole = Window.partitionBy(key)
    tied = hashes.withColumn("n", F.count("*").over(Window.partitionBy(key, "hash"))).withColumn("most", F.max("n").over(whole))
    rank = F.row_number().over(whole.orderBy("hash")) - 1
    return tied.select(key, "node", F.when(F.col("most") == 1, F.concat(F.lit("_:c14n"), rank.cast("string"))).alias("name"))


def canonize(quads: DataFrame, key: str, algorithm: str = "sha256") -> DataFrame:
    """key, nquads (canonical text by an algorithm: sha256 or sha384) and its SHA-256 as `hash`, of each dataset."""
    named = names(quads, key, algorithm)
    hard = named.where("name IS NULL").select(key).distinct()
    easy = quads.join(hard, key, "left_anti")
    for c in _BLANKS:
        found = named.where("name IS NOT NULL").select(key, F.col("node").alias(c), F.col("name").alias(f"_{c}"))
        easy = easy.join(found, [key, c], "left")
    for c in _BLANKS:
        easy = easy.withColumn(c, F.when(_is_blank(c), F.col(f"_{c}")).otherwise(F.col(c)))
    text = _text(easy.select(key, F.concat(quad_text(), F.lit("\n")).alias("line")).distinct(), key)
    rest = quads.join(hard, key, "left_semi").select(key, F.concat(quad_text(), F.lit("\n")).alias("line"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done, _ = canon.canonize(parse_nquads("".join(pdf["line"])), algorithm)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "nquads": [done]})

    kind = quads.schema[key].dataType.simpleString()
    slow = rest.groupBy(key).applyInPandas(run, f"{key} {kind}, nquads string")
    return text.unionByName(slow).withColumn("hash", F.sha2(F.col("nquads").cast("binary"), 256))


def _text(lines: DataFrame, key: str) -> DataFrame:
    return lines.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("line")), "").alias("nquads"))


__all__ = ["canonize", "first_degree", "names"]
