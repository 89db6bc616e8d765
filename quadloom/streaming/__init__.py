"""Verbs over streams. They keep no state: each row or document is mapped on its own, so any streaming source and sink will do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from quadloom.functions.literals import quad_text
from quadloom.operators import documents, rdf
from quadloom.plans import table


def table_quads(stream: DataFrame, mapped: table.Mapped) -> DataFrame:
    """The quads of a stream of table rows."""
    return rdf.to_quads(table.nodes(stream, mapped))


def documents_of(stream: DataFrame, verb: str, **options: object) -> DataFrame:
    """A stream of JSON documents under a verb of one document."""
    return documents.apply(stream, verb, **options)


def nquads_writer(quads: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends a stream of quads as N-Quads lines."""
    return quads.select(quad_text().alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)


__all__ = ["documents_of", "nquads_writer", "table_quads"]
