"""The verbs of the processor over a column of JSON documents, one document a row.

Contexts, frames and remote documents are given when the plan is built: they are
resolved on the driver (they are few) and travel with the function. Documents are
first dealt to all cores (see `_dealt`); a document that fails keeps its row, with the
error's code, and nulls for the rest: `loading document failed` if it is no JSON, and
`ld.TooDeep` if it is nested deeper than `MAX_DEPTH`, or too deep for a verb.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Generator, Iterator
from functools import partial
from types import GeneratorType

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.api import NQUADS, Processor
from quadloom.model import rdf
from quadloom.model.errors import Events, LinkedDataError
from quadloom.model.nodes import node_map
from quadloom.model.terms import aslist, is_keyword, ordered
from quadloom.schema import NODES, QUADS
from quadloom.scratch import bounded_batches, many_tasks
from quadloom.sources import loaders

RESULT = "doc_id string, result string, events array<string>, error string"

VERBS: dict[str, Callable[[Processor, object, dict], object]] = {
    "expand": lambda p, d, o: p.expand(d, **o),
    "compact": lambda p, d, o: p.compact(d, o.pop("context"), **o),
    "flatten": lambda p, d, o: p.flatten(d, o.pop("context", None), **o),
    "frame": lambda p, d, o: p.frame_steps(d, o.pop("frame"), **o),
    "to_rdf": lambda p, d, o: p.to_rdf(d, **{"format": NQUADS, **o}),
    "from_rdf": lambda p, d, o: p.from_rdf(d, **o),
    "canonize": lambda p, d, o: p.canonize(d, **o),
    "node_map": lambda p, d, o: p.create_node_map(d, **o),
}
_TEXT_IN, _TEXT_OUT = {"from_rdf"}, {"to_rdf", "canonize"}
_as_json = json.JSONEncoder(ensure_ascii=False).encode


def loader_table(df: DataFrame, url: str = "url", document: str = "document", limit: int = 10_000) -> dict[str, str]:
    """Remote documents of a small table, once each, for `remote`; more than `limit` are refused."""
    rows = df.select(url, document).dropDuplicates([url]).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} remote documents")
    return {r[0]: r[1] for r in rows}


#: Levels of objects and arrays in a document.
MAX_DEPTH = 500
#: Strings and brackets of JSON.
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)


def _loaded(raw: str) -> object:
    """The document of a JSON text whose brackets nest no deeper than MAX_DEPTH."""
    if raw.count("{") + raw.count("[") > MAX_DEPTH:
        depth = 0
        for mark in _MARKS.finditer(raw):
            depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(mark[0], 0)
            if depth > MAX_DEPTH:
                raise LinkedDataError(f"deeper than {MAX_DEPTH} levels", "ld.TooDeep")
    return json.loads(raw)


def _attempt(run: Callable[[], object]) -> tuple[object, str | None]:
    """The result, or None and the error's code."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20 * MAX_DEPTH))
    try:
        return run(), None
    except LinkedDataError as e:
        return None, e.code or e.name
    except RecursionError:
        return None, "ld.TooDeep"
    except ValueError:
        return None, "loading document failed"
    finally:
        sys.setrecursionlimit(limit)


#: Documents, and characters of their texts, that go through the stages of a verb together. A longer text goes alone.
TOGETHER, TOGETHER_CHARS = 64, 1 << 18


def _groups(batch: pa.RecordBatch) -> Iterator[list[tuple[str, str | None]]]:
    """The (identifier, text) of a batch in its order, in such groups."""
    group: list = []
    chars = 0
    for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        size = len(raw or "")
        if group and (len(group) == TOGETHER or chars + size > TOGETHER_CHARS):
            yield group
            group, chars = [], 0
        group.append((name, raw))
        chars += size
    if group:
        yield group


def _resumed(steps: Generator) -> object:
    """The steps where there are more of them, else their result."""
    try:
        next(steps)
    except StopIteration as end:
        return end.value
    return steps


def _together(runs: list[Callable[[], object]]) -> list[tuple[object, str | None]]:
    """Each result, or None and the error's code. Where a run gives steps, all take one before any takes the next.

    The stages of a verb are much code; one that runs for many small documents in turn stays in
    the core's cache. The stages of `q17_named_graph` take 63 instead of 90 microseconds a document.
    """
    done = [_attempt(run) for run in runs]
    going = [i for i, (got, _) in enumerate(done) if isinstance(got, GeneratorType)]
    while going:
        for i in going:
            steps = done[i][0]
            done[i] = _attempt(lambda: _resumed(steps))  # noqa: B023
        going = [i for i in going if isinstance(done[i][0], GeneratorType)]
    return done


def _dealt(docs: DataFrame) -> DataFrame:
    """The documents over all cores, by a hash of identifier and text.

    Small tables come as one file, often as one row group, which one task reads; a
    document takes hundreds of times as long to map as to read, so that task would take all
    the time. Only a document repeated with its identifier meets itself again. Streams stay as they come.
    """
    if docs.isStreaming:
        return docs
    return docs.repartition(many_tasks(docs.sparkSession), *docs.columns)


def apply(docs: DataFrame, verb: str, *, doc_id: str = "doc_id", text: str = "json", remote: dict[str, str] | None = None, **options: object) -> DataFrame:
    """doc_id, result (JSON or N-Quads text), event codes and error code of each document under a verb."""
    run_verb = VERBS[verb]
    bounded_batches(docs.sparkSession)

    def one(processor: Processor, raw: str | None, events: Events) -> object:
        return None if raw is None else run_verb(processor, raw if verb in _TEXT_IN else _loaded(raw), {**options, "_events": events})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = Processor(loaders.table((remote or {}).items()))
        for batch in batches:
            rows = []
            for group in _groups(batch):
                events = [Events(options.get("safe", verb == "canonize")) for _ in group]
                runs = [partial(one, processor, raw, own) for (_, raw), own in zip(group, events, strict=True)]
                for (name, raw), own, (got, error) in zip(group, events, _together(runs), strict=True):
                    text_out = got if error or raw is None or verb in _TEXT_OUT else _as_json(got)
                    rows.append((name, text_out, own.codes, error))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.list_(pa.string()), pa.string()), strict=True)], names=["doc_id", "result", "events", "error"])

    return _dealt(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string"))).mapInArrow(run, RESULT)


def to_nodes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "json", remote: dict[str, str] | None = None, **options: object) -> DataFrame:
    """Node-property rows of documents, with their doc_id; blank nodes are named `_:<doc_id>-b0` and so on.

    A document that fails has one row: its doc_id, the code in `error`, and nulls.
    """
    bounded_batches(docs.sparkSession)

    def steps(processor: Processor, name: str, raw: str) -> Generator[None, None, list[dict]]:
        expanded = processor.expand(_loaded(raw), **options)
        yield
        return list(_rows(name, expanded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = Processor(loaders.table((remote or {}).items()))
        for batch in batches:
            out = []
            for group in _groups(batch):
                group = [(name, raw) for name, raw in group if raw is not None]
                for (name, _), (rows, error) in zip(group, _together([partial(steps, processor, name, raw) for name, raw in group]), strict=True):
                    out += [{"doc_id": name, "error": error}] if error else rows
            yield pa.RecordBatch.from_pylist(out, schema=_NODE_ARROW)

    return _dealt(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string"))).mapInArrow(run, f"doc_id string, {NODES}, error string")


def well_formed(rows: DataFrame) -> DataFrame:
    """The rows of documents that did not fail, without `error`."""
    return rows.where("error IS NULL").drop("error")


_ITEM_ARROW = pa.struct([(c, pa.string()) for c in ("kind", "value", "datatype", "language")])
_NODE_ARROW = pa.schema(
    [("doc_id", pa.string()), ("graph", pa.string()), ("subject", pa.string()), ("property", pa.string()), ("pos", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("datatype", pa.string()), ("language", pa.string()), ("items", pa.list_(_ITEM_ARROW)), ("error", pa.string())]
)


def _rows(doc: str, expanded: list) -> Iterator[dict]:
    def own(name: str) -> str:
        return f"_:{doc}-{name[2:]}" if name.startswith("_:") else name

    def item(x: object) -> dict:
        if isinstance(x, dict) and "@value" in x:
            _, text, kind, language = rdf.literal(x)
            return {"kind": "value", "value": text, "datatype": kind, "language": language}
        return {"kind": "ref", "value": own(x["@id"]) if isinstance(x, dict) and "@id" in x else json.dumps(x), "datatype": None, "language": None}

    nodes = node_map(expanded)
    for graph in ordered(nodes.graphs):
        for name in ordered(nodes.graphs[graph]):
            node = nodes.graphs[graph][name]
            for prop in ordered(node):
                if is_keyword(prop) and prop != "@type":
                    continue
                for pos, x in enumerate(aslist(node[prop])):
                    base = {"doc_id": doc, "graph": own(graph), "subject": own(name), "property": own(prop), "pos": pos, "items": None}
                    if prop == "@type":
                        yield base | {"kind": "ref", "value": own(x), "datatype": None, "language": None}
                    elif isinstance(x, dict) and "@list" in x:
                        yield base | {"kind": "list", "value": None, "datatype": None, "language": None, "items": [item(v) for v in x["@list"]]}
                    else:
                        yield base | item(x)


def parse_quads(texts: DataFrame, *, doc_id: str = "doc_id", text: str = "nquads") -> DataFrame:
    """Quad rows, with their doc_id, of N-Quads documents; one that fails has one row, with the code in `error`."""
    bounded_batches(texts.sparkSession)

    def show(t: tuple) -> str:
        return "" if t[0] == "default" else f"_:{t[1]}" if t[0] == "blank" else t[1]

    def row(name: str, s: tuple, p: tuple, o: tuple, g: tuple) -> dict:
        kind, language = (o[2], o[3]) if o[0] == "literal" else (None, None)
        return {"doc_id": name, "graph": show(g), "subject": show(s), "predicate": show(p), "kind": o[0], "object": show(o), "datatype": kind, "language": language}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(c, pa.string()) for c in ("doc_id", "graph", "subject", "predicate", "kind", "object", "datatype", "language", "error")])
        for batch in batches:
            out = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, error = _attempt(lambda: [row(name, *quad) for quad in rdf.parse_nquads(raw or "")])  # noqa: B023
                out += [{"doc_id": name, "error": error}] if error else rows
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return _dealt(texts.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string"))).mapInArrow(run, f"doc_id string, {QUADS}, error string")
