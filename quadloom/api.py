"""The processor: every verb over one document (plain Python values), and over DataFrames of documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Generator
from dataclasses import replace

from quadloom.model import canon, context, framing, nodes, rdf
from quadloom.model.compact import Compactor, Style, envelope
from quadloom.model.errors import Events, LinkedDataError, log_handler, safe_handler, strict_handler
from quadloom.model.expand import Options, expand
from quadloom.model.terms import aslist, copied
from quadloom.sources import loaders

NQUADS = "application/n-quads"
_REMOVED = {"compactionMap", "expansionMap"}


class Processor:
    """One instance with its own document loader, RDF parsers and cache of contexts.

    Options are keyword arguments with the names that the specification's API
    uses: base, expandContext, keepFreeFloatingNodes, processingMode, safe,
    eventHandler, compactArrays, compactToRelative, graph, skipExpansion, embed,
    explicit, requireAll, omitDefault, omitGraph, pruneBlankNodeIdentifiers,
    format, rdfParser, useRdfType, useNativeTypes, rdfDirection,
    produceGeneralizedRdf, mergeNodes, canonizeOptions, documentLoader, issuer.
    """

    safe_event_handler = staticmethod(safe_handler)
    strict_event_handler = staticmethod(strict_handler)
    log_event_handler = staticmethod(log_handler)

    def __init__(self, document_loader: Callable[[str], dict] | None = None):
        self.document_loader = document_loader
        self.parsers: dict[str, Callable[[str], list]] = {NQUADS: rdf.parse_nquads}
        self._resolvers: dict[int, context.Resolver] = {}
        self._patterns: dict[tuple, tuple[list, list[dict]]] = {}

    # loading

    def use_document_loader(self, kind: str, *args: object, **kwargs: object) -> None:
        self.document_loader = loaders.create(kind, *args, **kwargs)

    def register_rdf_parser(self, content_type: str, parser: Callable[[object], list]) -> None:
        self.parsers[content_type] = parser

    def unregister_rdf_parser(self, content_type: str) -> None:
        self.parsers.pop(content_type, None)

    def get(self, url: str, **o: object) -> dict:
        """The remote document at a URL: {contextUrl, documentUrl, document}."""
        load = o.get("documentLoader") or self.document_loader
        if load is None:
            raise LinkedDataError("no document loader is set", "ld.LoadDocumentError", "loading document failed", url=url)
        try:
            found = dict(load(url))
            if found.get("document") is None:
                raise LinkedDataError("no remote document", "ld.NullRemoteDocument")
            if isinstance(found["document"], str):
                found["document"] = json.loads(found["document"])
        except Exception as e:
            raise LinkedDataError(f"{url} could not be loaded", "ld.LoadDocumentError", "loading document failed", url=url) from e
        return found

    def _resolver(self, o: dict) -> context.Resolver:
        load = o.get("documentLoader") or self.document_loader
        found = self._resolvers.get(id(load))
        return found if found is not None else self._resolvers.setdefault(id(load), context.Resolver(load))

    def _events(self, o: dict, safe: bool = False) -> Events:
        for name in _REMOVED & o.keys():
            raise LinkedDataError(f"{name} is not supported; use safe or eventHandler", "ld.OptionsError")
        return o["_events"] if "_events" in o else Events(o.get("safe", safe), o.get("eventHandler"))

    def _mode(self, o: dict) -> str | None:
        return o.get("processingMode")

    # verbs

    def expand(self, document: object, *, _frame: bool = False, **o: object) -> list:
        events = self._events(o)
        base, context_url = o.get("base"), None
        if isinstance(document, str):
            found = self.get(document, **o)
            document, context_url = found["document"], found.get("contextUrl")
            base = base or found.get("documentUrl") or ""
        outer = o.get("expandContext")
        return expand(document, Options(base or "", _frame, o.get("keepFreeFloatingNodes", False), outer, self._mode(o), resolver=self._resolver(o)), events, context_url)

    def process_context(self, active: context.Context | None, local: object, **o: object) -> context.Context:
        """The active context after a local one."""
        active = active or context.initial(o.get("base", ""), self._mode(o))
        return context.process(active, local, base=o.get("base"), resolver=self._resolver(o), events=self._events(o))

    def compact(self, document: object, ctx: object, **o: object) -> object:
        if ctx is None:
            raise LinkedDataError("the context must not be null", "ld.CompactError", "invalid local context")
        if document is None:
            return None
        o = {**o, "_events": self._events(o)}
        base = o.get("base") or (document if isinstance(document, str) else "")
        expanded = document if o.get("skipExpansion") else self.expand(document, **{**o, "base": base})
        return self._compacted(expanded, ctx, base, o)

    def _compacted(self, expanded: object, ctx: object, base: str, o: dict, graph: bool | None = None) -> object:
        relative = o.get("compactToRelative", True)
        active = self.process_context(None, ctx, **{**o, "base": base})
        if not relative:
            active = replace(active, base=None)
        style = Style(o.get("compactArrays", True), relative, self._resolver(o), base or None)
        worker = Compactor(style, o["_events"])
        got = worker.element(active, None, expanded)
        return envelope(got, context.tidy(copied(ctx)), active, worker, graph=o.get("graph", False) if graph is None else graph)

    def flatten(self, document: object, ctx: object = None, **o: object) -> object:
        o = {**o, "_events": self._events(o)}
        flat = nodes.flatten(self.expand(document, **o), o.get("issuer"))
        return flat if ctx is None else self._compacted(flat, ctx, o.get("base") or "", o, graph=True)

    def frame(self, document: object, frame: object, **o: object) -> object:
        steps = self.frame_steps(document, frame, **o)
        while True:
            try:
                next(steps)
            except StopIteration as end:
                return end.value

    def frame_steps(self, document: object, frame: object, **o: object) -> Generator[None, None, object]:
        """`frame`, which stops after each of its stages, so that a caller can take many documents through one stage after the other."""
        o = {**o, "_events": self._events(o)}
        if isinstance(frame, str):
            found = self.get(frame, **o)
            frame = found["document"]
            if found.get("contextUrl"):
                frame = {**frame, "@context": [*aslist(frame.get("@context", {})), found["contextUrl"]]}
        ctx = frame.get("@context", {}) if isinstance(frame, dict) else {}
        active = self.process_context(None, ctx, **o)
        is_11 = not active.is_10
        expanded = self.expand(document, **o)
        yield
        pattern = self._pattern(frame, o)
        merged = not any(active.expand(k, vocab=True) == "@graph" for k in frame)
        flags = framing.Flags(o.get("embed", "@once"), o.get("explicit", False), o.get("requireAll", False), o.get("omitDefault", False))
        trees = framing.frame_nodes(nodes.node_map(expanded), pattern or [{}], flags, merged=merged, is_11=is_11, prune=o.get("pruneBlankNodeIdentifiers", is_11))
        yield
        out = self._compacted(trees, ctx, o.get("base") or "", o, graph=not o.get("omitGraph", is_11))
        return framing.drop_nulls(out)

    def _pattern(self, frame: object, o: dict) -> list:
        """A frame's expansion, and its events, which are sent each time. It is remembered, as framing does not change it."""
        o = {**o, "keepFreeFloatingNodes": True}
        try:
            key = (context.image([frame, o.get("expandContext"), o.get("base"), self._mode(o)]), id(self._resolver(o)))
        except ValueError:
            return self.expand(frame, _frame=True, **o)
        if key not in self._patterns:
            own = Events()
            try:
                pattern = self.expand(frame, _frame=True, **{**o, "_events": own})
            finally:
                o["_events"].resend(own.log)
            if len(self._patterns) >= context.MEMO:
                self._patterns.clear()
            self._patterns[key] = (pattern, own.log)
        else:
            o["_events"].resend(self._patterns[key][1])
        return self._patterns[key][0]

    def link(self, document: object, ctx: object, **o: object) -> object:
        """The document as objects that refer to each other directly, cycles included. For DataFrames, use node and edge tables."""
        flat = self.flatten(document, ctx or {}, **o)
        held = {}
        alias = next((k for k, v in flat.items() if k != "@context" and isinstance(v, list)), "@graph") if isinstance(flat, dict) else "@graph"
        items = flat.get(alias, [flat]) if isinstance(flat, dict) else flat
        for item in items:
            if isinstance(item, dict) and "@id" in item:
                held[item["@id"]] = item
        for item in items:
            for key, value in list(item.items()):
                if key not in ("@id", "@type", "@context"):
                    linked = [held.get(v.get("@id"), v) if isinstance(v, dict) and "@id" in v else v for v in aslist(value)]
                    item[key] = linked if isinstance(value, list) else linked[0]
        return items[0] if len(items) == 1 else {"@context": ctx or {}, "@graph": items}

    def to_rdf(self, document: object, **o: object) -> object:
        """Quads as nested objects, or N-Quads text if a format is given."""
        o = {**o, "_events": self._events(o)}
        expanded = document if o.get("skipExpansion") else self.expand(document, **o)
        quads = rdf.to_quads(expanded, generalized=o.get("produceGeneralizedRdf", False), direction=o.get("rdfDirection"), events=o["_events"])
        if o.get("format"):
            if o["format"] != NQUADS:
                raise LinkedDataError(f"unknown format {o['format']}", "ld.UnknownFormat", format=o["format"])
            return rdf.to_nquads(quads)
        return [rdf.as_object(q) for q in quads]

    def from_rdf(self, dataset: object, **o: object) -> list:
        """The expanded document of N-Quads text, or of quads as nested objects."""
        kind = o.get("format") or (NQUADS if isinstance(dataset, str) else None)
        parser = o.get("rdfParser")
        if kind and not parser:
            if kind not in self.parsers:
                raise LinkedDataError(f"unknown format {kind}", "ld.UnknownFormat", format=kind)
            parser = self.parsers[kind]
        quads = parser(dataset) if parser else dataset
        quads = [rdf.of_object(q) if isinstance(q, dict) else q for q in quads]
        return rdf.from_quads(quads, native_types=o.get("useNativeTypes", False), rdf_type=o.get("useRdfType", False), direction=o.get("rdfDirection"), events=self._events(o))

    def canonize(self, document: object, **o: object) -> str:
        """Canonical N-Quads. Safe by default; canonizeOptions may hold algorithm, messageDigestAlgorithm, maxWorkFactor, maxDeepIterations and a dict canonicalIdMap to fill."""
        more = dict(o.pop("canonizeOptions", None) or {})
        if more.get("algorithm", "RDFC-1.0") not in ("RDFC-1.0", "URDNA2015"):
            raise LinkedDataError("unknown canonization algorithm", "ld.CanonizeError")
        if "inputFormat" in o:
            if o["inputFormat"] != NQUADS:
                raise LinkedDataError(f"unknown format {o['inputFormat']}", "ld.CanonizeError")
            quads = rdf.parse_nquads(document)
        else:
            o = {k: v for k, v in o.items() if k != "format"}
            events = self._events(o, safe=True)
            expanded = document if o.get("skipExpansion") else self.expand(document, **{**o, "_events": events})
            quads = rdf.to_quads(expanded, direction=o.get("rdfDirection"), events=events)
        text, names = canon.canonize(quads, more.get("messageDigestAlgorithm", "sha256").lower().replace("-", ""), work_factor=more.get("maxWorkFactor", 1), max_deep=more.get("maxDeepIterations", -1))
        if "canonicalIdMap" in more:
            more["canonicalIdMap"].update(names)
        return text

    normalize = canonize

    def create_node_map(self, document: object, **o: object) -> dict:
        return nodes.node_map(self.expand(document, **o), o.get("issuer")).merged()

    def merge(self, documents: list, ctx: object = None, **o: object) -> object:
        o = {**o, "_events": self._events(o)}
        flat = nodes.merge([self.expand(d, **o) for d in documents], o.get("mergeNodes", True), o.get("issuer"))
        return flat if ctx is None else self._compacted(flat, ctx, o.get("base") or "", o, graph=True)


class JsonLdProcessor:
    """The WebIDL surface: three verbs without options."""

    @staticmethod
    def compact(document: object, ctx: object) -> object:
        return Processor().compact(document, ctx)

    @staticmethod
    def expand(document: object) -> list:
        return Processor().expand(document)

    @staticmethod
    def flatten(document: object, ctx: object = None) -> object:
        return Processor().flatten(document)


def factory(document_loader: Callable[[str], dict] | None = None) -> Processor:
    return Processor(document_loader)


__all__ = ["NQUADS", "JsonLdProcessor", "Processor", "factory"]
