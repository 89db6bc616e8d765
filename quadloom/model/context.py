"""Contexts: from JSON to an immutable mapping of terms to IRIs, and back from IRIs to terms."""

from __future__ import annotations

import json
import marshal
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property, lru_cache

from quadloom.model import iri as I
from quadloom.model.errors import Events, LinkedDataError, syntax
from quadloom.model.terms import KEYWORD_LIKE, LANGUAGE_TAG, aslist, copied, is_keyword, ordered, utf16

#: Contexts that may be fetched within one, one in another.
MAX_CONTEXT_URLS = 10
#: Terms that a context remembers the expansion of, and contexts that a resolver remembers; when full, all are forgotten.
MEMO = 1000


class _Unset:
    """Marks what a context does not say, where None says null."""

    def __repr__(self) -> str:
        return "UNSET"

    def __bool__(self) -> bool:
        return False

    def __reduce__(self):
        return "UNSET"


UNSET = _Unset()


@dataclass(frozen=True)
class Term:
    """What a term means. A null term has iri None."""

    iri: str | None
    reverse: bool = False
    type: str | None = None
    container: frozenset[str] = frozenset()
    language: object = UNSET
    direction: object = UNSET
    index: str | None = None
    nest: str | None = None
    context: object = UNSET
    base: str | None = None
    prefix: bool = False
    protected: bool = False

    def same(self, other: Term) -> bool:
        """Equal but for protection."""
        return replace(self, protected=False) == replace(other, protected=False)


@dataclass(frozen=True)
class Context:
    """An active context."""

    terms: dict[str, Term] = field(default_factory=dict, hash=False)
    base: str | None = None
    vocab: str | None = None
    language: str | None = None
    direction: str | None = None
    previous: Context | None = None
    mode: str = "json-ld-1.1"

    @property
    def is_10(self) -> bool:
        return self.mode == "json-ld-1.0"

    def revert(self) -> Context:
        return self.previous or self

    def container(self, term: str | None) -> frozenset[str]:
        found = self.terms.get(term)
        return found.container if found else frozenset()

    def value(self, term: str | None, key: str):
        """A term's type, language or direction; language and direction fall back to the context's."""
        found = self.terms.get(term)
        own = getattr(found, key) if found else UNSET
        if key == "type":
            return own or None
        return getattr(self, key) if own is UNSET else own

    def expand(self, value: object, vocab: bool = False, document: bool = False, events: Events | None = None) -> object:
        """A term, compact IRI or reference to an IRI or keyword; None if it is mapped to null."""
        if not vocab and isinstance(value, str) and value[:1] != "@" and value.partition(":")[0] not in self.terms and I.is_absolute(value):
            return value  # as most identifiers are
        if not vocab or not isinstance(value, str):
            return _Expansion(self, {}, {}, events).iri(value, vocab, document)
        known = self._known[document]
        try:
            return known[value]
        except KeyError:
            if len(known) >= MEMO:
                known.clear()
            got = known[value] = _Expansion(self, {}, {}, events).iri(value, vocab, document)
            return got

    @cached_property
    def _known(self) -> tuple[dict, dict]:
        """What terms expanded to, not as and as references of a document."""
        return {}, {}

    def coercion(self, term: str | None) -> tuple:
        """What a term expands to, and its type, language and direction."""
        known = self._coercions
        if term not in known:
            if len(known) >= MEMO:
                known.clear()
            known[term] = (self.expand(term, vocab=True), *(self.value(term, key) for key in ("type", "language", "direction")))
        return known[term]

    @cached_property
    def _coercions(self) -> dict:
        return {}

    @cached_property
    def aliases(self) -> dict[str, str]:
        """The names of keywords in this context, as compaction finds them."""
        return {}

    @cached_property
    def inverse(self) -> dict:
        """iri -> container -> '@language', '@type' or '@any' -> value -> term. Shorter and then lesser terms come first."""
        out: dict = {}
        default = f"{self.language or ''}_{self.direction}" if self.direction else self.language or "@none"
        default = default.lower()
        for name in sorted(self.terms, key=lambda t: (len(t), utf16(t))):
            term = self.terms[name]
            if term.iri is None:
                continue
            slot = out.setdefault(term.iri, {}).setdefault("".join(ordered(term.container)) or "@none", {"@language": {}, "@type": {}, "@any": {}})

            def put(kind: str, *values: str, slot: dict = slot, name: str = name) -> None:
                for value in values:
                    slot[kind].setdefault(value, name)

            put("@any", "@none")
            language, direction = term.language, term.direction
            if term.reverse:
                put("@type", "@reverse")
            elif term.type == "@none":
                put("@language", "@any")
                put("@type", "@any")
            elif term.type:
                put("@type", term.type)
            elif language is not UNSET and direction is not UNSET:
                if language and direction:
                    put("@language", f"{language}_{direction}".lower())
                else:
                    put("@language", language.lower() if language else f"_{direction}" if direction else "@null")
            elif language is not UNSET:
                put("@language", (language or "@null").lower())
            elif direction is not UNSET:
                put("@language", f"_{direction}" if direction else "@none")
            else:
                put("@language", default, "@none")
                put("@type", "@none")
        return out

    @cached_property
    def prefixes(self) -> list[tuple[str, str]]:
        """(iri, term) of the terms that may be prefixes, longest IRI first."""
        usable = [(t.iri, name) for name, t in self.terms.items() if t.iri and t.prefix]
        return sorted(usable, key=lambda x: (-len(x[0]), len(x[1]), utf16(x[1])))


_INITIAL = {"json-ld-1.0": Context(mode="json-ld-1.0"), "json-ld-1.1": Context()}


@lru_cache(maxsize=100)
def initial(base: str | None = None, mode: str | None = None) -> Context:
    return replace(_INITIAL[mode or "json-ld-1.1"], base=base)


class _Expansion:
    """IRI expansion while terms of a local context are still being defined."""

    def __init__(self, ctx: Context, local: dict, defined: dict[str, bool], events: Events | None, define: Callable[[str], None] | None = None):
        self.ctx, self.local, self.defined, self.events, self.define = ctx, local, defined, events, define

    def _need(self, term: str) -> None:
        if self.define and term in self.local and self.defined.get(term) is not True:
            self.define(term)

    def iri(self, value: object, vocab: bool = False, document: bool = False) -> object:
        if not isinstance(value, str) or is_keyword(value):
            return value
        if value[:1] == "@" and KEYWORD_LIKE.match(value):
            return None
        self._need(value)
        terms = self.ctx.terms
        if vocab and value in terms:
            return terms[value].iri
        at = value.find(":")
        if at > 0:
            prefix, suffix = value[:at], value[at + 1 :]
            if prefix == "_" or suffix.startswith("//"):
                return value
            self._need(prefix)
            if prefix in terms and terms[prefix].prefix and terms[prefix].iri is not None:
                return terms[prefix].iri + suffix
            if I.is_absolute(value):
                return value
        if vocab and self.ctx.vocab is not None:
            return self.ctx.vocab + value
        if document:
            return I.resolve(self.ctx.base, value)
        return value


class Resolver:
    """Fetches contexts by URL: a loader of (url) -> {'document', 'documentUrl'}, with a cache."""

    def __init__(self, loader: Callable[[str], dict] | None = None):
        self.loader, self.cache = loader, {}
        #: what `process` made of contexts -> (the context that was active, the result, events)
        self.memo: dict[tuple, tuple[Context, Context, list[dict]]] = {}

    def fetch(self, url: str, chain: tuple[str, ...], mode: str) -> tuple[object, str]:
        """(local context, its URL)."""
        if len(chain) > MAX_CONTEXT_URLS:
            code = "loading remote context failed" if mode == "json-ld-1.0" else "context overflow"
            raise LinkedDataError("maximum number of contexts exceeded", "ld.ContextUrlError", code, max=MAX_CONTEXT_URLS)
        if url in chain:
            code = "recursive context inclusion" if mode == "json-ld-1.0" else "context overflow"
            raise LinkedDataError(f"context {url} includes itself", "ld.ContextUrlError", code, url=url)
        if url not in self.cache:
            if self.loader is None:
                raise LinkedDataError(f"no document loader for {url}", "ld.LoadDocumentError", "loading document failed", url=url)
            try:
                found = self.loader(url)
            except Exception as e:
                raise LinkedDataError(f"context {url} could not be loaded", "ld.InvalidUrl", "loading remote context failed", url=url) from e
            document = found["document"]
            if isinstance(document, str):
                document = json.loads(document)
            if not isinstance(document, dict):
                raise LinkedDataError(f"{url} is not a JSON object", "ld.InvalidUrl", "invalid remote context", url=url)
            local = document.get("@context", {})
            if found.get("contextUrl"):
                local = [*aslist(local), found["contextUrl"]]
            self.cache[url] = (local, found.get("documentUrl") or url)
        return self.cache[url]


def process(
    active: Context, local: object, *, base: str | None = None, resolver: Resolver | None = None, events: Events | None = None,
    propagate: bool = True, override: bool = False, chain: tuple[str, ...] = (), validating: bool = False,
) -> Context:
    """The active context after a local one: null, a URL, an object, or a list of these, left to right.

    A resolver remembers the result for an active context (the same object) and an equal local one, and its events, which are sent each time.
    What it remembers is of a copy of the local context, as scoped contexts are parts of it.
    """
    events, resolver = events or Events(), resolver or Resolver()
    if not chain and not validating:
        return _remembered(active, local, base, resolver, events, propagate, override)
    return _processed(active, local, base, resolver, events, propagate, override, chain, validating)


def image(x: object) -> bytes:
    """Equal for JSON values that are equal in all, types and the order of keys included; a ValueError for what is no plain data."""
    return marshal.dumps(x, 2)


def _remembered(active: Context, local: object, base: str | None, resolver: Resolver, events: Events, propagate: bool, override: bool) -> Context:
    try:
        key = (id(active), image(local), base, propagate, override)  # the memo holds the active context, so that its id stays its own
    except ValueError:
        return _processed(active, copied(local), base, resolver, events, propagate, override, (), False)
    found = resolver.memo.get(key)
    if found is None:
        own = Events()
        try:
            result = _processed(active, copied(local), base, resolver, own, propagate, override, (), False)
        finally:
            events.resend(own.log)
        if len(resolver.memo) >= MEMO:
            resolver.memo.clear()
        resolver.memo[key] = (active, result, own.log)
        return result
    if found[2]:
        events.resend(found[2])
    return found[1]


def _processed(active: Context, local: object, base: str | None, resolver: Resolver, events: Events, propagate: bool, override: bool, chain: tuple[str, ...], validating: bool) -> Context:
    if isinstance(local, dict) and "@context" in local:
        local = local["@context"]
    items = aslist(local)
    if not items:
        return active
    if isinstance(items[0], dict) and isinstance(items[0].get("@propagate"), bool):
        propagate = items[0]["@propagate"]
    result = active
    if not propagate and result.previous is None:
        result = replace(result, previous=active)
    for item in items:
        if item is None:
            if not override and any(t.protected for t in result.terms.values()):
                raise syntax("invalid context nullification", "protected terms cannot be nullified")
            result = replace(initial(base, active.mode), previous=None if propagate else active)
        elif isinstance(item, str):
            url = I.resolve(base, item)
            found, at = resolver.fetch(url, chain, active.mode)
            result = process(result, found, base=at, resolver=resolver, events=events, propagate=True, override=override, chain=(*chain, url), validating=validating)
        elif isinstance(item, dict):
            result = _Definition(result, item, base, resolver, events, propagate, override, chain, validating).run()
        else:
            raise syntax("invalid local context")
        if not propagate and result.previous is None:
            result = replace(result, previous=active)
    return result


_CONTEXT_KEYS = ("@base", "@direction", "@import", "@language", "@propagate", "@protected", "@version", "@vocab")
_TERM_KEYS_10 = {"@container", "@id", "@language", "@reverse", "@type"}
_TERM_KEYS = _TERM_KEYS_10 | {"@context", "@direction", "@index", "@nest", "@prefix", "@protected"}
_CONTAINERS_10 = {"@index", "@language", "@list", "@set"}
_CONTAINERS = _CONTAINERS_10 | {"@graph", "@id", "@type"}
_GEN_DELIMS = tuple(":/?#[]@")


class _Definition:
    """One context object applied to an active context."""

    def __init__(self, active, local, base, resolver, events, propagate, override, chain, validating):
        self.active, self.local, self.base = active, local, base
        self.resolver, self.events, self.propagate, self.override = resolver, events, propagate, override
        self.chain, self.validating = chain, validating

    def run(self) -> Context:
        local, ctx = self.local, self.active
        if "@version" in local:
            if isinstance(local["@version"], bool) or local["@version"] != 1.1:
                raise syntax("invalid @version value", version=local["@version"])
            if ctx.is_10:
                raise LinkedDataError("@version 1.1 in 1.0 mode", "ld.ProcessingModeConflict", "processing mode conflict")
        if "@import" in local:
            local = self._imported(local)
        if "@base" in local and not self.chain:
            value = local["@base"]
            if value is None or isinstance(value, str) and I.is_absolute(value):
                ctx = replace(ctx, base=value)
            elif isinstance(value, str):
                ctx = replace(ctx, base=I.resolve(ctx.base or "", value))
            else:
                raise syntax("invalid base IRI", base=value)
        if "@vocab" in local:
            ctx = self._vocab(ctx, local["@vocab"])
        if "@language" in local:
            value = local["@language"]
            if value is not None and not isinstance(value, str):
                raise syntax("invalid default language")
            if value is not None and not LANGUAGE_TAG.match(value):
                self.events.emit("invalid @language value", language=value)
            ctx = replace(ctx, language=value and value.lower())
        if "@direction" in local:
            if ctx.is_10:
                raise syntax("invalid context member", "@direction in 1.0 mode")
            if local["@direction"] not in (None, "ltr", "rtl"):
                raise syntax("invalid base direction")
            ctx = replace(ctx, direction=local["@direction"])
        if "@propagate" in local:
            if ctx.is_10:
                raise syntax("invalid context entry", "@propagate in 1.0 mode")
            if not isinstance(local["@propagate"], bool):
                raise syntax("invalid @propagate value")
        self.local, self.default_protected = local, local.get("@protected", False)
        self.ctx = replace(ctx, terms=dict(ctx.terms))
        self.defined: dict[str, bool] = {}
        for term in local:
            if term not in _CONTEXT_KEYS:
                self._define(term)
        return replace(self.ctx)  # without what it remembers of terms that were not yet defined

    def _imported(self, local: dict) -> dict:
        value = local["@import"]
        if self.active.is_10:
            raise syntax("invalid context entry", "@import in 1.0 mode")
        if not isinstance(value, str):
            raise syntax("invalid @import value")
        url = I.resolve(self.base, value)
        found, _ = self.resolver.fetch(url, self.chain, self.active.mode)
        if isinstance(found, list):
            if len(found) != 1:
                raise syntax("invalid remote context", "an imported context must be one object")
            found = found[0]
        if not isinstance(found, dict):
            raise syntax("invalid remote context", "an imported context must be an object")
        if "@import" in found:
            raise syntax("invalid context entry", "an imported context must not import")
        return {**found, **local}

    def _vocab(self, ctx: Context, value: object) -> Context:
        if value is None:
            return replace(ctx, vocab=None)
        if not isinstance(value, str):
            raise syntax("invalid vocab mapping")
        if ctx.is_10 and not I.is_absolute(value):
            raise syntax("invalid vocab mapping", "@vocab must be absolute in 1.0 mode")
        found = ctx.expand(value, vocab=True, document=True)
        if not isinstance(found, str) or not (I.is_absolute(found) or found.startswith("_:")):
            self.events.emit("relative @vocab reference", vocab=found)
        return replace(ctx, vocab=found)

    def _expand(self, value: object, vocab: bool = True, document: bool = False) -> object:
        return _Expansion(self.ctx, self.local, self.defined, self.events, self._define).iri(value, vocab, document)

    def _define(self, name: str) -> None:
        state = self.defined.get(name)
        if state is True:
            return
        if state is False:
            raise syntax("cyclic IRI mapping", f"{name} is defined by itself")
        self.defined[name] = False
        if name == "@type":
            given = self.local[name]
            ok = isinstance(given, dict) and given and set(given) <= {"@container", "@id", "@protected"} and given.get("@container", "@set") in ("@set", ["@set"])
            if self.active.is_10 or not ok:
                raise syntax("keyword redefinition")
        elif is_keyword(name):
            raise syntax("keyword redefinition", f"{name} is a keyword")
        elif KEYWORD_LIKE.match(name):
            self.events.emit("reserved term", term=name)
            self.defined[name] = True
            return
        elif name == "":
            raise syntax("invalid term definition", "a term must not be empty")
        old = self.ctx.terms.pop(name, None)
        value = self.local[name]
        simple = value is None or isinstance(value, str)
        if simple:
            value = {"@id": value}
        if not isinstance(value, dict):
            raise syntax("invalid term definition")
        unknown = set(value) - (_TERM_KEYS_10 if self.active.is_10 else _TERM_KEYS)
        if unknown:
            raise syntax("invalid term definition", f"unknown keys: {sorted(unknown)}")
        term = self._term(name, value, simple)
        if term is None:
            if old is not None and old.protected and not self.override:
                raise syntax("protected term redefinition", f"{name} is protected")
            self.defined[name] = True
            return
        if old is not None and old.protected and not self.override:
            if not old.same(term):
                raise LinkedDataError(f"{name} is protected", "ld.SyntaxError", "protected term redefinition", term=name)
            term = replace(term, protected=True)
        self.ctx.terms[name] = term
        self.defined[name] = True

    def _term(self, name: str, value: dict, simple: bool) -> Term | None:
        colon = ":" in name[1:]
        out: dict = {"protected": self._protected(value)}
        if "@reverse" in value:
            given = value["@reverse"]
            if "@id" in value or "@nest" in value:
                raise syntax("invalid reverse property")
            if not isinstance(given, str):
                raise syntax("invalid IRI mapping", "@reverse must be a string")
            if KEYWORD_LIKE.match(given) and not is_keyword(given):
                self.events.emit("reserved @reverse value", reverse=given)
                return None
            found = self._expand(given)
            if not I.is_absolute(found):
                raise syntax("invalid IRI mapping", "@reverse must be an absolute IRI or blank node")
            out |= {"iri": found, "reverse": True}
        elif "@id" in value:
            given = value["@id"]
            if given is not None and not isinstance(given, str):
                raise syntax("invalid IRI mapping", "@id must be a string or null")
            if given is None:
                out["iri"] = None
            elif not is_keyword(given) and KEYWORD_LIKE.match(given):
                self.events.emit("reserved @id value", id=given)
                return None
            elif given != name:
                found = self._expand(given)
                if not (is_keyword(found) or I.is_absolute(found)):
                    raise syntax("invalid IRI mapping", f"@id of {name} is not an IRI or keyword")
                if found == "@context":
                    raise syntax("invalid keyword alias", "@context must not be aliased")
                if ":" in name[1:-1] or "/" in name:
                    again = _Expansion(self.ctx, {k: v for k, v in self.local.items() if k != name}, {**self.defined, name: True}, None, self._define).iri(name, True)
                    if again != found:
                        raise syntax("invalid IRI mapping", f"{name} must expand to itself")
                out |= {"iri": found, "prefix": simple and not colon and "/" not in name and found.endswith(_GEN_DELIMS)}
        if "iri" not in out:
            out["iri"] = self._implicit(name)
        if out["iri"] is None and "@id" in value and value["@id"] is None:
            return Term(iri=None, protected=out["protected"])
        self._typed(value, out)
        self._contained(name, value, out)
        self._rest(name, value, out, colon)
        return Term(**out)

    def _protected(self, value: dict) -> bool:
        given = value.get("@protected", self.default_protected)
        if not isinstance(given, bool):
            raise syntax("invalid @protected value")
        return given

    def _implicit(self, name: str) -> str:
        at = name.find(":", 1)
        if at > 0:
            prefix, suffix = name[:at], name[at + 1 :]
            if prefix in self.local:
                self._define(prefix)
            found = self.ctx.terms.get(prefix)
            if found and found.iri is not None:
                return found.iri + suffix
            return name
        if name == "@type":
            return name
        if self.ctx.vocab is not None:
            return self.ctx.vocab + name
        raise syntax("invalid IRI mapping", f"{name} has no @id and there is no @vocab")

    def _typed(self, value: dict, out: dict) -> None:
        if "@type" not in value:
            return
        given = value["@type"]
        if not isinstance(given, str):
            raise syntax("invalid type mapping")
        found = self._expand(given)
        if found in ("@json", "@none"):
            if self.active.is_10:
                raise syntax("invalid type mapping", f"{found} in 1.0 mode")
        elif found not in ("@id", "@vocab") and (not I.is_absolute(found) or str(found).startswith("_:")):
            raise syntax("invalid type mapping", "@type must be an absolute IRI or a keyword for one")
        out["type"] = found

    def _contained(self, name: str, value: dict, out: dict) -> None:
        if "@container" not in value:
            return
        given = value["@container"]
        if self.active.is_10 and (isinstance(given, list) or given not in _CONTAINERS_10):
            raise syntax("invalid container mapping")
        held = aslist(given)
        if not held or not all(isinstance(c, str) and c in _CONTAINERS for c in held):
            raise syntax("invalid container mapping")
        kinds = frozenset(held)
        rest = kinds - {"@set"}
        ok = len(kinds) == 1 or "@list" not in kinds and (
            "@graph" in kinds and rest - {"@graph", "@id", "@index"} == frozenset() and not {"@id", "@index"} <= kinds or "@graph" not in kinds and len(rest) == 1
        )
        if not ok:
            raise syntax("invalid container mapping", "these containers cannot be combined")
        if out.get("reverse") and not kinds <= {"@index", "@set"}:
            raise syntax("invalid reverse property", "a reverse property holds sets and index maps only")
        if "@type" in kinds:
            out.setdefault("type", "@id")
            if out["type"] not in ("@id", "@vocab"):
                raise syntax("invalid type mapping", "a type map needs @id or @vocab")
        out["container"] = kinds

    def _rest(self, name: str, value: dict, out: dict, colon: bool) -> None:
        if "@index" in value:
            given = value["@index"]
            if "@index" not in out.get("container", ()):
                raise syntax("invalid term definition", "@index without an index container")
            if not isinstance(given, str) or given.startswith("@"):
                raise syntax("invalid term definition", "@index must be a term")
            out["index"] = given
        if "@context" in value:
            out |= {"context": value["@context"], "base": self.base}
            if not self.validating:
                try:  # scoped contexts are checked where they are defined
                    process(self.ctx, value["@context"], base=self.base, resolver=self.resolver, events=Events(), override=True, chain=self.chain, validating=True)
                except LinkedDataError as e:
                    raise syntax("invalid scoped context", f"the context of {name} is invalid", cause=e.code) from e
        if "@language" in value and "@type" not in value:
            given = value["@language"]
            if given is not None and not isinstance(given, str):
                raise syntax("invalid language mapping")
            out["language"] = given and given.lower()
        if "@direction" in value and "@type" not in value:
            if value["@direction"] not in (None, "ltr", "rtl"):
                raise syntax("invalid base direction")
            out["direction"] = value["@direction"]
        if "@nest" in value:
            given = value["@nest"]
            if not isinstance(given, str) or given != "@nest" and given.startswith("@"):
                raise syntax("invalid @nest value")
            out["nest"] = given
        if "@prefix" in value:
            given = value["@prefix"]
            if colon or "/" in name:
                raise syntax("invalid term definition", "@prefix on a compact IRI")
            if not isinstance(given, bool):
                raise syntax("invalid @prefix value")
            if given and is_keyword(out["iri"]):
                raise syntax("invalid term definition", "a keyword cannot be a prefix")
            out["prefix"] = given
        elif out["iri"] and self.active.is_10 and not is_keyword(out["iri"]):
            out["prefix"] = True


def tidy(local: object) -> object:
    """A context as it goes into output: `@context` wrappers off, empty objects and single lists reduced."""
    while isinstance(local, dict) and "@context" in local:
        local = local["@context"]
    if isinstance(local, list):
        held = [c for c in local if not (isinstance(c, dict) and not c)]
        return held[0] if len(held) == 1 else held or None
    return None if isinstance(local, dict) and not local else local
