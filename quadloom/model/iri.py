"""IRIs: parts, resolution and relativization (RFC 3986)."""

from __future__ import annotations

import re
from os.path import commonprefix
from typing import NamedTuple

_PARTS = re.compile(r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)
_ABSOLUTE = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*|_):\S*$")
_DEFAULT_PORTS = {"http": ":80", "https": ":443"}


class Parts(NamedTuple):
    """A part that is absent is None; one that is present and empty is ``. The path is never None."""

    scheme: str | None
    authority: str | None
    path: str
    query: str | None
    fragment: str | None

    def text(self) -> str:
        out = f"{self.scheme}:" if self.scheme is not None else ""
        if self.authority is not None:
            out += f"//{self.authority}"
        out += self.path
        if self.query is not None:
            out += f"?{self.query}"
        return out + (f"#{self.fragment}" if self.fragment is not None else "")


def parse(iri: str) -> Parts:
    """The parts; the scheme's default port is taken away."""
    scheme, authority, path, query, fragment = _PARTS.match(iri).groups()
    port = _DEFAULT_PORTS.get(scheme or "")
    if authority is not None and port and authority.endswith(port):
        authority = authority[: -len(port)]
    return Parts(scheme, authority, path, query, fragment)


def is_absolute(iri: object) -> bool:
    return isinstance(iri, str) and bool(_ABSOLUTE.match(iri))


def remove_dot_segments(path: str) -> str:
    """`.` and `..` segments applied (RFC 3986, 5.2.4): segments go from an input to an output buffer, each with its slash.

    A leading slash stays, and a path that ends in such a segment ends in a slash; what is empty then is `/`.
    """
    rooted = path.startswith("/")
    source, out = path if rooted or not path else f"/{path}", ""
    while source:
        end = source.find("/", 1)
        segment, source = (source, "") if end < 0 else (source[:end], source[end:])
        if segment not in ("/.", "/.."):
            out += segment
            continue
        if segment == "/..":
            out = out[: max(out.rfind("/"), 0)]
        out += "" if source else "/"
    return out if rooted or len(out) < 2 else out[1:]


def resolve(base: str | None, iri: str) -> str:
    """An IRI reference against a base; unchanged if there is no base or it is absolute."""
    if base is None or ":" in iri:
        return iri
    b, r = parse(base), parse(iri)
    if r.authority is not None:
        return Parts(b.scheme, r.authority, remove_dot_segments(r.path), r.query, r.fragment).text()
    if not r.path:
        return Parts(b.scheme, b.authority, remove_dot_segments(b.path), b.query if r.query is None else r.query, r.fragment).text()
    path = r.path
    if not path.startswith("/"):
        folder = b.path[: b.path.rfind("/") + 1]
        if not folder and b.authority is not None:
            folder = "/"
        path = folder + path
    path = remove_dot_segments(path)
    return Parts(b.scheme, b.authority, path, r.query, r.fragment).text()


def relativize(base: str | None, iri: str) -> str:
    """The shortest reference (RFC 3986, 4.2) that resolves to the IRI against the base's folder; the IRI itself if scheme or authority differ."""
    if not base:
        return iri
    b, r = parse(base), parse(iri)
    if r.authority is None or (b.scheme, b.authority or "") != (r.scheme, r.authority):
        return iri
    here, there = remove_dot_segments(b.path), remove_dot_segments(r.path)
    tail = r._replace(scheme=None, authority=None, path="").text()
    if here == there and tail:
        return tail
    folder = here[: here.rfind("/", 0, len(commonprefix([here, there]))) + 1]  # the longest that has both
    return "../" * here.count("/", len(folder)) + there[len(folder) :] + tail or "./"
