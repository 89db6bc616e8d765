"""URL filters: a trie over reversed host labels and then path segments.

A rule is `host/path` with a verdict, allow or block. It fits its host and all
subdomains if the URL's path starts with its path. The rule with the most host
labels wins, of those the one with the longest path; of a rule that is given
with both verdicts, block wins. URLs without a rule get the default verdict.

The trie is broadcast; the number of rules is checked against `MAX_RULES`, and
their bytes against `MAX_BYTES`, first.

Cases: a null URL, or one without `://`, has an empty host and path, and an
empty host fits no rule; an empty rule host is refused; repeated rows give
repeated rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.scratch import tune

MAX_RULES, MAX_BYTES = 1_000_000, 64 << 20
DEFAULT = "allow"
#: (verdict, rule) of the contract.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


class Trie:
    """Nodes are dicts of labels; under the key None hangs the host's path trie, whose nodes hold under None the lengths, longest first, and the rules of their last, open segments."""

    def __init__(self, rules: Iterable[tuple[str, str]], default: str = DEFAULT):
        self.root: dict = {}
        self.default = default
        for verdict, rule in rules:
            host, slash, rest = rule.partition("/")
            host = host.translate(_LOWER)
            if not host:
                raise ValueError(f"a rule without a host: {rule}")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = (slash + rest).split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            _, ends = node.setdefault(None, ([], {}))
            if ends.get(last, ("", ""))[0] != "block":
                ends[last] = (verdict, host + slash + rest)
        todo = [self.root]
        while todo:
            for child in todo.pop().values():
                if isinstance(child, tuple):
                    child[0][:] = sorted({len(last) for last in child[1]}, reverse=True)
                else:
                    todo.append(child)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """(rule, verdict)."""
        best, node = None, self.root
        if host:
            for label in reversed(host.split(".")):
                node = node.get(label)
                if node is None:
                    break
                if None in node:
                    best = self._under(node[None], path) or best
        return (best[1], best[0]) if best else (None, self.default)

    @staticmethod
    def _under(node: dict, path: str) -> tuple[str, str] | None:
        best, rest = None, path
        while True:
            lengths, ends = node.get(None, ((), {}))
            best = next((ends[rest[:n]] for n in lengths if rest[:n] in ends), best)
            segment, slash, rest = rest.partition("/")
            node = node.get(segment) if slash else None
            if node is None:
                return best


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    if len(rules) > MAX_RULES or sum(len(r) for _, r in rules) > MAX_BYTES:
        raise ValueError(f"more than {MAX_RULES} rules or {MAX_BYTES} bytes of them; split the list")
    tune(pages.sparkSession)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules, default))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split(u) for u in batch.column("url").to_pylist()]
            found = [trie.value.judge(h, p) for h, p in parts]
            cols = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in found], [v for _, v in found]]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in cols)], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def query(pages: DataFrame) -> DataFrame:
    return judged(pages)


def _sql() -> str:
    fits = []
    for verdict, rule in RULES:
        host, slash, rest = rule.partition("/")
        fits.append(f"({len(host.split('.'))}, {len(slash + rest)}, '{host}', '{slash + rest}', '{rule}', '{verdict}')")
    return f"""
WITH r(labels, length, h, p, rule, verdict) AS (VALUES {", ".join(fits)}),
a AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT i, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT i, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
m AS (SELECT c.*, r.rule, r.verdict, row_number() OVER (PARTITION BY i ORDER BY labels DESC, length DESC) AS n FROM c LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM m WHERE n = 1
"""


SQL = _sql()
