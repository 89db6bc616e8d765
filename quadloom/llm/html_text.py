"""Main text of web pages by site style trees.

1. The pages of a host are merged into one tree: nodes with the same path of tags,
   classes and places among their like are one node. For each node the tree counts the presentations
   (sequences of child tags) and the contents it had over the host's pages, and the
   length of its text outside of links.
2. A node's importance is the larger of the two entropies, each over the
   logarithm of the node's pages: 0 if all pages agree, 1 if no two do. Its
   information is its mean length on the host, weighted by (1 + importance) / 2, so what
   consists of links, as menus do, has next to none.
3. The main branch of a page is found in the tree by descending from the root as
   long as one child has `MAIN` of a node's information, and not into an article or
   main part. Then low branches go:
   a. containers on `MIN_PAGES` of the host's pages or more that are of low
      importance beside the page's text and the branch around;
   b. branches beside the main one with little information: less than `SIDE` of the
      main branch's, or than `BESIDE_ARTICLE` if that is an article or main part;
   c. branches that a name calls a sidebar, notice, advert or comments, and that have
      less information than the main branch; in it, less than half.
   So neither names nor `article` decide on a host whose tree has evidence.

The HTML standard itself says what nav, footer, header (outside of articles), aside,
form, dialog, ARIA landmarks, hidden elements and an article within an article
(readers' comments) are; these are no nodes. A host of less than `MIN_PAGES` texts has no
evidence of its own: there names remove branches, and an article with half
of the page's text or more is alone kept.

Articles are copied between pages. So pages of equal text count once, low is
measured by the mean importance of the page's text and by the branch around, and
an article, a main part, a container of half the text or more, and branches that
together leave less than `LEAST` of it are never removed for being repeated; nor
are paragraphs and headings.

Names count as a whole: a class, or outside of articles an id, made of listed
words and such as `bar` or `list`. They never name headings and paragraphs, and in
an article only containers by the words that are sure. Ids of sections, and those
in a main part without an article, are taken for slugs of headings.

Cases: null or empty html has the empty text; a null URL is the host ``; markup
that is cut off ends the page, as does raw text (scripts, styles) that is never
closed; any other tag that is never closed ends with its parent; text of formulas
and drawings and what stands in for media is kept;
repeated rows give repeated rows; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.scratch import Scratch, tune

#: A container goes if its importance is below LOW of its page's and its parent's, and it is on MIN_PAGES pages of its host or more. Nodes of HIGH count as 1.
LOW, HIGH, MIN_PAGES = 0.3, 0.9, 3
#: The share of a page's text that stays at least, whatever is repeated.
LEAST = 0.25
#: Share of a node's information at which a child holds the main branch; and shares of the main branch's below which a branch beside it goes.
MAIN, SIDE, BESIDE_ARTICLE = 0.8, 0.05, 0.5
#: Nodes of high importance are listed if they are on this share of the host's pages: a list has at most 100 times the nodes of a page of these.
COMMON = 0.01
#: Nodes and hosts that are broadcast; more are joined.
MAX_NODES = 500_000

# Names of the HTML standard.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_NOISE_TAGS = frozenset("nav footer aside form menu dialog button fieldset head noscript template select annotation annotation-xml".split())
#: Empty if written `<svg/>`.
_EMBEDDED = frozenset("svg math object canvas audio video noscript template select".split())
_CONTAINERS = frozenset("div section ul ol dl table center header figure details".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_NOISE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies
    disclaimer discussion disqus footer foot gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification
    pager pagination popup promo promoted promotion recommended related replies reply respond responses search share sharing sidebar signup
    skip social sponsor sponsored subscribe subscription toolbar topbar widget""".split()
)
#: Of these, the ones that count within an article or main part, where the others can be what it is about.
_SURE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comments commentlist consent disqus gdpr hidden login modal nav navbar
    newsletter pager pagination popup promo promoted promotion recommended related share sharing sidebar signup sponsored subscribe subscription
    toolbar topbar widget""".split()
)
_HEAD_NAMES = frozenset(["header"])
_ARTICLE_NAMES = frozenset("comment comments reply ad advert promo".split())
#: Parts that a name of noise can have besides: `share-bar`, `site-footer`.
_AROUND = frozenset(
    """area bar block body bottom box button buttons container content global google group header icon icons inner item items left link links list main
    menu mobile notice outer page panel post primary right row secondary section site slot social top unit wrap wrapper""".split()
)
_WHOLE = frozenset(["article", "main"])
_PROSE = frozenset("html body article main h1 h2 h3 h4 h5 h6 p blockquote pre".split())
#: Beside these, a name says what a wrapper has around it, not what it is: `has-sidebar`.
_ABOUT = frozenset("has with no without layout enabled".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"))


def _named(names: list[list[str]], words: frozenset[str]) -> bool:
    """Whether one of the names, given in parts, is one of the words as a whole, or made of them and what stands around."""
    return any(not words.isdisjoint(parts) and all(p in words or p in _AROUND for p in parts) for parts in names)


def _mask(n: int) -> int:
    return n & (1 << 64) - 1


def _signed(n: int) -> int:
    return _mask(n) - (1 << 64 if n >> 63 & 1 else 0)


class Node:
    """An element of the tree: its path, presentation and content, and the length of its own text and of that outside of links."""

    __slots__ = ("path", "style", "content", "tag", "parent", "named", "own", "plain")

    def __init__(self, path: int, tag: str, parent: int, named: bool):
        self.path, self.style, self.content, self.tag, self.parent, self.named = path, 0, 0, tag, parent, named
        self.own = self.plain = 0


class Page:
    """One pass over a page: its text pieces with what stands around them, and its nodes in the order of their starts."""

    def __init__(self, html: str):
        self.pieces: list[tuple[str, bool, bool, int]] = []  # text, in an article, noise by the standard, its nearest node
        self.nodes = [Node(0, "", 0, False)]
        self._sum = 0  # of the hashes of the text so far that is not noise
        self._unnamed, self._told, self._named_told = 0, 0, 0  # the same without what a name calls noise; lengths of the text, and of that
        # tag, path from its nearest node, presentation, sum at its start, in an article or main part, noise, nearest node, in an article, in a link, named as noise
        self._ended = False  # an article has been seen: what has an id in the main part, outside of it, is not in it
        self._stack: list[list] = [["", 0, 0, 0, False, False, 0, False, False, False]]
        self._parse(html)

    def _parse(self, html: str) -> None:
        at, low = 0, None
        while at < len(html):
            found = _TOKEN.search(html, at)
            if not found:
                self._text(html[at:])
                break
            self._text(html[at : found.start()])
            at = found.end()
            closing, tag, rest, end = found.group(1, 2, 3, 4)
            if tag is None:
                closing, tag, rest, end = found.group(5, 6, 7, 8)
            if not tag:
                continue
            if not end:  # cut off within a tag
                break
            tag = tag.lower()
            if closing:
                self._close(tag)
            elif tag in _RAW:
                self._break()
                if not rest.rstrip().endswith("/"):
                    low = low or html.lower()
                    stop = low.find(f"</{tag}", at) if len(low) == len(html) else html.find(f"</{tag}", at)
                    if stop < 0:
                        break
                    at = html.find(">", stop) + 1 or len(html)
            elif tag in _VOID:
                if tag not in _INLINE:
                    self._break()
                self._stack[-1][2] = _hash(self._stack[-1][2], tag)
            elif not (tag in _EMBEDDED and rest.rstrip().endswith("/")):
                self._open(tag, rest)
        while len(self._stack) > 1:
            self._pop()
        self.nodes[0].content = self._sum if 2 * self._named_told > self._told else self._unnamed  # what makes pages of equal text
        self._number()

    def _number(self) -> None:
        """Make the nodes' paths whole, each with the node's place among the like under its parent, and their number."""
        like, place = Counter((n.parent, n.path) for n in self.nodes[1:]), Counter()
        for node in self.nodes[1:]:
            kind = node.parent, node.path
            place[kind] += 1
            node.path = _hash(self.nodes[node.parent].path, node.path, place[kind], like[kind])

    def _text(self, text: str) -> None:
        if text:
            if "&" in text:
                text = entities.unescape(text)
            top = self._stack[-1]
            self.pieces.append((text, top[4], top[5], top[6]))
            if not top[5] and not text.isspace():
                told = _hash(" ".join(text.split()))
                self._sum = _mask(self._sum + told)
                self._told += len(text)
                if top[9]:
                    self._named_told += len(text)
                else:
                    self._unnamed = _mask(self._unnamed + told)
                node = self.nodes[top[6]]
                node.own += len(text)
                node.plain += 0 if top[8] else len(text)

    def _break(self) -> None:
        top = self._stack[-1]
        self.pieces.append((" ", top[4], top[5], top[6]))

    def _open(self, tag: str, rest: str) -> None:
        if tag in _CLOSES_P:
            self._close_until({"p"}, {"article", "section", "div", "td", "th", "li", "table"})
            self._close_until({"select"}, set())
        if tag in _SIBLINGS:
            self._close_until(_SIBLINGS[tag], _BARRIER[tag])
        top = self._stack[-1]
        top[2] = _hash(top[2], tag)
        names: list[list[str]] = []
        classes: list[str] = []
        role, hidden = "", False
        if rest.strip():
            for key, *values in _ATTRIBUTE.findall(rest):
                key, value = key.lower(), next((v for v in values if v), "")
                if key in ("class", "id"):
                    for name in value.split():
                        parts = [x for x in _PART.split(_CAMEL.sub("-", name).lower()) if x]
                        if key == "class" or self._ended or not (top[4] or tag == "section"):
                            names += [] if _ABOUT.intersection(parts) or key == "id" and top[7] else [parts]
                        classes += parts if key == "class" else []
                elif key == "role":
                    role = value.lower()
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(value):
                    hidden = True
        path = _hash(top[1], tag, *classes)
        article = top[4] or tag in _WHOLE or role in ("main", "article")
        noise = top[5] or tag in _NOISE_TAGS or role in _ROLES or hidden or tag == "header" and not top[4] or tag == "article" and top[7]
        if tag == "article":
            named = _named(names, _ARTICLE_NAMES)
        elif top[4]:
            named = tag in _CONTAINERS and _named(names, _SURE_NAMES)
        else:
            named = tag not in _PROSE and (_named(names, _NOISE_NAMES) or _named(names, _HEAD_NAMES))
        self._ended = self._ended or tag == "article" and not noise and not named
        if tag not in _INLINE:
            self._break()
        node = top[6]
        if not noise and (named or tag in _CONTAINERS or tag == "body" or tag in _WHOLE):
            self.nodes.append(Node(path, tag if role not in ("main", "article") else role, node, named))
            node, path = len(self.nodes) - 1, 0
        self._stack.append([tag, path, 0, self._sum, article, noise, node, top[7] or tag == "article" and not named, top[8] or tag == "a", top[9] or named])
        if tag not in _INLINE:
            self._break()

    def _pop(self) -> None:
        tag, style, start, node = (self._stack[-1][k] for k in (0, 2, 3, 6))
        if tag not in _INLINE:
            self._break()
        self._stack.pop()
        if node != self._stack[-1][6]:
            self.nodes[node].style, self.nodes[node].content = style, _mask(self._sum - start)
        if tag not in _INLINE:
            self._break()

    def _close_until(self, tags: set[str], barrier: set[str]) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] in tags:
                while len(self._stack) > k:
                    self._pop()
                return
            if self._stack[k][0] in barrier:
                return

    def _close(self, tag: str) -> None:
        if any(s[0] == tag for s in self._stack[:0:-1]):
            while self._stack[-1][0] != tag:
                self._pop()
            self._pop()
        elif tag not in _INLINE:
            self._break()

    def _within(self, own: list[float]) -> list[float]:
        """The sums of each node's branch."""
        out = list(own)
        for k in range(len(out) - 1, 0, -1):
            out[self.nodes[k].parent] += out[k]
        return out

    def lengths(self) -> list[int]:
        """The length of the text outside of links of each node's branch."""
        return self._within([n.plain for n in self.nodes])

    def _main(self, told: list[float]) -> list[int]:
        """The nodes from the root to the main branch, given the information of each."""
        spine, below = [0], [[] for _ in self.nodes]
        for k, n in enumerate(self.nodes[1:], 1):
            below[n.parent].append(k)
        while below[spine[-1]] and self.nodes[spine[-1]].tag not in _WHOLE:
            most = max(below[spine[-1]], key=lambda k: told[k] * (1 + (self.nodes[k].tag in _WHOLE)))  # in doubt, the standard's main part
            whole = sum(told[k] for k in below[spine[-1]])
            if told[most] < MAIN * max(whole, told[spine[-1]] if spine[-1] else 0) and not (self.nodes[most].tag in _WHOLE and 2 * told[most] >= whole):
                break
            spine.append(most)
        return spine

    def low(self, tree: dict[int, tuple[float, float]]) -> set[int]:
        """Nodes that are removed, given the importance and mean length of nodes on the page's host; others count as important and as long as on this page."""
        own = [n.own for n in self.nodes]
        known = [tree.get(n.path) for n in self.nodes]
        importance = [k[0] if k else 1.0 for k in known]
        within, total = self._within(own), sum(own)
        told = [(1 + i) / 2 * (k[1] if k else length) for i, k, length in zip(importance, known, self.lengths(), strict=True)]
        mean = sum(n * i for n, i in zip(own, importance, strict=True)) / max(total, 1)
        spine = self._main(told)
        main = self.nodes[spine[-1]]
        side = BESIDE_ARTICLE if main.tag in _WHOLE else SIDE
        inside, repeated, beside = {spine[-1]}, set(), set()
        for k, n in enumerate(self.nodes[1:], 1):
            if n.parent in inside:
                inside.add(k)
            if n.parent in repeated or k not in spine and n.tag in _CONTAINERS and importance[k] < LOW * min(mean, importance[n.parent]) and 2 * within[k] < total:
                repeated.add(k)
            if k in spine:
                continue
            share = told[k] / max(told[spine[-1]], 1e-9)
            seen = known[k] is not None or main.tag in _WHOLE
            if n.parent in beside or n.named and share < (0.5 if k in inside else 1.0) or k not in inside and len(spine) > 1 and seen and n.tag in _CONTAINERS and share < side:
                beside.add(k)
        if total - sum(own[k] for k in repeated) < LEAST * total:
            repeated = set()
        if not within[spine[-1]] and main.tag not in _WHOLE:  # this page has its text elsewhere
            beside = set()
        return repeated | beside

    def _named(self) -> set[int]:
        out: set[int] = set()
        for k, n in enumerate(self.nodes):
            if n.named or n.parent in out:
                out.add(k)
        return out

    def text(self, tree: dict[int, tuple[float, float]] | None = None) -> str:
        """The main text, by the tree of the page's host; None if the host has no evidence: then names and an article decide."""
        low = self._named() if tree is None else self.low(tree)
        kept = [(text, article) for text, article, noise, node in self.pieces if not noise and node not in low]
        if tree is None:
            told = sum(len(t) for t, article in kept if article and not t.isspace())
            if told and 2 * told >= sum(len(t) for t, _ in kept if not t.isspace()):
                kept = [(t, article) for t, article in kept if article]
        return " ".join("".join(t for t, _ in kept).split())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(html or "")
            whole = _signed(page.nodes[0].content)
            for n, length in zip(page.nodes[1:], page.lengths()[1:], strict=True):
                found[host, _signed(n.path), "style", _signed(n.style), whole, 0] += 1
                found[host, _signed(n.path), "content", _signed(n.content), whole, length] += 1
            found[host, 0, "content", whole, whole, 0] += 1  # path 0: the whole page
        if found:
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*found, strict=True)), pa.array(found.values(), pa.int64())], names=["host", "path", "kind", "value", "page", "length", "n"])


def _host() -> Column:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return F.lower(F.regexp_extract(url, "^[^/?#]*://([^/?#]*)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages (that have the node, those of equal text counted once), importance and mean length of the nodes of each host's tree; path 0 is the whole page, all pages counted."""
    tune(pages.sparkSession)
    read = pages.select(_host().alias("host"), F.col("html").cast("string"))
    node = ["host", "path", "kind", "value"]
    each = read.mapInArrow(_count, "host string, path long, kind string, value long, page long, length long, n long").groupBy(*node, "page").agg(F.sum("n").alias("n"), F.max("length").alias("length"))
    seen = each.groupBy(*node).agg(F.sum(F.when(F.col("path") == 0, F.col("n")).otherwise(1)).alias("n"), F.sum("length").alias("length"))
    sums = seen.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.count("*").alias("values"), F.sum("length").alias("length"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    return sums.groupBy("host", "path").agg(
        F.max("m").alias("pages"), F.max(entropy).alias("importance"), F.max(F.when(F.col("path") == 0, F.col("values"))).alias("texts"), (F.max("length") / F.max("m")).alias("length")
    )


def evidence(tree: DataFrame) -> DataFrame:
    """host of MIN_PAGES texts or more, and the paths, importances and lengths of its nodes on MIN_PAGES pages or more that are common or not of high importance."""
    sized = tree.join(tree.where("path = 0").select("host", F.col("texts").alias("all")), "host").where(F.col("all") >= MIN_PAGES)
    node = F.when((F.col("path") != 0) & (F.col("pages") >= MIN_PAGES) & ((F.col("importance") < HIGH) | (F.col("pages") >= COMMON * F.col("all"))), F.struct("path", "importance", "length"))
    held = sized.groupBy("host").agg(F.collect_list(node).alias("nodes"))
    return held.select("host", F.col("nodes.path").alias("paths"), F.col("nodes.importance").alias("importances"), F.col("nodes.length").alias("lengths"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, known = [], {}
        held = [batch.column(c) for c in ("paths", "importances", "lengths")]
        for k, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            if host not in known:
                paths, *rest = (c[k].as_py() for c in held)
                known[host] = None if paths is None else {_mask(p): v for p, *v in zip(paths, *rest, strict=True)}
            texts.append(Page(html or "").text(known[host]))
        out = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), out, pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    work = Scratch(pages.sparkSession, "style-tree")
    known = work.write("known", evidence(work.write("tree", style_tree(pages))))
    few = (known.agg(F.sum(F.size("paths") + 1).alias("n")).first()["n"] or 0) <= MAX_NODES
    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), _host().alias("host"))
    return read.join(F.broadcast(known) if few else known, "host", "left").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)


def importance(counts: list[int]) -> float:
    """The importance of a node with these counts of one kind, as style_tree computes it."""
    m = sum(counts)
    return (math.log(m) - sum(n * math.log(n) for n in counts) / m) / math.log(m) if m > 1 else 1.0


#: The same rows for pages whose main text is all of their one article, as in the given tables: what stands between its tags, without tags, in DuckDB.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '<[^>]*$', '') AS t FROM a),
e AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM t),
s AS (SELECT page_id, url, trim(regexp_replace(coalesce(t, ''), '[\s\x{0B}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS text FROM e)
SELECT page_id, url, text, length(text) AS n_chars FROM s
"""
