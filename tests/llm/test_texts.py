"""Near-duplicates, decontamination, language identification, page text, token files, fixity and the pipeline."""

import hashlib
import html
import json
import random
import re
import shutil
import struct
import subprocess
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, bag, documents, odd, prose, similarity
from pyspark.sql import functions as F

from quadloom.llm import decontaminate, html_text, language_id, near_dup, quality_rules, token_output, vectext, warc_fixity
from quadloom.llm.scratch import Scratch

ROOT = Path(__file__).parents[2]


def classes_by_brute_force(rows):
    """The least doc_id of each component of links of 0.8 or more."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(i, bag(t)) for i, t in rows]
    where = defaultdict(list)
    for n, (_, b) in enumerate(bags):
        for s in b:
            where[s].append(n)
    pairs = {(x, y) for held in where.values() for k, x in enumerate(held) for y in held[k + 1 :]}
    for x, y in pairs:
        if similarity(bags[x][1], bags[y][1]) >= 0.8:
            a, b = find(bags[x][0]), find(bags[y][0])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = "".join(prose(rng, 1))
    return out


@pytest.fixture(scope="module")
def copies():
    """Groups of exact and near copies, chains, repeated shingles, and documents that share a passage."""
    rng = random.Random(7)
    texts = []
    for size in (2, 5, 60):
        base = prose(rng, 120)
        texts += [" ".join(edited(rng, base, rng.randint(0, 5))) for _ in range(size)]
    chain = prose(rng, 150)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 2)
    passage = prose(rng, 60)
    texts += [" ".join(prose(rng, 40) + passage) for _ in range(40)]
    texts += ["a b c d e " * n for n in (3, 10, 11, 12, 40)]
    texts += ["Same Text, here!", "same text here", "same text", "", "", None, "?!", "?!"]
    rng.shuffle(texts)
    return texts


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    hashes = rng.integers(1, 2**63, 300).astype(np.uint64)
    for seed in range(4):
        a = rng.integers(0, 9, 300)
        b = np.where(rng.random(300) < 0.3, rng.integers(0, 9, 300), a)
        doc = np.concatenate([np.full((x > 0).sum(), i) for i, x in enumerate((a, b))])
        sig = near_dup.signatures(doc, np.concatenate([hashes[a > 0], hashes[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, slots=8000)
        assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03, seed
    assert (near_dup.signatures(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), 1) == np.iinfo(np.int64).max).all()


def test_signatures_do_not_depend_on_neighbours():
    texts = ["a b c d e f g h", "one two three", "x y z x y z x y z x y z", "q"]
    one = near_dup.signatures(*near_dup.bags(pa.array(texts)), len(texts))
    for i, t in enumerate(texts):
        assert (near_dup.signatures(*near_dup.bags(pa.array([t])), 1)[0] == one[i]).all()


def test_classes_equal_brute_force(spark, copies):
    got = {r.doc_id: r.class_id for r in near_dup.query(documents(spark, copies)).collect()}
    assert got == classes_by_brute_force(list(enumerate(copies)))


def test_classes_of_whole_buckets_in_blocks(spark, copies, monkeypatch):
    """Small blocks: buckets are dealt to several runs and searched in several blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    got = {r.doc_id: r.class_id for r in near_dup.query(documents(spark, copies)).collect()}
    assert got == classes_by_brute_force(list(enumerate(copies)))


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_dup.query(docs).collect()}
    assert got == classes_by_brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_links_lead_to_similar_documents_of_the_class(spark, copies, monkeypatch):
    """Also where a first member's pairs are verified in several places."""
    monkeypatch.setattr(near_dup, "PER_PLACE", 2)
    rows = {r.doc_id: r for r in near_dup.query(documents(spark, copies)).collect()}
    assert {i: r.class_id for i, r in rows.items()} == classes_by_brute_force(list(enumerate(copies)))
    size = Counter(r.class_id for r in rows.values())
    for r in rows.values():
        assert (r.link_id is not None) == (size[r.class_id] > 1), r
        if r.link_id is not None:
            assert r.link_id != r.doc_id and rows[r.link_id].class_id == r.class_id
            assert r.similarity >= 0.8 and r.similarity == pytest.approx(similarity(bag(copies[r.doc_id]), bag(copies[r.link_id])), abs=1e-6)


def test_one_of_each_class_stays(spark, copies):
    docs = documents(spark, copies)
    kept = near_dup.keep(docs)
    want = classes_by_brute_force(list(enumerate(copies)))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({v for v in want.values()})


def test_near_dup_takes_odd_rows(spark):
    df = odd(spark, ("rep", "class", "class_id", "bucket", "text_hash"))
    rows = near_dup.query(df).collect()
    assert len(rows) == 13 and Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in df.collect())
    kept = near_dup.keep(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({None: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 1, 8: 1, 9: 1})
    assert near_dup.query(df.limit(0)).count() == 0 and near_dup.keep(df.limit(0)).count() == 0


def leaks_by_brute_force(docs, items):
    out = {}
    for item_id, item in items:
        b = bag(item)
        n = sum(b.values())
        for doc_id, text in docs:
            w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
            s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
            size = min(n, len(s))
            best = max((similarity(Counter(s[o : o + size]), b) for o in range(len(s) - size + 1)), default=0) if n else 0
            if best >= 0.8:
                out[doc_id, item_id] = round(best, 9)
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(11)
    items = [(i, " ".join(prose(rng, rng.randint(15, 60)))) for i in range(25)] + [(25, "short item"), (26, ""), (27, None)]
    docs = []
    for n in range(120):
        body = prose(rng, rng.randint(0, 300))
        if n % 3 == 0:
            leak = items[rng.randrange(25)][1].split()
            for _ in range(n // 30):
                leak[rng.choice([0, 1, -1, -2])] = "changed"
            at = rng.randint(0, len(body))
            body = body[:at] + leak + body[at:]
        docs.append((n, " ".join(body) if n % 7 else ", ".join(body).title()))
    docs += [(200, "short item"), (201, "a short item"), (202, None), (203, "")]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == leaks_by_brute_force(docs, items) and len(got) > 30


def test_whole_documents_table_of_leaks(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.query(docs, items).collect()}
    assert got == leaks_by_brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    left = decontaminate.keep(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_items_in_several_blocks(spark, sf_dir, monkeypatch):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.query(docs, items).collect()))
    left = sorted(r.doc_id for r in decontaminate.keep(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    assert sorted(map(tuple, decontaminate.query(docs, items).collect())) == want
    assert sorted(r.doc_id for r in decontaminate.keep(docs, items).collect()) == left


def random_items(rng, n, words=(20, 60)):
    return [(i, " ".join(prose(rng, rng.randint(*words)))) for i in range(n)]


def test_blocks_miss_no_fingerprint_within_the_radius():
    rng = np.random.default_rng(3)
    index = decontaminate.Index(random_items(random.Random(3), 300))
    prints = index.prints[rng.integers(len(index.ids), size=2000)].copy()
    raw = prints.view(np.uint8)
    for row in raw:
        for bit in rng.choice(128, rng.integers(15, 45), replace=False):
            row[bit // 8] ^= 1 << bit % 8
    for low, top in ((1, 1000), (20, 30)):
        far = np.bitwise_count(prints[:, None] ^ index.prints[None]).sum(axis=2)
        fit = (index.size >= low) & (index.size <= top)
        assert index.near(prints, (low, top)) == list(zip(*(x.tolist() for x in np.nonzero((far <= decontaminate.RADIUS) & fit)), strict=True))


def test_blocks_pass_less_than_a_hundredth_of_unlike_pairs():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 2**63, (200_000, 2)).astype(np.uint64) for _ in range(2))
    blocks = np.bitwise_count((a ^ b).view(np.uint32))
    assert (blocks <= decontaminate.RADIUS // 4).any(axis=1).mean() < 0.01


def test_an_index_of_many_items_is_compact():
    items = random_items(random.Random(5), 4000)
    index = decontaminate.Index(items)
    assert index.nbytes < 200e6 / 5, "20,000 items take less than 200 MB"
    text = " ".join(prose(random.Random(6), 300) + items[17][1].split() + prose(random.Random(7), 300))
    assert [(r, i, s) for r, i, s, *_ in index.find(pa.array([None, text]))] == [(1, 17, 1.0)]


def test_of_equal_leaks_the_first_counts():
    rng = random.Random(15)
    item = " ".join(prose(rng, 25))
    text = " ".join([*prose(rng, 10), item, *prose(rng, 300), item, *prose(rng, 2000), item])
    assert list(decontaminate.Index([(1, item)]).find(pa.array([text]))) == [(0, 1, 1.0, 10, 25)]


def test_recall_of_leaks_near_the_threshold():
    """Leaks with as many changed words, at random places, as the threshold allows."""
    rng = random.Random(12)
    items = random_items(rng, 60, (20, 90))
    index = decontaminate.Index(items)
    docs = []
    for _ in range(400):
        leak = rng.choice(items)[1].split()
        for _ in range(rng.randint(1, max(1, len(leak) // 18))):
            leak[rng.randrange(len(leak))] = "changed"
        docs.append(" ".join(prose(rng, rng.randint(0, 80)) + leak + prose(rng, rng.randint(0, 80))))
    want = leaks_by_brute_force(list(enumerate(docs)), items)
    got = {(r, i): round(s, 9) for r, i, s, *_ in index.find(pa.array(docs))}
    close = [k for k, v in want.items() if v < 0.86]
    assert len(close) > 40 and got.items() <= want.items()
    assert len(got) >= 0.99 * len(want) and sum(k in got for k in close) >= 0.97 * len(close)


def test_decontamination_takes_odd_rows(spark):
    df, items = odd(spark, ("item_id", "similarity")), spark.createDataFrame([(1, "a b c d e f g h i j k l"), (None, "one"), (2, None)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.query(df, items).collect())
    assert got == Counter({(6, 1): 2, (None, 1): 1, (4, None): 1})
    assert decontaminate.query(df.limit(0), items).count() == 0 and decontaminate.query(df, items.limit(0)).count() == 0
    assert decontaminate.keep(df, items).count() == 9 and decontaminate.keep(df, items.limit(0)).count() == 13


def grams_by_brute_force(text):
    runs, run = [], ""
    for ch in (text or "").lower() + " ":
        if unicodedata.category(ch)[0] in "LM":
            run += ch
        elif run:
            runs.append(f" {run} ")
            run = ""
    found = Counter(w[i : i + n] for w in runs for n in (1, 2, 3) for i in range(len(w) - n + 1))
    found.pop(" ", None)
    return {sum(ord(c) << 21 * (2 - i) for i, c in enumerate(g)): n for g, n in found.items()}


def test_ngrams_equal_brute_force():
    texts = ["The cat, the hat!", "", None, "123 !!", "Éçole über e\u0301", "a", "  ab  cd ", "漢字 \U0001f600 \U00020000x"]
    for a, n, lettered, doc, code, count in language_id.grams(pa.array(texts)):
        for i in range(n):
            assert dict(zip(code[doc == i].tolist(), count[doc == i].tolist(), strict=True)) == grams_by_brute_force(texts[a + i])
            assert lettered[i] == any(c.isalpha() for c in texts[a + i] or "")


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.query(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)


def test_predictions_equal_brute_force():
    profiles = {"x": [c for c, _ in sorted(grams_by_brute_force("the cat sat on the mat").items(), key=lambda g: (-g[1], g[0]))], "y": [c for c, _ in sorted(grams_by_brute_force("le chat noir est la").items(), key=lambda g: (-g[1], g[0]))]}
    texts = ["the mat", "la le chat", "zzz", "", "le the"]
    names, scores = language_id.Model(profiles).predict(pa.array(texts))
    for text, name, score in zip(texts, names, scores, strict=True):
        own = [c for c, _ in sorted(grams_by_brute_force(text).items(), key=lambda g: (-g[1], g[0]))][:300]
        far = {k: sum(abs(i - p.index(g)) if g in p else 300 for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert (name, score) == ((best, 1 - far[best] / (300 * len(own))) if own else ("und", 0.0))


def test_language_id_takes_odd_rows(spark):
    df = odd(spark, ("lang_pred", "held_out", "score"))
    rows = language_id.query(df).collect()
    assert len(rows) == 13 and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 5)} == {"und"}
    assert language_id.query(df.limit(0)).count() == 0
    unlabelled = language_id.query(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


def test_page_text_of_generated_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in html_text.query(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = r.html[r.html.index("<article>") + 9 :].split("</article>")[0]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"<[^>]*$", "", body))).split())
        assert r.text == want and r.n_chars == len(want)


PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">accept</div>
<main><article><h1>Title &amp; more</h1><p>First <b>bold</b>er&nbsp;text<p>Second &lt;x&gt; 1<2<ul><li>one<li>two</ul><div class="share-bar">share</div><script>var x="</p>";</script><!-- c --></article>
<section id="comments"><p>reader says</p></section></main><aside>side</aside><form>f</form><footer>foot</footer></body></html>"""


def test_page_structure():
    assert html_text.Page(PAGE).text() == "Title & more First bolder text Second <x> 1<2 one two"
    assert html_text.Page('<div class="sidebar">x</div><p>only <a href="a>b">text</a></p>').text() == "only text"
    assert html_text.Page('<div class="page has-sidebar no-comments"><p title="a hidden gem" class=x>kept</p><p hidden>a</p><p style="display: none">b</p><p aria-hidden=true>c</p></div>').text() == "kept"
    assert html_text.Page("plain &copy; text <p").text() == "plain © text"
    assert html_text.Page("").text() == "" and html_text.Page("<article></article>").text() == ""
    assert html_text.Page("<div>" * 3000 + "deep").text() == "deep"


def test_style_trees_remove_what_a_host_repeats(spark):
    rows = [(i, f"http://h/{i}", f"<body><div class=blurb><p>Always the same</p></div><div class=story><p>Story {i} number {i * 7}</p><p>told once</p></div></body>") for i in range(30)]
    rows += [(100 + i, "http://few/", "<body><div class=blurb><p>Seen twice</p></div></body>") for i in range(2)]
    rows += [(200 + i, "http://copies/", "<body><div class=story><p>One story</p></div></body>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in html_text.query(pages).collect()}
    assert text[3] == "Story 3 number 21 told once" and text[100] == "Seen twice" and text[200] == "One story"
    tree = {(r.host, r.path): (r.pages, r.importance) for r in html_text.style_tree(pages).collect()}
    assert tree["h", 0] == (30, pytest.approx(1.0)) and tree["copies", 0] == (20, 0.0)
    assert html_text.importance([5, 5]) == pytest.approx(np.log(2) / np.log(10))


def test_copied_stories_stay_under_varying_menus(spark):
    story = lambda k: f"<div class=story><p>Story {k} " + "told again " * 20 + "</p><div class=more>" + f"and more of story {k} " * 8 + "</div></div>"
    page = lambda i, k: f"<body><div class=top>item {i} link {i * 3}</div>{story(k)}</body>"
    rows = [(i, "http://copies/", page(i, 0 if i < 80 else i)) for i in range(100)] + [(100 + i, "http://small/", page(i, min(i, 1))) for i in range(8)]
    rows += [(200 + i, "http://one/", page(i, 0)) for i in range(30)]
    text = {r.page_id: r.text for r in html_text.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(t.count("told again") == 20 and t.count("and more") == 8 for t in text.values()) and len(text) == 138


def test_a_teaser_beside_the_story_does_not_decide(spark):
    page = lambda i: f"<body><div id=content><p>Story {i} " + f"goes on {i} " * 20 + f"</p></div><article class=teaser><p>Teaser {i}</p></article></body>"
    rows = [(i, "http://alone/" if i == 0 else "http://many/", page(i)) for i in range(20)]
    for r in html_text.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text.count(f"goes on {r.page_id} ") == 20 and r.text.endswith(f"Teaser {r.page_id}")
    assert html_text.Page("<body><div>Site name</div><article>" + "text " * 20 + "</article></body>").text() == ("text " * 20).strip()


def test_style_trees_judge_nodes_by_the_pages_that_have_them(spark):
    story = lambda i: f"<p>Story {i} " + f"goes on {i} " * 30 + "</p>"
    blurb = "<p>Always the same</p>"
    page = lambda i, name="": f"<body><div class={name}a>{blurb}</div><div class={name}b>{story(i)}</div></body>"
    rows = [(i, "http://skewed/", page(max(i, 45))) for i in range(90)]
    rows += [(100 + i, "http://templates/", page(i, "xyzw"[i % 4])) for i in range(40)]
    rows += [(200 + i, "http://small/", page(i)) for i in range(4)]
    rows += [(300 + i, "http://unnamed/", f"<body><div>{blurb}</div><div>{story(i)}</div></body>") for i in range(30)]
    text = {r.page_id: r.text for r in html_text.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(text) == 164 and all(t.startswith("Story") and t.count("goes on") == 30 for t in text.values())


def story_of(rng, n):
    return " ".join(f"<p>{' '.join(prose(rng, 30))}</p>" for _ in range(n))


def page_texts(spark, rows):
    return {r.page_id: r.text for r in html_text.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def plain_text(markup):
    return " ".join(re.sub(r"<[^>]+>", " ", markup).split())


def test_trees_find_the_main_branch_under_neutral_names(spark):
    """No article, no telling class, and menus and adverts that differ on every page."""
    rng, rows, want = random.Random(5), [], {}
    for i in range(40):
        story = story_of(rng, rng.randint(3, 9))
        menu = "".join(f"<li><a href=x>{w}</a></li>" for w in prose(rng, rng.randint(4, 12)))
        rows.append((i, "http://h/", f"<body><div class=a><ul>{menu}</ul></div><div class=b>{' '.join(prose(rng, 4))}</div><div class=c>{story}</div><div class=d>Always the same words</div></body>"))
        want[i] = plain_text(story)
    assert page_texts(spark, rows) == want
    assert html_text.Page(rows[0][2]).text() != want[0], "without the tree the rest stays"


def test_names_count_only_beside_the_tree(spark):
    """A main branch with a name of the list stays; a varying part with such a name goes where it is smaller than the main branch."""
    rng, rows, want = random.Random(6), [], {}
    for i in range(12):
        story = story_of(rng, 8)
        rows.append((i, "http://h/", f"<body><div class=related><p>{' '.join(prose(rng, 40))}</p></div><div class=search>{story}</div></body>"))
        want[i] = plain_text(story)
    assert page_texts(spark, rows) == want


def test_short_articles_lose_what_is_longer_beside_them(spark):
    """What a branch is worth is judged over the host, so a page of one word is cleaned as the others are."""
    rng, rows, want = random.Random(8), [], {}
    for i in range(20):
        story = "<p>Word</p>" if i % 5 == 0 else story_of(rng, 6)
        rows.append((i, "http://h/", f"<body><div class=x>{' '.join(prose(rng, 9))}</div><article>{story}<article>reader {i} says</article></article></body>"))
        want[i] = plain_text(story)
    assert page_texts(spark, rows) == want


def test_names_do_not_take_the_text_of_an_article():
    inner = (
        '<h2 id="social-history">A</h2><section id="discussion">B</section><h2 id="search-algorithms">C</h2><p class="comment">D</p><div id="navigation">E</div><p id="notice-period">F</p>'
        '<section class="responses">G</section><div class="social-history">H</div><span class="search">I</span><section id="comments">J</section>'
    )
    for tag in ("article", "main", "div role=main"):
        noise = '<div class="ad">x</div><div class="share-bar">x</div><ul class="related-links">x</ul>'
        assert html_text.Page(f"<{tag}>{inner}{noise}</{tag.split()[0]}>").text() == "A B C D E F G H I J"
    assert html_text.Page('<body><section id="discussion">A</section><h1 class="banner">B</h1><div id="navigation">x</div><div class="site-footer">x</div><a class="skip-link">x</a></body>').text() == "A B"


def test_embedded_elements_end_with_their_parents():
    for tag in ("svg", "math", "object", "canvas", "audio", "video", "select", "noscript", "template"):
        inner = "" if tag in ("select", "noscript", "template") else "x "
        assert html_text.Page(f"<body><div>a<{tag}><b>x</b></div><p>the rest</p></body>").text() == f"a {inner}the rest"
        assert html_text.Page(f"<p>a<{tag}><{tag}>x</{tag}> x</{tag}> the rest</p>").text() == f"a {inner * 2}the rest"
    assert html_text.Page("<div><select><option>x<p>the rest</div>").text() == "the rest"
    assert html_text.Page("<article><math><mi>E</mi><mo>=</mo><mi>m</mi></math><svg/> end <script>x").text() == "E = m end"


def test_page_text_takes_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "http://h/", "<p>a", "x"), (2, "", "", "x"), (2, "", "", "x"), (3, "http://h/", "<p>" + "w " * 200_000, "x")], "page_id long, url string, html string, text string")
    got = Counter((r.page_id, r.n_chars) for r in html_text.query(pages).collect())
    assert got == Counter({(1, 0): 1, (None, 1): 1, (2, 0): 2, (3, 399_999): 1})
    assert html_text.query(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return token_output.Encoder(token_output.vocabulary_path())


def test_words_that_are_remembered_encode_as_whole_texts_do(encoder):
    rng = random.Random(3)
    parts = ["don't", "x<|endoftext|>y", "'s", "it's***b", "a1b22", "é!ü.", "×5÷3", "##x##", "a'b'c", "re'd", "1'll", "«a»", "≠a", "9.9'9", "ß'ß", "Ⅷa", "a_b", "日本1", " ", "\u00a0", "a", "'", "é", "1", ".", "<", "|", ">", "\u0301", "—", "İ", "ΟΔΟΣ", "ΟΔΟΣ.", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + [None, "", "w" * 3000]
    found = list(encoder.encode(pa.array(texts)))
    flat, sizes = np.concatenate([f for f, _ in found]), np.concatenate([s for _, s in found])
    want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [i for w in want for i in w]


def test_a_full_cache_is_forgotten(encoder, monkeypatch):
    monkeypatch.setattr(token_output, "CACHE_WORDS", 10)
    texts = pa.array([" ".join(prose(random.Random(s), 30)) for s in range(6)])
    want = [i for e in encoder.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False) for i in e.ids]
    for _ in range(2):
        assert np.concatenate([f for f, _ in encoder.encode(texts)]).tolist() == want


@pytest.mark.parametrize("counts", [[5], [1, 1], [1, 2, 4, 8, 16, 32, 64, 128], [1] * 300, [10**6, 1, 1, 1, 1]])
def test_code_lengths(counts):
    import heapq

    n = np.array(counts)
    bits = token_output.code_lengths(n)
    heap, cost = sorted(counts), 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (bits * n).sum() == (cost or n.sum())
    limited = token_output.code_lengths(n, max(1, (len(counts) - 1).bit_length()))
    assert limited.max() <= max(1, (len(counts) - 1).bit_length()) and (2.0**-limited).sum() <= 1
    with pytest.raises(ValueError):
        token_output.code_lengths(np.ones(9), 3)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 4000)
    kinds, counts = np.unique(ids, return_counts=True)
    book = token_output.Codebook(kinds, token_output.code_lengths(counts))
    payload, offsets = book.encode(ids)
    assert (book.decode(payload, offsets, n) == ids).all() and len(offsets) == -(-n // token_output.STRIDE)


def test_token_files(spark, encoder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = Scratch(spark, "test-tokens").path
    token_output.write(docs, path)
    texts, at = dict(docs.select("doc_id", "text").collect()), 0
    crc = {r.doc_id: r.ids_crc32 for r in token_output.read(spark, path, whole=False).collect()}
    for r in sorted(token_output.read(spark, path).collect(), key=lambda r: r.doc_id):
        want = [*encoder.tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids) == (at, len(want), want)
        assert crc[r.doc_id] == zlib.crc32(struct.pack(f"<{len(want)}I", *want))
        at += len(want)


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    other = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = pa.array(["Some  Text, it's HERE", None, "", " Ünïcode\n\n12 34"])
    got = [ids[a:b].tolist() for ids, sizes in other.encode(texts) for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True)]
    assert not other.by_words and got == [other.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
    assert token_output.Encoder(token_output.vocabulary_path()).by_words


def test_token_output_takes_odd_rows(spark):
    df = odd(spark, ("start", "n_tokens", "ids_crc32"))
    rows = sorted(token_output.query(df).collect(), key=lambda r: r.start)
    assert len(rows) == 13 and [r.doc_id for r in rows] == sorted((r.doc_id for r in df.collect()), key=lambda i: -1 if i is None else i)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False)) and rows[0].start == 0
    assert token_output.query(df.limit(0)).count() == 0


def test_fixity(spark, monkeypatch):
    monkeypatch.setattr(warc_fixity, "SEGMENT", 40)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}") for i in range(700)], "page_id long, url string, html string")
    rows = warc_fixity.query(pages).collect()
    kind = lambda i: hashlib.md5(f"damage:{i}".encode()).hexdigest()[:2]
    want = {i: {"00": "corrupt", "01": "corrupt", "02": "missing"}.get(kind(i), "ok") for i in range(700)}
    assert {r.page_id: r.status for r in rows} == want and set(want.values()) == {"ok", "corrupt", "missing"}
    for held in ({r.segment for r in rows},):
        for s in held:
            own = sorted((r for r in rows if r.segment == s), key=lambda r: r.record)
            assert [r.record for r in own] == list(range(len(own))) and own[0].start == 0
            assert all(b.start == a.start + a.length for a, b in zip(own, own[1:], strict=False))


def test_equal_replicas_and_extra_records(spark):
    leaves = [("a", 0, i, i * 10, 10, f"d{i}") for i in range(50)] + [("b", 0, i, i * 10, 10, f"d{i}") for i in range(50)]
    kind = "replica string, segment long, record long, offset long, length long, digest string"
    work = Scratch(spark, "test-tree")
    assert warc_fixity.audit(*warc_fixity.tree(spark.createDataFrame(leaves, kind), work, "x"), "a", "b", work).count() == 0
    more = [*leaves, ("b", 0, 50, 500, 10, "new"), ("b", 1, 0, 0, 10, "new")]
    more[7] = ("a", 0, 7, 70, 10, "bad")
    found = warc_fixity.audit(*warc_fixity.tree(spark.createDataFrame(more, kind), work, "y"), "a", "b", work).collect()
    assert {tuple(r) for r in found} == {(0, 50, "extra"), (1, 0, "extra"), (0, 7, "corrupt")}


def test_fixity_of_null_ids_and_of_records_that_are_extra_or_shifted(spark, monkeypatch):
    monkeypatch.setattr(warc_fixity, "SEGMENT", 1000)
    kind = "page_id long, url string, html string"
    rows = [(None if i % 2 else i, f"http://h/{i}", f"<p>{i}") for i in range(300)] + [(500, "http://h/twice", x) for x in "abcd"]
    damage = lambda i: {"00": "corrupt", "01": "corrupt", "02": "missing"}.get(hashlib.md5(f"damage:{'null' if i is None else i}".encode()).hexdigest()[:2], "ok")
    got = warc_fixity.query(spark.createDataFrame(rows, kind)).collect()
    assert Counter((r.page_id, r.status) for r in got) == Counter((i, damage(i)) for i, _, _ in rows)

    lost = rows[8]
    others = [r for r in rows if r is not lost and r[2] != "b"] + [(500, "http://h/twice", "z"), (900, "http://h/new", "new"), (None, "http://h/new", "new")]
    got = warc_fixity.compare(spark.createDataFrame(rows, kind), spark.createDataFrame(others, kind)).collect()
    status = Counter(r.status for r in got)
    assert len(got) == 306 and status["missing"] == 1 and status["corrupt"] == 1 and status["extra"] == 2
    assert {r.page_id for r in got if r.status == "extra"} == {900, None} and {r.page_id for r in got if r.status == "missing"} == {lost[0]} and {r.page_id for r in got if r.status == "corrupt"} == {500}
    # the extra null page stands among the first replica's nulls, so records after it are shifted, those before it are not
    assert status["shifted"] + status["ok"] == 302 and status["shifted"] > 100 and {r.record for r in got} == set(range(306))


def test_the_plan_of_an_audit_does_not_grow_with_its_levels(spark):
    work = Scratch(spark, "test-plan")
    leaves = [(r, s, i, i * 10, 10, f"{s}-{i}-{r if (s, i) == (40, 3) else ''}") for r in "ab" for s in range(41) for i in range(5 if s else 300)]
    levels, inner = warc_fixity.tree(spark.createDataFrame(leaves, "replica string, segment long, record long, offset long, length long, digest string"), work, "z")
    assert (len(levels), inner) == (6, 3) and [x.count() for x in levels[-2:]] == [6, 2]
    out = warc_fixity.audit(levels, inner, "a", "b", work)
    assert [tuple(r) for r in out.collect()] == [(40, 3, "corrupt")]
    assert out._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_warc_files_are_read_back_and_audited(spark, tmp_path):
    rows = [(i, f"http://h/{i}" if i % 5 else "", f"<p>é {i}\r\n\r\nWARC/1.0 is text here\n" * (i % 3)) for i in range(60)] + [(None, "a\r\nb", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    warc_fixity.write(pages, f"file://{one}", 3)
    back = warc_fixity.read(spark, f"file://{one}").collect()
    assert Counter((r.page_id, r.url, bytes(r.payload).decode()) for r in back) == Counter((i, {"": None}.get(u, u.replace("\r\n", "%0D%0A")), h or "") for i, u, h in rows)
    book = {(r.segment, r.record): (r.offset, r.length, r.digest) for r in warc_fixity.manifest(pages, 3).collect()}
    assert {(r.segment, r.record): (r.offset, r.length, r.digest) for r in back} == book
    first = sorted(tmp_path.glob("one/segment=*/part-*"))[0].read_bytes()
    headers = [h for *_, h, _ in warc_fixity.records(first)]
    assert all({"warc-type", "warc-record-id", "warc-date", "content-length"} <= h.keys() for h in headers)

    assert {r.status for r in warc_fixity.compare_files(spark, f"file://{one}", f"file://{one}").collect()} == {"ok"}
    shutil.copytree(one, two)
    file = next(f for f in sorted(tmp_path.glob("two/segment=*/part-*")) if b"urn:page:32>" in f.read_bytes())
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    file.write_bytes(file.read_bytes().replace(b" 32\r\n\r\nWARC/1.0 is", b" 32\r\n\r\nWARC/1.1 is", 1))
    got = warc_fixity.compare_files(spark, f"file://{one}", f"file://{two}").collect()
    assert [(r.page_id, r.status) for r in got if r.status != "ok"] == [(32, "corrupt")]
    file.write_bytes(file.read_bytes()[:-9])
    with pytest.raises(Exception, match="WARC record at byte"):
        warc_fixity.read(spark, f"file://{two}").collect()
    assert len([r for r in warc_fixity.compare_files(spark, f"file://{one}", f"file://{two}").collect() if r.status == "corrupt"]) == 2


def test_fixity_takes_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>", "x"), (2, "", "", "x"), (2, "", "", "x")], "page_id long, url string, html string, status string")
    assert warc_fixity.query(pages).count() == 4 and warc_fixity.query(pages.limit(0)).count() == 0


def test_hashes_do_not_depend_on_where_words_stand():
    texts = pa.array(["one two", "two one two", None, "", "x one"])
    data, offsets = vectext.text_bytes(texts)
    words = vectext.split_words(data, offsets, vectext.SOLID)
    assert words.counts.tolist() == [2, 3, 0, 0, 2]
    h = words.hash.tolist()
    assert h[0] == h[3] == h[6] and h[1] == h[2] == h[4] and h[5] not in h[:5]
    again = vectext.text_bytes(texts.slice(4, 1))
    assert vectext.split_words(*again, vectext.SOLID).hash.tolist() == h[5:]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    from quadloom.llm import mixing, quality_rules

    good = {r.doc_id for r in quality_rules.query(docs).where("kept").collect()}
    cls = classes_by_brute_force([(i, rows[i].text) for i in sorted(good)])
    left = {i for i in good if cls[i] == i}
    left -= {d for d, _ in leaks_by_brute_force([(i, rows[i].text) for i in left], benchmark)}
    rest = spark.createDataFrame([rows[i] for i in sorted(left)], docs.schema)
    want = {r.doc_id for r in mixing.mix(rest).where("selected").collect()}
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "shard"]
    got = out.collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want) > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dup", "decontaminate", "mixing", "sharding"]


def test_pipeline_takes_odd_rows(spark, sf_dir):
    import corpus_pipeline

    for df in (odd(spark), odd(spark).limit(0), spark.createDataFrame([], DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf_dir)
            assert df.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
        df.count()


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert json.dumps(sorted(entry.oracle_sql()))


def test_long_texts_are_worked_on_in_parts(monkeypatch):
    """The same words, hashes, measurements, n-grams and signatures whatever the size of a part."""
    rng = random.Random(9)
    texts = pa.array([" ".join(prose(rng, 300)) + "\nÉté " + "x" * 500 + "\n" + " ".join(prose(rng, 40)) * 2, "", None, "a b", "y" * 700, "one line\none line\n" * 30])

    def all_of():
        data, offsets = vectext.text_bytes(texts)
        words = vectext.split_words(data, offsets, vectext.SOLID, np.array([3, 90, 700]))
        grams = {}
        for a, n, lettered, doc, code, count in language_id.grams(texts):
            for i in range(n):
                grams[a + i] = (bool(lettered[i]), code[doc == i].tolist(), count[doc == i].tolist())
        return (
            [x.tolist() for x in (words.doc, words.start, words.end, words.hash)], grams, {k: v.tolist() for k, v in quality_rules.measure(texts).items()},
            near_dup.signatures(*near_dup.bags(texts), len(texts)).tolist(), list(decontaminate.Index([(1, "a b"), (2, " ".join(prose(random.Random(9), 300)[100:140]))]).find(texts)),
        )

    want = all_of()
    assert len(want[4]) == 2 and want[1][0][0]
    for size in (64, 100, 1000):
        monkeypatch.setattr(vectext, "PIECE", size)
        monkeypatch.setattr(near_dup, "ELEMENTS", size)
        assert all_of() == want


def test_memory_of_a_text_of_40_megabytes():
    """Each operator takes less than 800 MB for it, beside the text itself."""
    code = """
import resource, sys
import pyarrow as pa
from quadloom.llm import decontaminate, language_id, near_dup, quality_rules
words = ["alpha", "beta", "gamma", "delta", "epsilon"]
text = pa.array([" ".join([" ".join(f"{words[i % 5]}{i * 7 % 999983}" for i in range(k, k + 5000)) for k in range(0, 3_500_000, 5000)])])
if sys.argv[1] == "op1":
    list(language_id.grams(text))
elif sys.argv[1] == "op2":
    list(decontaminate.Index([(1, "some item of no great length")]).find(text))
elif sys.argv[1] == "op5":
    near_dup.signatures(*near_dup.bags(text), 1)
elif sys.argv[1] == "op8":
    quality_rules.measure(text)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
"""
    run = lambda name: float(subprocess.run([sys.executable, "-c", code, name], capture_output=True, text=True, check=True, cwd=ROOT).stdout)
    base = run("none")
    used = {name: run(name) - base for name in ("op1", "op2", "op5", "op8")}
    assert all(v < 800 for v in used.values()), used
    print(used)
