"""Quality rules, URL filters, sharding and mixing."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from helpers import DOCS, documents, odd, prose
from pyspark.sql import functions as F

from quadloom.llm import mixing, quality_rules, registry, sharding, url_filter


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equal_to_sql(spark, sf_dir, duck, name):
    df, want = registry.queries()[name](spark, sf_dir), duck.sql(registry.oracle_sql()[name])
    rows = lambda names, data: sorted(tuple(repr(r[i]) for i in sorted(range(len(names)), key=names.__getitem__)) for r in data)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_measures_of_hand_made_texts():
    texts = ["a b c d e a b c d e", "x\ny\nx\n\n \nx", "w!! w!! #1 2", "", None, "a b c d e f", "a b c d e x a b c d e y"]
    m = quality_rules.measure(pa.array(texts))
    assert m["n_words"].tolist() == [10, 4, 4, 0, 0, 6, 12]
    assert m["n_repeat_words"].tolist() == [10, 0, 0, 0, 0, 0, 10]
    assert m["n_dup_lines"].tolist() == [0, 2, 0, 0, 0, 0, 0] and m["n_lines"].tolist() == [1, 4, 1, 0, 0, 1, 1]
    assert m["n_symbols"].tolist()[2] == 1 and m["n_loud_words"].tolist()[2] == 2 and m["n_letter_words"].tolist()[2] == 2


def test_policies_and_ablation(spark):
    rng = random.Random(1)
    texts = [" ".join(prose(rng, 40)), "too short", "a b c d e " * 5, " ".join(w + "***" for w in prose(rng, 30)), " ".join(w + "!!" for w in prose(rng, 30))]
    book = quality_rules.ledger(documents(spark, texts)).cache()
    kept = {v: [r.kept for r in quality_rules.apply_policy(book, v).orderBy("doc_id").collect()] for v in quality_rules.POLICIES}
    assert kept == {"base": [True, False, False, True, True], "v1": [True, False, False, False, True], "v2": [True, False, False, False, False]}
    by_rule = {r.rule: (r.n_failed, r.n_alone) for r in quality_rules.ablation(book).collect()}
    assert by_rule["loud_words"] == (1, 1) and by_rule["few_words"] == (1, 1) and by_rule["symbols"][0] == 1
    total = quality_rules.overview(book).first()
    assert total.all_bits == 0 and total.any_bits & quality_rules.BIT["loud_words"]
    assert [r.doc_id for r in quality_rules.keep(documents(spark, texts)).collect()] == [0]


def test_quality_rules_take_odd_rows(spark):
    clash = ("n_words", "kept", "fail_bits")
    rows = quality_rules.query(odd(spark, clash)).collect()
    assert len(rows) == 13 and all(r.kept is not None for r in rows)
    assert quality_rules.keep(odd(spark, clash)).columns[-3:] == list(clash)
    assert quality_rules.query(odd(spark).limit(0)).count() == 0 and quality_rules.keep(odd(spark).limit(0)).count() == 0


def test_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    kept = quality_rules.query(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "kept", "base_failed")
    rows = kept.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.95 * sum(r.quality == 0 for r in rows)


URLS = [
    ("http://A.COM/x", "com/", "allow"), ("http://com", None, "allow"), ("https://www.example.com/en/1", "www.example.com/en/", "allow"), ("https://x.example.com/en/", "example.com/en/", "block"), ("https://b.net/es/2?x", "net/es/", "block"),
    ("http://b.net/es", None, "allow"), ("nourl", None, "allow"), (None, None, "allow"), ("http://www.example.com/fr/?a", "com/", "allow"), ("http://xcom/", None, "allow"), ("s://user@com:80/", None, "allow"), ("a://b.com#/x", None, "allow"), ("://com/", "com/", "allow"), ("x://com/?y://net/es/", "com/", "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "verdict") for i, (u, _, _) in enumerate(URLS)], "page_id long, url string, rule string")
    rows = sorted(url_filter.query(pages).collect())
    assert [(r.rule, r.verdict) for r in rows] == [(r, v) for _, r, v in URLS]
    assert (rows[0].host, rows[0].path, rows[6].host, rows[10].host, rows[11].path) == ("a.com", "/x", "", "user@com:80", "")
    assert url_filter.query(pages.limit(0)).count() == 0


def test_trie_equals_a_scan_of_all_rules():
    rng = random.Random(2)
    hosts, parts = ["com", "e.com", "w.e.com", "net", "e.net"], ["/", "/a", "/a/", "/a/b", "/ab/", "", "/a/b/"]
    for _ in range(60):
        rules = [(rng.choice(["allow", "block"]), rng.choice(hosts) + rng.choice(parts)) for _ in range(rng.randint(1, 8))]
        trie = url_filter.Trie(rules)
        for _ in range(40):
            host, path = rng.choice([*hosts, "x.w.e.com", "y.net", "z"]), rng.choice([*parts, "/a/b/c", "/abc", "/b"])
            fits = []
            for verdict, rule in rules:
                h, slash, p = rule.partition("/")
                if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                    fits.append((len(h.split(".")), len(slash + p), verdict == "block", rule, verdict))
            want = max(fits)[3:] if fits else (None, "allow")
            assert trie.judge(host, path) == want, (rules, host, path)


def _shards(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots


def test_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    rows = sharding.query(docs).collect()
    assert set(_shards(rows)) <= set(range(24)) and len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 24)


@pytest.mark.parametrize("n", [1, 2, 5, 12, 13, 24, 31])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    placed = ids.select(sharding.descent(sharding._key(), sharding.Tree(n)).alias("a"), sharding.descent(sharding._key(), sharding.Tree(n + 1)).alias("b")).collect()
    assert all(r.b in (r.a, n) for r in placed)
    count = Counter(r.b for r in placed)
    assert set(count) == set(range(n + 1)) and max(count.values()) < 1.6 * 4000 / (n + 1)


def test_weights_move_rows_only_into_or_out_of_their_subtree(spark):
    ids = spark.range(6000).withColumnRenamed("id", "doc_id")
    trees = [sharding.Tree(24), sharding.Tree(24, rack_weights={1: 3.0}), sharding.Tree(24, region_weights={1: 0.5}), sharding.Tree(24, shard_weights={7: 0.0})]
    rows = ids.select(*(sharding.descent(sharding._key(), t).alias(f"t{i}") for i, t in enumerate(trees))).collect()
    for r in rows:
        assert r.t1 == r.t0 or r.t1 // 4 == 1 != r.t0 // 4
        assert r.t2 == r.t0 or r.t0 >= 12 > r.t2
        assert r.t3 == r.t0 or r.t0 == 7 != r.t3
    share = sum(r.t1 // 4 == 1 for r in rows) / len(rows)
    assert abs(share - 3 / 10) < 0.03  # three fifths of its region


def shard_by_brute_force(key, tree):
    """Every arrival of every region, down the tree."""

    def draw(level, node, arrival):
        bits = int(hashlib.md5(f"{key}|{level}|{node}|{arrival}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2**52)

    def least(level, nodes, weights, arrival):
        return min(((draw(level, c, arrival) / weights.get(c, 1.0), c) for c in nodes if weights.get(c, 1.0) > 0))[1]

    found = []
    for region in range(-(-tree.shards // (tree.rack * tree.region))):
        weight, time = tree.region_weights.get(region, 1.0), 0.0
        for arrival in range(sharding.ARRIVALS if weight else 0):
            time += draw("region", region, arrival) / weight
            rack = least("rack", range(region * tree.region, (region + 1) * tree.region), tree.rack_weights, arrival)
            shard = least("shard", range(rack * tree.rack, (rack + 1) * tree.rack), tree.shard_weights, arrival)
            if shard < tree.shards:
                found.append((time, shard))
                break
    return min(found)[1] if found else least("leaf", range(tree.shards), tree.shard_weights, 0)


@pytest.mark.parametrize("tree", [sharding.Tree(1), sharding.Tree(5), sharding.Tree(24), sharding.Tree(25), sharding.Tree(40, 2, 3, {3: 0.0, 5: 2.5}, {2: 4.0}, {0: 2.0, 3: 0.0, 6: 0.5})], ids=str)
def test_descent_equals_brute_force(spark, tree):
    rows = spark.range(700).select(F.col("id").alias("doc_id")).select("doc_id", sharding.descent(sharding._key(), tree).alias("s")).collect()
    assert [r.s for r in rows] == [shard_by_brute_force(str(r.doc_id), tree) for r in rows]


def test_a_clashing_shard_column_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "mine") for i in range(30)], "doc_id long, text string, Shard string")
    out = sharding.with_shards(docs)
    assert out.columns == [*docs.columns, "shard_1"] and {r.Shard for r in out.collect()} == {"mine"}
    sharding.write(docs, f"file://{tmp_path}/c")
    assert spark.read.parquet(f"file://{tmp_path}/c").count() == 30


def test_sharding_takes_odd_rows(spark, tmp_path):
    df = odd(spark, ("shard", "slot", "size"))
    rows = sharding.query(df).collect()
    assert len(rows) == 13
    _shards(rows)
    assert len({(r.shard) for r in rows if r.doc_id == 6}) == 1
    assert sharding.query(df.limit(0)).count() == 0
    sharding.write(odd(spark), f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 13


def test_repeated_rows_get_a_slot_each(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 90)
    docs = spark.createDataFrame([(1, "same")] * 500 + [(2, "other")], "doc_id long, text string")
    rows = sharding.query(docs).collect()
    assert sorted(r.slot for r in rows if r.doc_id == 1 or r.shard == [x.shard for x in rows if x.doc_id == 1][0]) == list(range(len([r for r in rows if r.shard == [x.shard for x in rows if x.doc_id == 1][0]])))


def some_cells(spark, seed=3):
    rng = random.Random(seed)
    cells = [(s, lang, t, float(rng.randint(50, 5000))) for s in "abcd" for lang in ("en", "fr", "de", "es") for t in ("brief", "article", "long")]
    return cells, spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")


@pytest.mark.parametrize("most", [200_000, 10])
def test_raking_meets_all_marginals(spark, monkeypatch, most):
    """In one task, and by joins where there are more cells than one task takes."""
    monkeypatch.setattr(mixing, "MAX_CELLS", most)
    cells, df = some_cells(spark)
    rounds = 30 if most > 10 else 8
    fitted = mixing.fit(df, budget=0.2, rounds=rounds)
    out = fitted.collect()
    total = sum(c[3] for c in cells)
    assert len(out) == len(cells) and all(0 <= r.probability <= 1 for r in out) and math.isclose(sum(r.weight for r in out), 0.2 * total, rel_tol=1e-3)
    for dim in ("lang", "topic"):
        for name, share in mixing.TARGETS[dim].items():
            assert math.isclose(sum(r.weight for r in out if r[dim] == name), share * 0.2 * total, rel_tol=1e-2)
    mass = {s: sum(c[3] for c in cells if c[0] == s) for s in "abcd"}
    roots = sum(math.sqrt(m) for m in mass.values())
    for s in "abcd":
        assert math.isclose(sum(r.weight for r in out if r.source == s), math.sqrt(mass[s]) / roots * 0.2 * total, rel_tol=1e-2)
    told = mixing.report(fitted).collect()
    assert len(told) == 11 and all(abs(r.residual) < 1e-3 and math.isclose(r.weight - r.goal, r.residual * 0.2 * total, abs_tol=1e-6) for r in told)


def test_goals_beyond_what_a_category_has(spark):
    """English has too little for its half: all of it is drawn, and the others share the rest of the budget by their shares."""
    cells = [("s", "en", "t", 100.0), ("s", "fr", "t", 1000.0), ("s", "de", "t", 1000.0), ("s", "xx", "t", 500.0)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")
    out = {r.lang: r.weight for r in mixing.fit(df, {"source": {}, "lang": {"en": 0.5, "fr": 0.3, "de": 0.2, "xx": 0.0}, "topic": {"t": 1.0}}, 0.4).collect()}
    assert out == pytest.approx({"en": 100.0, "fr": 0.6 * (0.4 * 2600 - 100), "de": 0.4 * (0.4 * 2600 - 100), "xx": 0.0})
    with pytest.warns(UserWarning, match="misses its target"):  # the only brief text is English, of which nothing is to be drawn
        docs = spark.createDataFrame([(i, "w " * n, lang, "s", 0) for i, (n, lang) in enumerate([(10, "en"), (60, "fr"), (70, "fr")])], DOCS)
        mixing.plan(docs, targets={"source": None, "lang": {"en": 0.0, "fr": 1.0}, "topic": {"brief": 0.5, "article": 0.5}})


def test_draws_follow_the_probabilities(spark):
    docs = spark.createDataFrame([(i, "w " * (5 + i % 90), ("en", "fr")[i % 2], f"s{i % 2}", 0) for i in range(6000)], DOCS)
    rows = mixing.mix(docs, budget=0.3).collect()
    by_cell = defaultdict(list)
    for r in rows:
        by_cell[r.source, r.lang, r.topic].append(r)
    for held in by_cell.values():
        p = held[0].probability
        got = sum(r.selected for r in held) / len(held)
        assert abs(got - p) < 4 * math.sqrt(p * (1 - p) / len(held)) + 1e-9
    kept = mixing.keep(docs, budget=0.3)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.selected}
    more = {r.doc_id for r in mixing.mix(docs, budget=0.5).collect() if r.selected}
    assert len(more) > len([r for r in rows if r.selected])


def test_mixing_takes_odd_rows(spark):
    df = odd(spark, ("tokens", "weight", "probability", "selected", "now"))
    rows = mixing.mix(df).collect()
    assert len(rows) == 13 and all(0 <= r.probability <= 1 for r in rows)
    assert mixing.keep(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.keep(df.limit(0)).count() == 0
    own = mixing.mix(df.withColumn("theme", F.lit(None).cast("string")), topic="theme").collect()
    assert {r.topic for r in own} == {"(none)"}


def test_mixing_stays_in_the_jvm(spark, sf_dir):
    plan = mixing.query(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_a_host_of_many_path_rules():
    rng = random.Random(4)
    rules = [("block" if i % 2 else "allow", f"h.com/{'/'.join(prose(rng, 1 + i % 3))}") for i in range(3000)]
    trie = url_filter.Trie(rules)
    for _ in range(400):
        _, rule = rng.choice(rules)
        path = rule[5:] + rng.choice(["", "x", "/y", "/"])
        fits = [(len(r), v, r) for v, r in rules if path.startswith(r[5:])]
        longest = max(f[0] for f in fits)
        want = "block" if ("block" in {v for n, v, _ in fits if n == longest}) else "allow"
        assert trie.judge("www.h.com", path) == (next(r for n, _, r in fits if n == longest), want)
