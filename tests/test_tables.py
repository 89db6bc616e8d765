"""The DataFrame operators against the document model and DuckDB."""

import json

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadloom.api import NQUADS, Processor
from quadloom.model import iri as I
from quadloom.model import rdf as model_rdf
from quadloom.model.errors import LinkedDataError
from quadloom.operators import canonize, documents, framing, nodes, rdf
from quadloom.plans import catalogue, table, views
from quadloom.schema import NODES
from quadloom.sources import nquads
from quadloom.streaming import documents_of, table_quads
from quadloom import functions as L

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_catalogue(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    if name in catalogue.oracle_sql():
        want = duck.sql(catalogue.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert _rows(df.columns, rows) == _rows(want.columns, want.fetchall())


def test_documents_to_quads_equal_the_model(spark):
    docs = [{"@id": "http://e/1", "http://e/p": ["x", 1, 2.5, True, {"@id": "http://e/2"}, {"@value": "y", "@language": "en"}], "http://e/l": {"@list": ["a", "b"]}}, {"@graph": [{"@id": "http://e/3", "http://e/q": {"http://e/r": "deep"}}], "@id": "http://e/g"}, {}]
    df = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "doc_id string, json string")
    rows = documents.to_nodes(df)
    p = Processor()
    for i, doc in enumerate(docs):
        native = rdf.to_quads(rows.where(F.col("doc_id") == str(i)).drop("doc_id"))
        text = "".join(r[0] + "\n" for r in nquads.lines(native).collect())
        assert p.canonize(text, inputFormat=NQUADS) == p.canonize(doc, safe=False)


def test_verbs_report_errors_and_events(spark):
    rows = [("a", '{"@id": 5}'), ("b", "not json"), ("c", '{"x": 1, "http://e/p": 1}'), ("d", None)]
    out = {r.doc_id: r for r in documents.apply(spark.createDataFrame(rows, "doc_id string, json string"), "expand").collect()}
    assert out["a"].error == "invalid @id value" and out["b"].error == "loading document failed"
    assert out["c"].events == ["invalid property"] and json.loads(out["c"].result) == [{"http://e/p": [{"@value": 1}]}]
    assert out["d"].result is None and out["d"].error is None
    remote = {"http://c/1": '{"@context": {"x": "http://e/x"}}'}
    with_context = spark.createDataFrame([("1", '{"@context": "http://c/1", "x": 1}')], "doc_id string, json string")
    assert json.loads(documents.apply(with_context, "expand", remote=remote).first().result) == [{"http://e/x": [{"@value": 1}]}]


def test_lists_of_any_length_are_rebuilt(spark):
    sizes = [0, 1, 2, 3, 7, 33]
    item = "array<struct<kind:string,value:string,datatype:string,language:string>>"
    rows = [("@default", f"urn:{n}", "urn:p", 0, "list", None, None, None, [("value", str(i), "urn:t", None) for i in range(n)]) for n in sizes]
    back = rdf.rebuilt_lists(rdf.to_quads(spark.createDataFrame(rows, NODES))).collect()
    assert item and {r.subject: [x.value for x in r["items"]] for r in back} == {f"urn:{n}": [str(i) for i in range(n)] for n in sizes}


def test_shared_cells_are_not_rebuilt(spark):
    first, rest, nil = (f"http://www.w3.org/1999/02/22-rdf-syntax-ns#{x}" for x in ("first", "rest", "nil"))
    lines = [f"<e:1> <e:l> _:a .", f'_:a <{first}> "1" .', f"_:a <{rest}> _:b .", f'_:b <{first}> "2" .', f"_:b <{rest}> <{nil}> .", "<e:2> <e:l> _:b ."]
    quads = nquads.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rdf.rebuilt_lists(quads).where("subject = 'e:1'").count() == 0


def test_canonical_text_equals_the_model(spark):
    texts = {"ring": "".join(f"_:r{i} <http://p> _:r{(i + 1) % 4} .\n" for i in range(4)), "easy": '_:x <http://p> "1" .\n_:x <http://q> _:y .\n<http://s> <http://p> _:y <http://g> .\n', "ground": "<http://s> <http://p> <http://o> .\n"}
    quads = documents.parse_quads(spark.createDataFrame(list(texts.items()), "doc_id string, nquads string"))
    got = {r.doc_id: r.nquads for r in canonize.canonize(quads, "doc_id").collect()}
    p = Processor()
    assert got == {k: p.canonize(t, inputFormat=NQUADS) for k, t in texts.items()}


def test_nquads_lines_parse_as_the_model_does(spark):
    lines = ['<a:a> <b:b> "x\\ny \\"q\\" \\\\n \\u00e9\\U0001F600"@EN .', "_:a <b:b> _:c.d <g:g> . # note \"x\"", "", "  # only", '<a:a> <b:b> "1"^^<x:y> _:g .', "<a:a><b:b><c:c>.", '<a:a> <b:b> "" .']
    got = nquads.parsed(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    shown = lambda t: "" if t[0] == "default" else f"_:{t[1]}" if t[0] == "blank" else t[1]
    want = [(shown(g), shown(s), shown(p), o[0], shown(o), o[2] if o[0] == "literal" else None, o[3] if o[0] == "literal" else None) for s, p, o, g in model_rdf.parse_nquads("\n".join(lines))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    with pytest.raises(Exception, match="not N-Quads"):
        nquads.parsed(spark.createDataFrame([("<a:a> <b:b> c .",)], "value string")).collect()


def test_nquads_files(spark, sf_dir, tmp_path):
    quads = catalogue.queries()["r3_tordf_star"](spark, sf_dir)
    nquads.write(quads, f"file://{tmp_path}/q", canonical=True)
    assert nquads.load(spark, f"file://{tmp_path}/q").exceptAll(quads).count() == 0
    with pytest.raises(Exception, match="unknown format"):
        nquads.load(spark, "x", "text/turtle")


def test_iris_in_columns_equal_the_model(spark):
    refs = ["g", "./g", "g/", "/g", "?y", "#s", "", ".", "..", "../g", "../../../g", "g;x=1/../y", "//h/x", "http://z:80/q?x#y", "a//b/../c", "https://z:443"]
    base = "http://a/b/c/d;p?q"
    df = spark.createDataFrame([(r,) for r in refs], "r string")
    got = df.select("r", L.resolved(base, F.col("r")).alias("x"), L.iri_parts(F.col("r")).alias("p"), L.dot_segments_removed(F.col("r")).alias("d"), L.is_absolute(F.col("r")).alias("a")).collect()
    for row in got:
        assert row.x == I.resolve(base, row.r), row
        assert tuple(row.p) == tuple(I.parse(row.r)), row
        assert row.d == I.remove_dot_segments(row.r) and row.a == I.is_absolute(row.r)


def test_merging_keeps_blank_nodes_apart(spark):
    row = lambda s, v: ("@default", s, "urn:p", 0, "ref", v, None, None, None)
    one = spark.createDataFrame([row("_:a", "_:b"), row("urn:1", "_:a")], NODES)
    two = spark.createDataFrame([row("_:a", "_:b"), row("urn:1", "urn:2")], NODES)
    got = {(r.subject, r.value) for r in nodes.merge(one, two).collect()}
    assert got == {("_:0-a", "_:0-b"), ("urn:1", "_:0-a"), ("_:1-a", "_:1-b"), ("urn:1", "urn:2")}
    first = {(r.subject, r.value) for r in nodes.merge_first_wins(one, two).collect()}
    assert ("urn:1", "urn:2") not in first and ("_:1-a", "_:1-b") in first
    said = {r.id: r.has_properties for r in nodes.subjects(one).collect()}
    assert said == {"_:a": True, "urn:1": True, "_:b": False}


@pytest.mark.parametrize("frame", [{"@type": ["http://e/A"]}, {"@type": []}, {"@type": [{}]}, {"@id": ["http://e/1"]}, {"http://e/p": []}, {"http://e/p": [{}]}, {"http://e/p": [{"@value": ["x"]}]}, {"http://e/p": [{"@value": [{}], "@language": ["en"]}]}, {"http://e/q": [{"@type": ["http://e/A"]}]}, {"http://e/p": [], "http://e/q": [{}]}, {"http://e/p": [{"@value": ["x"]}], "http://e/q": [{}]}, {}])
@pytest.mark.parametrize("require_all", [False, True])
def test_filters_equal_the_model(spark, frame, require_all):
    docs = {"@graph": [{"@id": "http://e/1", "@type": "http://e/A", "http://e/p": "x"}, {"@id": "http://e/2", "@type": ["http://e/A", "http://e/B"], "http://e/p": {"@value": "y", "@language": "en"}}, {"@id": "http://e/3", "http://e/q": {"@id": "http://e/1"}}, {"@id": "http://e/4", "http://e/r": 1}]}
    rows = documents.to_nodes(spark.createDataFrame([("1", json.dumps(docs))], "doc_id string, json string")).drop("doc_id")
    got = {r.subject for r in framing.matching(rows, frame, require_all).collect()}
    out = Processor().frame(docs, {**frame, "@embed": "@never", "@requireAll": require_all}, omitGraph=False)
    assert got == {n["@id"] for n in out.get("@graph", [])}


def test_flagship_reads_mapped_columns_only_and_does_not_shuffle(spark, sf_dir):
    df = catalogue.queries()["e11_drop_unmapped"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in plan and "Exchange" not in plan
    assert "Exchange" not in catalogue.queries()["r3_tordf_customer"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_streams(spark, sf_dir, tmp_path):
    from quadloom.plans.views import mapped

    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    customers.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(customers.schema).parquet(f"{tmp_path}/in")
    query = table_quads(stream, mapped("customer")).writeStream.format("memory").queryName("quads_out").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("quads_out").count() == catalogue.queries()["r3_tordf_customer"](spark, sf_dir).count()
    docs = stream.select(F.col("c_custkey").alias("doc_id"), F.to_json(F.struct(F.col("c_name").alias("http://e/name"))).alias("json"))
    query = documents_of(docs, "expand").writeStream.format("memory").queryName("docs_out").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("docs_out").where("error IS NULL").count() == customers.count()


def test_table_values(spark):
    df = spark.createDataFrame([(1, 2.0, 0.1, True, None), (2, 1e21, -3.5, False, "x")], "k int, a double, b double, c boolean, d string")
    m = table.Mapped({"@vocab": "http://e/"}, F.concat(F.lit("urn:"), F.col("k").cast("string")), columns={x: x for x in "abcd"})
    got = {(r.subject, r.property[-1]): (r.value, r.datatype.rpartition("#")[2]) for r in table.nodes(df, m).collect()}
    want = {}
    for k, a, b, c, d in df.collect():
        for name, v in zip("abcd", (a, b, c, d), strict=True):
            if v is not None:
                lit = model_rdf.literal({"@value": v})
                want[f"urn:{k}", name] = (lit[1], lit[2].rpartition("#")[2])
    assert got == want


def test_a_literal_is_no_reference(spark):
    docs = {"@graph": [{"@id": "http://e/1", "@type": "http://e/A"}, {"@id": "http://e/2", "http://e/q": "http://e/1"}, {"@id": "http://e/3", "http://e/q": [{"@id": "http://e/1"}, "http://e/1"], "http://e/r": "x"}]}
    rows = documents.well_formed(documents.to_nodes(spark.createDataFrame([("1", json.dumps(docs))], "doc_id string, json string"))).drop("doc_id")
    found = framing.matching(rows, {"http://e/q": [{"@type": ["http://e/A"]}]})
    assert [r.subject for r in found.collect()] == ["http://e/3"]
    out = framing.tree(rows, rows.select("graph", "subject").distinct().where("subject <> 'http://e/1'"), {"q": ("http://e/q", {"type": "@type"}), "r": "http://e/r"})
    assert sorted((r.subject, r.q, r.type, r.r) for r in out.select("subject", "q", "type", "r").fillna("").collect()) == [("http://e/2", "http://e/1", "", ""), ("http://e/3", "http://e/1", "", "x"), ("http://e/3", "http://e/1", "http://e/A", "x")]


@pytest.mark.parametrize("algorithm", ["sha256", "sha384"])
def test_hash_algorithms_equal_the_model(spark, algorithm):
    texts = {str(n): "".join(f'_:x{i} <http://p> "{i * n}" .\n' for i in range(5)) + "_:r <http://q> _:s .\n_:s <http://q> _:r .\n" * (n % 2) for n in range(1, 4)}
    quads = documents.parse_quads(spark.createDataFrame(list(texts.items()), "doc_id string, nquads string")).drop("error")
    got = {r.doc_id: r.nquads for r in canonize.canonize(quads, "doc_id", algorithm).collect()}
    assert got == {k: Processor().canonize(t, inputFormat=NQUADS, canonizeOptions={"messageDigestAlgorithm": algorithm}) for k, t in texts.items()}
    with pytest.raises(Exception, match="unknown hash algorithm"):
        canonize.canonize(quads, "doc_id", "md5")


def test_escapes_are_read_once_and_written_back(spark):
    lines = [r'<a:a> <b:b> "\\u005Cu0041 \\u0041 x\\u0000y \\\\u0041 \\\\n \\u005C\\u005C" .'.replace("\\\\", "\\")]
    got = nquads.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    want = [o[1] for _, _, o, _ in model_rdf.parse_nquads("\n".join(lines))]
    assert [r.object for r in got.collect()] == want and "\0" in want[0]
    back = [r.nquad for r in nquads.lines(got).collect()]
    assert [o[1] for _, _, o, _ in model_rdf.parse_nquads("\n".join(back))] == want and "\0" not in back[0]


def test_bad_documents_cost_their_own_row(spark):
    deep = '{"http://e/a":' * 1000 + "1" + "}" * 1000
    docs = spark.createDataFrame([("good", '{"@id": "http://e/1", "http://e/a": "{[{["}'), ("bad", '{"@id": 5}'), ("text", "no"), ("deep", deep), ("brackets", "[" * 200_000), (None, None)], "doc_id string, json string")
    want = {"good": None, "bad": "invalid @id value", "text": "loading document failed", "deep": "ld.TooDeep", "brackets": "ld.TooDeep"}
    assert {r.doc_id: r.error for r in documents.to_nodes(docs).collect()} == want
    for verb in ("expand", "to_rdf"):
        assert {r.doc_id: r.error for r in documents.apply(docs, verb).where("doc_id IS NOT NULL").collect()} == want
    level = '{"http://e/a":' * 400 + "1" + "}" * 400
    one = spark.createDataFrame([("x", level)], "doc_id string, json string")
    assert documents.apply(one, "flatten").first().error is None and documents.to_nodes(one).count() == 400
    quads = documents.parse_quads(spark.createDataFrame([("a", "<a:a> <b:b> <c:c> ."), ("b", "no quad")], "doc_id string, nquads string")).collect()
    assert sorted((r.doc_id, r.object, r.error is None) for r in quads) == [("a", "c:c", True), ("b", None, False)]


@pytest.mark.parametrize("base", ["http://a/b/c/d?q", "http://a", "http://a/", "http://a/b/c/", "urn:x"])
def test_relative_references_equal_the_model(spark, base):
    from quadloom.functions.iris import relativized
    from quadloom.model import iri as I

    iris = [f"http://a{p}{t}" for p in ("", "/", "/b", "/b/", "/b/c", "/b/c/", "/b/c/d", "/b/c/d/e", "/b/../x", "//y") for t in ("", "?q", "#f", "?q#f")] + ["http://z/b", "https://a/b/c/d", "urn:x:y", "no", ""]
    rows = spark.createDataFrame([(i,) for i in iris], "i string")
    assert [(r.i, r.r) for r in rows.select("i", relativized(base, F.col("i")).alias("r")).collect()] == [(i, I.relativize(base, i)) for i in iris]


@pytest.mark.parametrize("name", ["r15_canon_ground", "r3_tordf_customer", "r3_tordf_star", "r9_fromrdf", "s10_nquads_roundtrip"])
def test_balances_of_either_zero(spark, sf_dir, tmp_path, name):
    """Zeros of both signs in one batch: their texts differ, as in SQL."""
    c = duckdb.connect()
    c.sql(f"COPY (SELECT * REPLACE (CASE c_custkey % 4 WHEN 1 THEN '-0.0'::DOUBLE WHEN 2 THEN 0 ELSE c_acctbal END AS c_acctbal) FROM '{sf_dir}/customer.parquet') TO '{tmp_path}/customer.parquet'")
    for t in ("nation", "region"):
        c.sql(f"COPY (FROM '{sf_dir}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    for t in ("customer", "nation", "region"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = catalogue.queries()[name](spark, str(tmp_path))
    rel = c.sql(catalogue.oracle_sql()[name])
    assert _rows(df.columns, df.collect()) == _rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", ["r3_tordf_customer", "r3_tordf_star", "r9_fromrdf"])
def test_balances_between_two_texts(spark, sf_dir, tmp_path, name):
    """A balance exactly between two texts of 16 digits takes the even one, as in SQL, on either side of zero."""
    c = duckdb.connect()
    c.sql(f"COPY (SELECT * REPLACE ((CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END) * (1024 + c_custkey + (2 * c_custkey + 1) / 8192) AS c_acctbal) FROM '{sf_dir}/customer.parquet') TO '{tmp_path}/customer.parquet'")
    for t in ("nation", "region"):
        c.sql(f"COPY (FROM '{sf_dir}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    for t in ("customer", "nation", "region"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = catalogue.queries()[name](spark, str(tmp_path))
    rel = c.sql(catalogue.oracle_sql()[name])
    assert _rows(df.columns, df.collect()) == _rows(rel.columns, rel.fetchall())


def test_balances_that_are_no_numbers_are_kept(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.5), (4, float("-inf"))], "c_custkey long, c_acctbal double")
    rows = df.selectExpr("c_custkey", "'x' AS c_name", "1 AS c_nationkey", "c_acctbal", "'y' AS c_mktsegment")
    out = table.nodes(rows, views.mapped("customer")).where(F.col("property") == views.EX + "balance").select("subject", "value")
    assert sorted(map(tuple, out.collect())) == [("urn:customer:1", "NaN"), ("urn:customer:3", "1.5E0"), ("urn:customer:4", "-Infinity")]


def test_documents_of_one_task_are_dealt_to_all_cores(spark):
    docs = spark.range(200).coalesce(1).select(F.col("id").cast("string").alias("doc_id"), F.format_string('{"@id": "urn:%d", "http://e/p": 1}', "id").alias("json"))
    for out in (documents.apply(docs, "expand"), documents.to_nodes(docs)):
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 4 and sum(r["count"] for r in sizes) == 200


def test_node_sizes_by_one_shuffle(spark):
    """Distinct values are told apart by every part, nulls included, and lists are never equal; the rows are shuffled once."""
    row = lambda g, s, p, k, v, d=None, lang=None: (g, s, p, 0, k, v, d, lang, None)
    rows = [
        row("@default", "s", "a", "value", "1", "x"), row("@default", "s", "a", "value", "1", "x"), row("@default", "s", "a", "value", "1", "y"), row("@default", "s", "a", "ref", "1"),
        row("@default", "s", "a", "value", "1", "x", "en"), row("@default", "s", "b", "value", "-"), row("@default", "s", "b", "value", ""), row("@default", "s", "b", "value", None),
        row("@default", "s", "l", "list", None), row("@default", "s", "l", "list", None), row("g:1", "s", "a", "value", "1", "x"), row("@default", "t", "1:a", "value", "4:list"), row("@default", "t", "1:a", "value", "4:list"),
    ]
    out = nodes.node_sizes(spark.createDataFrame(rows, NODES).repartition(3))
    assert {(r.graph, r.subject): (r.n_properties, r.n_values) for r in out.collect()} == {("@default", "s"): (3, 9), ("g:1", "s"): (1, 1), ("@default", "t"): (1, 1)}
    plan = nodes.node_sizes(spark.range(9).select(F.lit("@default").alias("graph"), F.col("id").cast("string").alias("subject"), *(F.lit("x").alias(c) for c in ("property", "kind", "value", "datatype", "language"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_documents_go_through_stages_in_groups():
    said = []

    def steps(name):
        said.append(f"{name}1")
        yield
        if name == "b":
            raise LinkedDataError("no", code="bad")
        said.append(f"{name}2")
        yield
        return name.upper()

    runs = [lambda: steps("a"), lambda: steps("b"), lambda: "at once", lambda: steps("c")]
    assert documents._together(runs) == [("A", None), (None, "bad"), ("at once", None), ("C", None)]
    assert said == ["a1", "b1", "c1", "a2", "c2"]
    texts = ["x"] * 130 + [None, "y" * (documents.TOGETHER_CHARS + 1), "z", "y" * documents.TOGETHER_CHARS]
    batch = pa.record_batch({"doc_id": [str(i) for i in range(len(texts))], "json": pa.array(texts, pa.string())})
    groups = list(documents._groups(batch))
    assert [x for g in groups for x in g] == [(str(i), t) for i, t in enumerate(texts)]
    assert [len(g) for g in groups] == [64, 64, 3, 1, 1, 1]


def test_framed_groups_equal_framed_documents(spark):
    """Those that fail at any stage keep their own row, whatever is framed with them."""
    frame = {"@context": {"@vocab": "http://e/"}, "@type": "T", "of": {}}
    texts = {str(i): json.dumps({"@graph": [{"@id": f"urn:{i}", "@type": "T", "of": {"@id": "_:b", "n": i}}, {"@id": "urn:x", "n": 1}]}) for i in range(150)}
    texts |= {"none": None, "text": "no", "id": '{"@id": 5}', "index": '{"@graph": [{"@id": "urn:1", "@index": "a"}, {"@id": "urn:1", "@index": "b"}]}'}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, json string").repartition(1)
    out = {r.doc_id: r for r in documents.apply(docs, "frame", frame=frame, expandContext={"@vocab": "http://e/"}).collect()}
    assert {n: r.error for n, r in out.items() if r.error} == {"text": "loading document failed", "id": "invalid @id value", "index": "conflicting indexes"}
    assert out.keys() == texts.keys() and out["none"].result is None
    p = Processor()
    for i in range(150):
        assert json.loads(out[str(i)].result) == p.frame(json.loads(texts[str(i)]), frame, expandContext={"@vocab": "http://e/"}), i
