"""Traps of the operators on literals."""

import pytest
from pyspark.sql import functions as F

from quern.functions import jsonx as J
from quern.functions import text as T
from quern.functions import vector as V
from quern.operators import chain, template
from quern.operators.filters import compile_filter
from quern.plans import gremlin
from quern.plans.graph import Graph, facts, parse, provenance
from quern.plans.tasks import plan
from quern.sources.files import load_graph_csv, metadata_docs, read_csv, read_jsonl, read_texts, with_line_index
from quern.streaming.memory import monitored


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_chain_values(spark):
    num = F.lit(1)
    row = spark.range(1).transform(chain.parallel(passed=num, mult=num * 3, modified=num + 1)).first()
    assert tuple(row) == (1, 3, 2)
    row = spark.range(1).transform(chain.parallel(a=F.length(F.lit("bar")), b=F.length(F.lit("bar")) * F.length(F.lit("gah")))).first()
    assert tuple(row) == (3, 9)


def test_branch_order(spark):
    c = F.lit("one two")
    assert one(spark, chain.branch([(c.contains("one"), F.lit("a")), (c.contains("two"), F.lit("b"))], F.lit("c"))) == "a"
    assert one(spark, chain.branch([], F.lit("c"))) == "c"


def test_configurable_rejects_unknown():
    m = chain.Configurable({"a": F.lower}, "a")
    with pytest.raises(KeyError):
        m.with_config(model="b")(F.lit("x"))
    assert m.config == {}


def test_template(spark):
    assert one(spark, template.compiled("{a} {{a}} {b}", {"a": F.lit("{b}"), "b": "x", "c": "unused"})) == "{b} {a} x"
    with pytest.raises(KeyError):
        template.compiled("{missing}", {})


def test_filter_on_strings(spark):
    spec = {"andAll": [{"greaterThan": {"key": "n", "value": 2}}, {"lessThan": {"key": "n", "value": 30}}]}
    df = spark.createDataFrame([("3",), ("nan",), (None,), ("x",), ("30",), ("29.5",)], "n string")
    assert [r.n for r in df.where(compile_filter(spec, F.col)).collect()] == ["3", "29.5"]
    with pytest.raises(ValueError):
        compile_filter({"orAll": []}, F.col)


def test_vectors(spark):
    a, b, z = (F.array(*map(F.lit, v)) for v in ([1.0, 2.0], [2.0, 4.0], [0.0, 0.0]))
    assert one(spark, F.round(V.cosine(a, b), 6)) == 1.0
    assert one(spark, V.dot(a, b)) == 10.0
    assert one(spark, V.cosine(a, z)) == 0.0


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 18, 19, 100])
def test_fixed_chunks_cover(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = one(spark, T.fixed_chunks(F.lit(" ".join(words)), 10))
    step = T.chunk_step(10)
    assert got == ([" ".join(words[i : i + 10]) for i in range(0, max(1, n - 10 + step), step)] if n else [])


def test_sentence_chunks_against_a_loop(spark):
    text = "One two three. Four five! Six seven eight nine ten eleven. A? B. C."
    done, now = [], []
    for s in [x.split() for x in ("One two three.", "Four five!", "Six seven eight nine ten eleven.", "A?", "B.", "C.")]:
        if now and len(now) + len(s) > 5:
            done.append(" ".join(now))
            now = []
        now = now + s
    assert one(spark, T.sentence_chunks(F.lit(text), 5)) == [*done, " ".join(now)]
    assert one(spark, T.sentence_chunks(F.lit(""), 5)) == []


def test_json(spark):
    assert one(spark, J.parse_or_repair(F.lit("{foo: bar}"))).asDict() == {"ok": True, "value": '{"foo": "bar"}'}
    assert one(spark, J.parse_or_repair(F.lit("{"))).ok is False
    f = {"a": "boolean"}
    assert one(spark, J.typed_verdict(F.lit('{"a": true, "b": 1}'), f)).a is True
    assert one(spark, J.typed_verdict(F.lit('{"a": true, "b": 1}'), f, strict=True)) is None
    assert one(spark, J.typed_verdict(F.lit("{}"), f)) is None
    m = F.create_map(F.lit("ORG"), F.array(F.lit("x"), F.lit(None)))
    assert one(spark, J.contains_any(m, "ORG", ["x"])) is True
    assert one(spark, J.contains_any(m, "PERSON", ["x"])) is False


def test_stop(spark):
    assert one(spark, T.stop_at(F.lit("ab;cd,ef"), [",", ";"])) == "ab"


@pytest.fixture
def graph(spark):
    v = [("d1", "DOCUMENT", "doc_0"), ("d2", "DOCUMENT", "doc_1"), ("e1", "BUY", "e1"), ("e2", "SELL", "e2"), ("a", "ORG", "A"), ("b", "PERSON", "B"), ("c", "ORG", "C")]
    e = [("1", "d1", "e1", "EVENT"), ("2", "d2", "e2", "EVENT"), ("3", "e1", "a", "BUYER"), ("4", "e1", "b", "AGENT"), ("5", "e2", "b", "AGENT"), ("6", "e2", "c", "SELLER")]
    return Graph(
        spark.createDataFrame([(i, [x], [n], n) for i, x, n in v], "id string, labels array<string>, names array<string>, primary_name string"),
        spark.createDataFrame(e, "edge_id string, src string, dst string, type string"),
    )


def test_parse():
    hops, labels = parse("(a)<-[r:X]-(b)-[]->(:ORG), (b)<-[x]-(d:DOC)")
    assert [(h.src, h.dst, h.kind) for h in hops][0] == ("b", "a", "X")
    assert "DOC" in labels.values() and len(hops) == 3
    with pytest.raises(ValueError):
        parse("(a)-[r]-(b)")


def test_facts_by_hand(graph):
    got = {tuple(r) for r in facts(graph, graph.named("A", "ORG")).collect()}
    assert got == {
        ("Event Type was BUY involving A in the role of BUYER and B in the role of AGENT. ", "doc_0"),
        ("Event Type was SELL involving B in the role of AGENT and C in the role of SELLER.", "doc_1"),
    }
    assert facts(graph, graph.named("A", "ORG"), graph.named("nobody", "ORG")).count() == 0


def test_edges_are_distinct(graph):
    m = graph.match("(x)<-[r]-(e)-[s]->(y)", graph.named("A", "ORG").select(F.col("id").alias("x")))
    assert [(r.x, r.y) for r in m.collect()] == [("a", "b")]


def test_optional_keeps_rows(graph):
    m = graph.match("(e)-[r:AGENT]->(y)", graph.edges.where("type = 'EVENT'").select(F.col("dst").alias("e")), optional=True, where=F.col("e") == "e1")
    assert sorted((r.e, r.y) for r in m.collect()) == [("e1", "b"), ("e2", None)]


def test_provenance(spark, graph):
    lines = spark.createDataFrame([(0, "u0")], "line_index long, uri string")
    f = facts(graph, graph.named("A", "ORG"))
    assert [r.uri for r in provenance(f, lines).collect()] == ["u0"]
    with pytest.raises(Exception, match="no source line"):
        provenance(f, lines, strict=True).collect()


def test_gremlin_refuses(graph):
    with pytest.raises(ValueError):
        gremlin.run(graph, "__import__('os')")
    with pytest.raises(ValueError):
        gremlin.run(graph, "g.V().drop()")
    assert gremlin.answer(graph, "sing a song") is None
    assert gremlin.steps("g.V().has('name', who).limit(3)", {"who": "O'Hara (x).drop()"}) == [("V", []), ("has", ["name", "O'Hara (x).drop()"]), ("limit", ["3"])]
    assert gremlin.steps("g.V().has('a.b(', \"it's\")")[1] == ("has", ["a.b(", "it's"])
    assert gremlin.traversal_of("how many route does O'Hara (x) have?")[1] == {"a": "route", "b": "O'Hara (x)"}


def test_kept_graph_matches_alike(graph):
    kept = Graph.kept(graph.vertices, graph.edges)
    assert {tuple(r) for r in facts(kept, kept.named("A", "ORG")).collect()} == {tuple(r) for r in facts(graph, graph.named("A", "ORG")).collect()}
    anchored = kept.anchored("x", "(x)<-[r]-(e)-[s]->(y)", kept.named("A", "ORG"))
    assert [(r.x, r.y) for r in anchored.collect()] == [("a", "b")]
    assert "EqualTo(dst,a)" in anchored._jdf.queryExecution().executedPlan().toString() or "In(dst" in anchored._jdf.queryExecution().executedPlan().toString()
    assert kept.anchored("x", "(x)<-[r]-(e)", kept.named("nobody", "ORG")).count() == 0
    names = graph.with_names(graph.edges.where("edge_id = '3'").select("src", "dst").withColumn("gone", F.lit("zz")), "src", "dst", "gone").first()
    assert (names.src_name, names.src_label, names.dst_name, names.gone_name) == ("e1", "BUY", "A", None)


def test_plan_needs_inputs(spark):
    with pytest.raises(KeyError):
        plan(spark, [{"role": "a", "goal": "g"}], [{"agent": "a", "description": "{x}", "expected_output": "y"}], {})


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,minutes\n"two\nlines, ""q""",5\nx,\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), "name string, minutes long").collect()] == [('two\nlines, "q"', 5), ("x", None)]
    (tmp_path / "a.jsonl").write_text('{"m": {"W-U": "u1"}}\n{"m": {"W-U": "u2"}}\n')
    rows = with_line_index(read_jsonl(spark, str(tmp_path / "a.jsonl"), "m struct<`W-U`: string>"))
    assert [(r.line_index, r.m["W-U"]) for r in rows.collect()] == [(0, "u1"), (1, "u2")]
    assert sorted(r.line_index for r in with_line_index(spark.range(10).repartition(3)).collect()) == list(range(10))
    (tmp_path / "v.csv").write_text("~id,~label,name\n1,person,Alice\n2,person;boss,Bob\n")
    (tmp_path / "e.csv").write_text("~id,~from,~to,~label\nx,1,2,knows\n")
    v, e = load_graph_csv(spark, str(tmp_path / "v.csv"), str(tmp_path / "e.csv"))
    g = Graph(v, e)
    assert [r.value for r in gremlin.run(g, "g.V().has('name','Alice').out('knows').values('name')").collect()] == ["Bob"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.txt").write_text("a\nb")
    (tmp_path / "t" / "1.md").write_text("no")
    assert [r.text for r in read_texts(spark, str(tmp_path / "t"), "*.txt").collect()] == ["a\nb"]
    docs = metadata_docs(spark.createDataFrame([(1, "d", None)], "id int, text string, n int"), "text", ["n"], "id", 10).first()
    assert tuple(docs) == ("doc_1.txt", "d", '{"metadataAttributes":{"n":"nan"}}')


def test_stream_of_events(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)], "ts string, event_type string, value double")
    batch = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = monitored(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("monitored_test").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("monitored_test").collect())) == sorted(map(tuple, monitored(batch).collect()))
