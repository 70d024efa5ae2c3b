"""Model adapters, knowledge bases, logs, crews and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import models as M
from quern.functions import text as T
from quern.operators import chain, retrieval
from quern.plans import knowledge
from quern.plans.tasks import crew
from quern.streaming.memory import history_stream, with_history

NOW = M.Retry(3, (0.0, 0.0))


def test_call_model(spark):
    model = M.CallModel(lambda texts, params: [f"{t}!{params.max_tokens}" for t in texts], M.Params(max_tokens=7), NOW, batch=2)
    rows = spark.createDataFrame([("a",), (None,), ("b",), ("",), ("c",)], "t string").coalesce(1)
    assert [r.x for r in rows.select(model(F.col("t")).alias("x")).collect()] == ["a!7", None, "b!7", "!7", "c!7"]
    short = M.CallModel(lambda texts, params: texts[1:], retry=NOW)
    with pytest.raises(Exception, match="answers to"):
        rows.select(short(F.col("t"))).collect()


def test_call_embedder(spark):
    rows = spark.createDataFrame([("ab",), (None,)], "t string")
    good = M.CallEmbedder(lambda texts: [[len(t), 1] for t in texts], 2, NOW)
    assert [r.v for r in rows.select(good(F.col("t")).alias("v")).collect()] == [[2.0, 1.0], None]
    with pytest.raises(Exception, match="without 3 entries"):
        rows.select(M.CallEmbedder(lambda texts: [[1, 2] for _ in texts], 3, NOW)(F.col("t"))).collect()


def test_retry():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "yes"

    assert NOW.run(flaky) == "yes" and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        M.Retry(2, (0, 0)).run(flaky)


def test_entities(spark):
    text = "Dr. Ann Lee, CEO of Blue Bank (NASDAQ AAPL, $XYZ), paid $1,200.50 on May 3, 2024 at Hill Hospital near Rome for 30 percent."
    got = spark.range(1).select(M.entities(F.lit(text)).alias("e")).first().e
    assert got["STOCK_CODE"] == ["NASDAQ:AAPL", "UNKNOWN:XYZ"] and got["PERSON"] == ["Ann Lee"] and got["PERSON_TITLE"] == ["CEO"]
    assert got["MONETARY_VALUE"] == ["$1,200.50"] and got["DATE"] == ["May 3, 2024"] and got["FACILITY"] == ["Hill Hospital"] and "Rome" in got["LOCATION"] and got["QUANTITY"] == ["30 percent"]
    assert spark.range(1).select(M.entities(F.lit("")).alias("e")).first().e == {}
    asked = json.loads(spark.range(1).select(M.question_metadata(F.lit("Tell me of Blue Bank")).alias("m")).first().m)
    assert asked == {"questionType": "Inquiry", "entities": {"ORGANIZATION": ["Blue Bank"]}}
    assert json.loads(spark.range(1).select(M.sentiment_json(F.lit("good dogs, Dogs and cats")).alias("m")).first().m) == {"sentiment": "positive", "subject": "dogs"}


def test_bpe_tokens(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    texts = ["hello world", "", None, "it's  naïve\n"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(T.bpe_tokens(F.col("t"), path).alias("t")).collect()]
    plain = tokenizers.Tokenizer.from_file(path)
    assert got == [None if t is None else [plain.decode([i]) for i in plain.encode(t, add_special_tokens=False).ids] for t in texts]
    assert "".join(got[0]) == "hello world"


def test_knowledge_base(spark, tmp_path):
    kb = knowledge.KnowledgeBase.create(spark, str(tmp_path / "kb"), knowledge.Config("n", dimension=4, max_tokens=3, overlap=0.0))
    docs = spark.createDataFrame([(1, "a b c d e", "x"), (2, "", None), (3, None, "y"), (4, "z", None)], "i int, t string, s string")
    assert kb.jobs().count() == 0
    job = kb.ingest(docs, M.HashEmbedder(4), "i", "t", ["s"])
    assert kb.wait(job) == knowledge.COMPLETE
    assert sorted((r.id, r.chunk_no, r.text, json.loads(r.text_metadata)["s"]) for r in kb.chunks().collect()) == [(1, 0, "a b c", "x"), (1, 1, "d e", "x"), (4, 0, "z", None)]
    with pytest.raises(Exception, match="without 4 entries"):
        kb.ingest(docs, M.HashEmbedder(5), "i", "t", ["s"])
    assert sorted(r.status for r in kb.jobs().collect()) == [knowledge.COMPLETE, knowledge.FAILED]
    assert kb.chunks().count() == 3  # nothing of the failed job
    row = kb.describe().first()
    assert (row.name, row.dimension, row.jobs, row.chunks) == ("n", 4, 1, 3) and kb.config().max_tokens == 3
    with pytest.raises(TimeoutError):
        kb.wait("none", timeout=0.1, every=0.05)
    with pytest.raises(Exception, match="(?i)exists"):
        knowledge.KnowledgeBase.create(spark, str(tmp_path / "kb"), knowledge.Config("again"))
    knowledge.remember(spark, str(tmp_path / "vars"), "kb_id", job)
    knowledge.remember(spark, str(tmp_path / "vars"), "kb_id", "new")
    assert knowledge.recall(spark, str(tmp_path / "vars"), "kb_id") == "new"


def test_dimension(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>")
    assert retrieval.checked_dimension(rows.limit(1), "v", 2).count() == 1
    with pytest.raises(Exception, match="without 2 entries"):
        retrieval.checked_dimension(rows, "v", 2).collect()


def test_steps(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    add = chain.lifted(lambda n, t: f"{t}{n}", "string")
    assert [r.x for r in rows.select(add("n", "t").alias("x")).collect()] == ["a1", "None2"]
    times = lambda df, config: df.withColumn("m", F.col("n") * config["by"])
    log = str(tmp_path / "log")
    out = rows.transform(chain.pipe(chain.configured(times, by=3), chain.logged(F.col("t"), log, "one"), chain.logged(F.col("n").cast("string"), log, "two")))
    assert [r.m for r in out.collect()] == [3, 6]
    assert sorted((r.step, r.prompt or "") for r in spark.read.parquet(log).collect()) == [("one", ""), ("one", "a"), ("two", "1"), ("two", "2")]


def test_crew_hands_over(spark):
    agents = [{"role": "a", "goal": "g", "backstory": "b"}, {"role": "c", "goal": "h"}]
    tasks = [{"agent": "a", "description": "do {x}", "expected_output": "y"}, {"agent": "c", "description": "go", "expected_output": "{x}"}]
    loud = M.CallModel(lambda texts, params: [t.upper() for t in texts], retry=NOW)
    row = crew(spark.createDataFrame([(1, "q")], "id int, x string"), agents, tasks, {"x": F.col("x")}, loud, manager=lambda c: F.concat(c, F.lit("."))).first()
    assert [o.output for o in row.outputs][0] == "A: G B\nDO Q\nEXPECTED: Y." and row.id == 1
    assert row.outputs[1].prompt == "c: h\ngo\nExpected: q\na said: A: G B\nDO Q\nEXPECTED: Y."
    with pytest.raises(KeyError):
        crew(spark.range(1), agents, tasks, {}, loud)


def test_history_of_a_stream(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    first = spark.createDataFrame([(1, 2, "a", "two"), (1, 1, "u", "one"), (2, 1, "u", None)], schema)
    then = spark.createDataFrame([(1, 3, "u", "three"), (2, 2, "a", "x")], schema)
    first.write.mode("append").parquet(str(tmp_path / "in"))
    q = history_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("history_test").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    then.write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    want = with_history(first.unionByName(then)).select("conv_id", "turn", "history")
    assert sorted(map(tuple, spark.table("history_test").collect())) == sorted(map(tuple, want.collect()))


def test_crew_models_once(spark):
    """The plan grows with the tasks, not with the ways an output may be handed over."""
    from quern.queries import QUERIES

    plan = QUERIES["crew_run"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join") == 8
