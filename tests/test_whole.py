"""Queries that do the whole job, held against other forms of it."""

import json
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval
from quern.queries import QUERIES, structured, table, vectors

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_payload_escapes_like_json(spark):
    texts = ['say "hi"', "a\nb\r\n", "back\\slash", "\t", "\x01\x1f\x7f", "é€😀 ", "</s>/", "", "plain", None]
    rows = structured.payloads(spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")).collect()
    got = {r.item_id: r.payload for r in rows}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = {"prompt": t, "max_tokens": 256}
        assert json.loads(got[i]) == want
        if t is None or t.isprintable():
            assert got[i] == json.dumps(want, ensure_ascii=False, separators=(",", ":"))


@needs_tables
def test_payload_of_every_row(spark):
    rows = QUERIES["request_payload"](spark, DATA).collect()
    texts = {r.item_id: r.text for r in table(spark, DATA, "benchmark").collect()}
    assert len(rows) == len(texts)
    assert {r.item_id: json.loads(r.payload)["prompt"] for r in rows} == texts


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 7)
    monkeypatch.setattr(retrieval, "SLICE", 9)
    rng = np.random.default_rng(4)
    own = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)]
    own += [(60, None), (61, [1.0]), (62, [0.0] * 4), *((70 + i, own[3][1]) for i in range(20))]  # copies tie by key
    frame = spark.createDataFrame(own, "id int, v array<float>").repartition(3)
    got = retrieval.top_k_each(frame.select(F.col("id").alias("qid"), F.col("v").alias("q")), frame, "qid", "q", "id", "v", 4)

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6) + 0.0

    want = {(q, key, score, rank) for q, v in own for rank, (score, key) in enumerate(sorted(((cosine(v, w), i) for i, w in own), key=lambda x: (-x[0], x[1]))[:4], 1)}
    assert {tuple(r) for r in got.collect()} == want


RANKED = vectors.RANKED
FOUND = f"WITH r AS ({RANKED}), t AS (SELECT r.qid, r.rank, t.text, regexp_replace(t.text, '[ \\n\\t\\r]+', ' ', 'g') AS flat FROM r JOIN documents t ON t.doc_id = r.vec_id)"
WHOLE = {
    "retrieval_chain": "SELECT qid, string_agg(text, chr(10) ORDER BY rank) AS context, count(*) AS n FROM t WHERE rank <= 3 GROUP BY qid",
    "contexts": "SELECT qid, rank, text AS context FROM t WHERE rank <= 5",
    "stuff_prompt": "SELECT qid, '<facts>' || string_agg('<fact>' || flat || '</fact>', '' ORDER BY rank) || '</facts>' AS prompt FROM t WHERE rank <= 3 GROUP BY qid",
    "rag_end_to_end": "SELECT qid, 'Results: ' || string_agg(flat, ' ' ORDER BY rank) AS prompt FROM t WHERE rank <= 3 GROUP BY qid",
}


@needs_tables
@pytest.mark.parametrize("name", WHOLE)
def test_whole_retrieval(name, spark):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    want = con.sql(f"{FOUND} {WHOLE[name]}")
    assert sorted(tuple(r[c] for c in want.columns) for r in rows) == sorted(want.fetchall())
    assert len({r.qid for r in rows}) > 5
    if "answer" in df.columns:
        assert all(r.answer == " ".join(r.prompt.split()[:256]) for r in rows)
