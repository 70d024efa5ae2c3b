"""Each registered query over its whole table, and models against plain forms of themselves."""

import math
import zlib
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
from quern.llm import quality, toxicity

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
COLUMNS = {
    "op1_": "doc_id held_out score predicted", "op2_": "doc_id held_out score predicted", "op3_": "doc_id start n_tokens ids_crc32", "op4_": "doc_id piece start length ids_crc32 sequence_id offset", "op5_": "doc_id fingerprint component_id",
    "op6_": "doc_id n_assign n_access n_hex base_sha256 spans", "op7_": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op8_": "page_id url text n_chars",
    "op9_": "doc_id n_words n_hit n_items items_sha256 contaminated", "op10_": "doc_id held_out n_tokens n_known train_tokens base_score score", "pipeline": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.mark.parametrize("prefix", COLUMNS)
def test_query(spark, prefix):
    (name,) = (n for n in entry.queries() if n.startswith(prefix))
    rows = entry.queries()[name](spark, SMALL)
    assert rows.columns[: len(COLUMNS[prefix].split())] == COLUMNS[prefix].split()
    got = rows.collect()
    source, key = ("pages", "page_id") if prefix == "op8_" else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{SMALL}/{source}.parquet").select(key).collect()}
    assert {r[key] for r in got} <= ids if prefix == "pipeline" else {r[key] for r in got} == ids
    assert got and (prefix in ("op4_", "pipeline") or len(got) == len(ids))
    if prefix == "op9_":
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        want = con.sql(entry.oracle_sql()[name])
        assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall())


@pytest.mark.skipif(not Path(LARGE).exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    """Of rows that neither model saw."""
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    model = toxicity.fitted(docs, labels)
    said = [(model.score(r.text or "") >= 0.3, r.toxic) for r in held]
    toxic, clean = [a for a, y in said if y], [a for a, y in said if not y]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    got = quality.fitted(docs, labels).score(np.array([quality.statistics(r.text or "") for r in held]))
    assert np.mean((got >= 0.5) == np.array([r.quality == 1 for r in held])) > 0.98


def test_a_score_is_the_sum_of_its_features():
    words = "you are a fine person and not a fool"
    model = toxicity.Toxicity([f"{words} {w}" for w in ("scum", "vile", "kind", "calm") * 20], [1, 1, 0, 0] * 20)
    for text in ("you scum", "y0u sc um", "kind", "", "v!le v i l e"):
        z = model.bias
        for f in toxicity.features(model.restorer.words(text)):
            z += model.weights.get(f, 0.0)
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)))
    assert model.score("you scum") > 0.5 > model.score("you calm") and model.score("v i l e") > 0.5


def test_pairs_by_brute_force():
    """The fitted weights against the same descent with a loop over every pair."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(14, 3)), np.array([1] * 8 + [0] * 6)
    x[:8, 0] += 1.5
    model = quality.BradleyTerry(x, y, steps=3)
    z = model.spread(x)
    w, v = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    rate = 1.0 / np.square(z - z.mean(0)).sum(1).mean()
    for k in range(quality.DESCENT):
        pull = np.zeros_like(w)
        for i in range(8):
            for j in range(8, 14):
                d = z[i] - z[j]
                pull += d / (1 + math.exp(d @ v)) / 48
        new = (v + rate * pull) / (1 + rate * 1e-4)
        w, v = new, new + k / (k + 3) * (new - w)
    assert model.weights == pytest.approx(w, abs=1e-3)
    s = np.sort(z @ model.weights)
    assert (s < model.threshold).sum() in (5, 6, 7)  # the share of bad documents lies below


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert len(toxicity.sample(docs, labels, "toxic", 4, 2, 5, each=True)) == 10
    assert len(toxicity.sample(docs, labels, "toxic", 4, 2, 5, each=False)) == 5
