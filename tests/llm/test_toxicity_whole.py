"""Operator 1 learns from every labelled training row."""

import random
import zlib

import pytest

from quern.llm import toxicity

LEFT_OUT = 2


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == LEFT_OUT


@pytest.fixture(scope="module")
def tables(spark):
    """More rows of either label than any bounded part of them; each bad word stands in a few of them."""
    rng = random.Random(7)
    filler = "the house of this old town was full and calm when late rain fell on it".split()
    bad = [a + b for a in ("mor", "scu", "vil", "tra", "idi", "los", "fil", "gru") for b in ("onk", "mble", "ert", "shy", "ota", "erra")]
    good = [f"kind{w}" for w in bad]
    rows, labels = [], []
    for i in range(8000):
        y = i % 2
        rows.append((i, " ".join(rng.choices(filler, k=12)) + " " + rng.choice(bad if y else good)))
        labels.append((i, y))
    rows += [(None, "no id"), (3, None), (8001, ""), (8002, "no label")]
    labels += [(None, 1), (8001, 0), (8003, 1), (8002, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), rows, dict(labels)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_every_labelled_row_counts(spark, tables, broadcast):
    docs, labels, rows, of = tables
    train = [(t, of[i]) for i, t in rows if i is not None and t is not None and of.get(i) is not None and not held(i)]
    assert min(sum(y for _, y in train), sum(1 - y for _, y in train)) > 2500
    model, plain = toxicity.fitted(docs, labels, broadcast), toxicity.Toxicity([t for t, _ in train], [y for _, y in train])
    words = [t.split() for t, _ in train]
    assert model.restorer.known == plain.restorer.known
    assert model.restorer.known["house"] == sum("house" in w for w in words)  # counted in all rows
    assert model.weights.keys() == plain.weights.keys()
    assert model.weights == pytest.approx(plain.weights, rel=1e-3, abs=1e-3) and model.bias == pytest.approx(plain.bias, rel=1e-3, abs=1e-3)
    out = [(model.score(t or "") >= 0.3, of[i]) for i, t in rows if i is not None and t and of.get(i) is not None and held(i)]
    assert sum(a == bool(y) for a, y in out) == len(out)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_rows_restored_while_learning_score_alike(spark, tables, tmp_path, monkeypatch, broadcast):
    """Training rows are restored once; nulls, repeated rows and rows without label are scored with the others."""
    docs, labels, _, _ = tables
    more = spark.createDataFrame([(None, None), (5, "m0ronk the house"), (5, "m0ronk the house"), (7, "..."), (8001, None)], docs.schema)
    docs = docs.where("doc_id % 8 = 0 or doc_id is null or doc_id % 8 = 3 or doc_id > 8000").union(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", broadcast)
    got = toxicity.op1_noisy_channel_toxicity(spark, str(tmp_path)).collect()
    want = toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [(r.doc_id, r.held_out, r.predicted) for r in got] == [(r.doc_id, r.held_out, r.predicted) for r in want]
    assert [r.score for r in got] == pytest.approx([r.score for r in want], abs=1e-4)


def test_labels_of_few_or_no_rows(spark, tables):
    docs, labels, _, _ = tables
    for some in (labels.limit(0), labels.where("toxic = 1"), labels.where("doc_id = 8001")):
        model = toxicity.fitted(docs, some)
        assert 0 <= model.score("") <= 1 and 0 <= model.score("m0ronk") <= 1


def test_readings_of_signs():
    """A reading that the decoder finds among known words is never ruled out beforehand."""
    rng = random.Random(5)
    words = toxicity.Counter({w: 9 for w in ("idiot", "loser", "stupid", "trash", "letter", "asshole", "moron", "ill", "assess", "scum")})
    r = toxicity.Restorer(toxicity.CharModel(words), words)
    signs = {c: [s for s, x in toxicity.LOOKALIKES.items() if c in x] for c in "abcdefghijklmnopqrstuvwxyz"}
    found = 0
    for _ in range(4000):
        text = "".join(rng.choice([c, c, *signs[c], c + c, c + rng.choice(".|-!")]) for c in rng.choice(list(words)))
        if r.word(text) in r.known:
            found += 1
            assert r.possible(text)
    assert found > 1000


@pytest.mark.parametrize("token", ["letter", "iiddiioott", "aaaa", "stuupid", "llloooserrr", "x", "aabb", "moronnn"])
def test_letters_alone_are_decoded_as_paths(token):
    words = toxicity.Counter({w: 50 for w in ("idiot", "loser", "stupid", "letter", "moron")})
    r = toxicity.Restorer(toxicity.CharModel(words), words)
    paths = {"^^": (0.0, ())}
    for i in range(len(token)):
        paths = r.extended(paths, token, i)
    assert r.unrepeated(token) == r.ended(paths)[1]
