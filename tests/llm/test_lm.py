"""Operator 10 against a plain model of the same definition."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from quern.llm import lm
from quern.llm.common import shared_dir

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, batch long, src long, answers string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)


def cut(text):
    return [*(text or "").encode().translate(LOWER).split(), None]


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


class Slow:
    """Deleted interpolation with dictionaries, EM event by event."""

    def __init__(self, rows):
        train = [(i, cut(t)) for i, t in rows if fold(i) % 5 != 1]
        held = [w for i, w in train if fold(i) // 5 % 8 == 0]
        self.count([w for i, w in train if fold(i) // 5 % 8])
        events = [(self.bucket(u, v), self.parts(u, v, x)) for w in held for u, v, x in self.grams(w)]
        self.weights = {}
        for b in {b for b, _ in events}:
            own = [p for k, p in events if k == b]
            a = self.start(b)
            for _ in range(lm.EM_STEPS):
                new = [0.0] * 4
                for p in own:
                    s = sum(x * y for x, y in zip(a, p, strict=True))
                    for j in range(4):
                        new[j] += a[j] * p[j] / s
                new = [(n + e) * (x > 0) for n, e, x in zip(new, (1e-3, 1e-3, 1e-3, 1e-2), a, strict=True)]
                a = [n / sum(new) for n in new]
            self.weights[b] = a
        self.count([w for _, w in train])

    def grams(self, w):
        return list(zip(["<s>", "<s>", *w], ["<s>", *w], w, strict=False))

    def count(self, docs):
        self.c = Counter()
        for w in docs:
            for u, v, x in self.grams(w):
                self.c.update([(u, v, x), (x,)])
                if v != "<s>":
                    self.c.update([(v, x)])
            self.c.update([("<s>",), *([("<s>", w[0])])])
        self.n = sum(len(w) for w in docs)
        self.kinds = len({x for w in docs for x in w})

    def two(self, u, v):
        return self.c[v,] if v == "<s>" else self.c[u, v]

    def bucket(self, u, v):
        two, one = self.two(u, v), self.c[v,]
        return two.bit_length() if two else -one.bit_length()

    def parts(self, u, v, x):
        return [self.c[u, v, x] / (self.two(u, v) or 1), self.c[v, x] / (self.c[v,] or 1), self.c[x,] / max(1, self.n), 1 / (self.kinds + 1)]

    def start(self, b):
        a = [0.3 * (b > 0), 0.3 * (b != 0), 0.3, 0.1]
        return [x / sum(a) for x in a]

    def unmet(self, b):
        """Weights of a bucket without events: EM's small counts alone."""
        a = [1e-3 * (b > 0), 1e-3 * (b != 0), 1e-3, 1e-2]
        return [x / sum(a) for x in a]

    def score(self, w):
        out = 0.0
        for u, v, x in self.grams(w):
            b = self.bucket(u, v)
            out += math.log10(sum(a * p for a, p in zip(self.weights.get(b) or self.unmet(b), self.parts(u, v, x), strict=True)))
        return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}ä" if i % 7 == 0 else f"W{i}" for i in range(60)]
    phrases = [" ".join(rng.choices(words, k=4)) for _ in range(30)]
    own = [(i, " ".join(rng.choices(phrases + words, k=rng.choice([1, 2, 5, 40])))) for i in range(150)]
    own += [(200 + i, own[60][1]) for i in range(30)]
    return own + [(400, None), (401, ""), (402, " \n\t "), (None, "no id"), (None, None), (5, own[5][1]), (5, own[5][1])]


@pytest.mark.parametrize("fan", [1024, 2])
def test_scores(spark, monkeypatch, rows, fan):
    """fan 2 sends the n-grams through levels of cells; the counts and so the scores stay the same."""
    monkeypatch.setattr(lm, "BATCH_TEXT", 2000)
    slow = Slow(rows)
    total, kinds = slow.n, slow.kinds
    want = []
    for i, t in rows:
        w = cut(t)
        base = sum(math.log10((slow.c[x,] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        want.append((str(i), fold(i) % 5 == 1, len(w), sum(slow.c[x,] > 0 for x in w), total, base, slow.score(w)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.scores(frame(spark, rows).repartition(3), fan, resolution=256).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-4)


def test_levels():
    assert lm.Shape.of(5) == lm.Shape(16, 1, 5)
    deep = lm.Shape.of(900_000)
    assert deep.levels == 3 and deep.fan <= lm.FAN and deep.fan**3 >= 1_800_000
    cells = [deep.cell(t << 32) for t in range(0, 900_000, 1000)]
    assert cells == sorted(cells) and cells[-1] < deep.fan**2


def test_empty_and_untrained(spark):
    assert lm.scores(frame(spark, [])).count() == 0
    held = [i for i in range(40) if fold(i) % 5 == 1]
    got = lm.scores(frame(spark, [(i, "a b") for i in held])).collect()
    assert len(got) == len(held) and all(r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 for r in got)


def test_scratch_goes(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = len(list(folder.iterdir()))
    lm.scores(frame(spark, [(1, "a")])).count()
    assert len(list(folder.iterdir())) == before + 1  # the result alone
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quern_lm")]


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    """Where words follow each other in phrases; words drawn alone have nothing that pairs could tell."""
    rng = random.Random(8)
    phrases = [" ".join(f"{a}{i}" for a in "abcde") for i in range(40)]
    got = lm.scores(frame(spark, [(i, " ".join(rng.choices(phrases, k=8))) for i in range(300)])).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > 0.5 * sum(r.base_score for r in held)


def test_packing_of_integers():
    for a in (np.array([0, 1, 255, 256, 1 << 40]), np.zeros(0, np.int64), np.array([7])):
        assert lm.widened(lm.narrow(a)).tolist() == a.tolist()
    keys = np.array([1 << 8, 5 << 8, (1 << 63) + 256], np.uint64)
    for n in (2, 3):
        assert lm.unpacked_keys(lm.packed_keys(keys, n), n).tolist() == keys.tolist()
    assert lm.unpacked_keys(lm.packed_keys(keys + np.uint64(3), 1), 1).tolist() == (keys + np.uint64(3)).tolist()
