"""Operator 1 does no more than it must for a text, and restores the same words."""

import random

import pytest

from quern.llm import toxicity

WORDS = toxicity.Counter({w: 9 + i for i, w in enumerate("the house of this old town was full calm when late rain fell idiot loser stupid trash letter asshole moron ill a i so lose rest in to".split())})


class Counted(toxicity.Restorer):
    def __init__(self, *args):
        super().__init__(*args)
        self.calls = toxicity.Counter()

    def form(self, token):
        self.calls["form"] += 1
        return super().form(token)

    def extended(self, *args):
        self.calls["extended"] += 1
        return super().extended(*args)


class All:
    def __contains__(self, _):
        return True


class Slow(Counted):
    """Tries every run of tokens to its end."""

    starts = All()


def restorer(kind=toxicity.Restorer):
    return kind(toxicity.CharModel(WORDS), WORDS)


def test_long_run_of_single_letters_is_decoded_once():
    r = restorer(Counted)
    r.words("y " * 3000)
    assert r.calls["extended"] < 5000


def test_plain_tokens_are_settled_without_decoder():
    r = restorer(Counted)
    assert r.words('The house, of this (old) town. "Calm" when unmet; strangely-') == {"the", "house", "of", "this", "old", "town", "calm", "when", "unmet", "strangely"}
    assert r.calls["form"] == 1  # (old): a bracket may stand for a letter


@pytest.mark.parametrize("seed", range(4))
def test_words_as_without_short_cuts(seed):
    rng, quick, slow = random.Random(seed), restorer(), restorer(Slow)
    signs = {c: [s for s, x in toxicity.LOOKALIKES.items() if c in x] for c in "abcdefghijklmnopqrstuvwxyz"}

    def obscured(w):
        kind = rng.randrange(7)
        if kind == 0:
            return " ".join(w)
        if kind == 1:
            at = rng.randrange(len(w) + 1)
            return w[:at] + rng.choice([" ", " | ", ".", " ! ", "-"]) + w[at:]
        if kind == 2:
            return "".join(rng.choice([c, c + c, *signs[c]]) for c in w)
        if kind == 3:
            return rng.choice(["(", "!!", "$", "_", "«", '"']) + w + rng.choice(["!!", ",", "$$$", "|", "…", ".!!"])
        return w if kind < 6 else "".join(rng.choices("aehilnorst", k=rng.randrange(1, 7)))

    for _ in range(400):
        text = " ".join(obscured(rng.choice(list(WORDS))) for _ in range(rng.randrange(1, 50)))
        assert quick.words(text) == slow.words(text), text


def test_tokens_alone_are_as_the_patterns_have_them():
    rng = random.Random(3)
    for _ in range(20000):
        token = "".join(rng.choices("ab1é_.,!|($…«'²½́", k=rng.randrange(1, 7)))
        assert toxicity.edgeless(token) == toxicity._EDGE.sub("", token)
        r = restorer() if _ % 500 == 0 else r
        word, core = r.form(token)
        if len(token) > 1 and not core and token not in WORDS:
            assert r.words(token) == {word}


def test_values_found_are_those_of_all_features():
    rng = random.Random(9)
    for _ in range(200):
        names = rng.sample([*WORDS, "^hous", "^stup", "^stupi", "^lett", "^unme", "unmet", "^aaaa"], 9)
        values = {f: i for i, f in enumerate(names)}
        words = set(rng.sample([*WORDS, "unmet", "aaaab", "houses", "", "x"], 12))
        assert sorted(toxicity.Found(values, WORDS).of(words)) == sorted(values[f] for f in toxicity.features(words) if f in values)
