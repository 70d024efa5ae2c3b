"""Forms that the gate before the decoder of operator 1 must let in."""

from collections import Counter

import pytest

from quern.llm import toxicity

WORDS = Counter({w: 50 for w in ("idiot", "loser", "stupid", "trash", "the", "house", "letter", "asshole", "dumb", "is", "he", "one", "great", "hit", "a", "ass", "moron")})


@pytest.fixture(scope="module")
def restorer():
    return toxicity.Restorer(toxicity.CharModel(WORDS), WORDS)


@pytest.mark.parametrize(
    ("token", "want"),
    [("$tupid", "stupid"), ("@sshole", "asshole"), ("!diot", "idiot"), ("idio+", "idiot"), ('"$tupid!"', "stupid"), ("@$$", "ass"), ("stuupid", "stupid"), ("iiddiioott", "idiot")]
    + [("great!", "great"), ("(great)", "great"), ("great!!!", "great"), ("erblan!", "erblan"), ("(erblan", "erblan"), ("letter", "letter"), ("$100", "100"), ("2011", "2011"), ("!!!", "")],
)
def test_word(restorer, token, want):
    assert restorer.word(token) == want


@pytest.mark.parametrize(
    ("text", "words"),
    [("a s t u p i d", {"stupid", "a"}), ("he is a d u m b one", {"dumb", "he", "is", "one"}), ("s t u p i d i d i o t", {"stupid", "idiot"}), ("a $ t u p i d m 0 r o n", {"stupid", "moron"}), ("an a s s", {"ass"})],
)
def test_spaced(restorer, text, words):
    got = restorer.words(text)
    assert words <= got
    assert not got & {"astupid", "adumb", "stupididiot", "astupidmoron"}


@pytest.mark.parametrize(
    ("text", "words"),
    [("you id iot", {"you", "idiot"}), ("stu pid he is", {"stupid", "he", "is"}), ("st up 1d", {"stupid"}), ("s t u p 1 d i d 1 0 t", {"stupid", "idiot"}), ("s tt uu p i d", {"stupid"})]
    + [("a great house", {"a", "great", "house"}), ("he is one", {"he", "is", "one"}), ("erb lan house", {"erb", "lan", "house"})],
)
def test_blanks(restorer, text, words):
    got = restorer.words(text)
    assert words - {"you"} <= got and not got & {"stupididiot", "isone", "erblan"}


def letters_of(c, before):
    """What the channel may have made sign c from: (letters, cost)."""
    own = [(c, 0.0)] if c.isalpha() else [(x, toxicity.SWAP_COST) for x in toxicity.LOOKALIKES.get(c, "")]
    return own + ([(c, toxicity.KEEP_COST)] if c.isdigit() else [])


def exhaustive(model, token):
    """The least cost over all readings of a token, by recursion."""

    def go(i, state, last):
        if i == len(token):
            return model.cost(*state, "$")
        c, best = token[i], float("inf")
        for x, cost in letters_of(c, last):
            best = min(best, cost + model.cost(*state, x) + go(i + 1, state[1] + x, x))
            if i and token[i - 1] == c and state[1] == x and not c.isdigit() | (x == c and not c.isalpha()):
                best = min(best, toxicity.REPEAT_COST + go(i + 1, state, x))
        if c.isdigit():
            for x in toxicity.LOOKALIKES.get(c, ""):
                if i and token[i - 1] == c and state[1] == x:
                    best = min(best, toxicity.REPEAT_COST + go(i + 1, state, x))
        elif not c.isalpha():
            drop = toxicity.DROP_COST if 0 < i < len(token) - 1 or c not in toxicity.LOOKALIKES else toxicity.KEEP_COST / 2
            best = min(best, drop + go(i + 1, state, last))
        return best

    return go(0, "^^", "")


@pytest.mark.parametrize("token", ["1d10t", "$tup1d", "iiddiioott", "l0$er", "t.r.a.s.h", "m0000r0n", "11", "a$$h0le!", "x1x1x1", "6re@t"])
def test_decoder_is_exhaustive(restorer, token):
    paths = {"^^": (0.0, ())}
    for i in range(len(token)):
        paths = restorer.extended(paths, token, i)
    assert restorer.ended(paths)[0] == pytest.approx(exhaustive(restorer.model, token))


def test_long_tokens_are_decoded_whole(restorer):
    assert len({restorer.decoded("1" * n) for n in (63, 64, 65, 640, 5000)}) == 1  # one letter repeated, however often
    assert restorer.decoded("s1" * 40_000).count("s") == 40_000
