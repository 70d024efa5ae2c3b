"""Operator 1, toxicity of text restored by a noisy-channel decoder.

A writer's word is thought to pass a channel that swaps letters for look-alikes, repeats letters and
sets signs or blanks between them. Tokens that look so are laid out as a lattice of the letters each
place may stand for, and the Viterbi path under a character trigram model times the channel's costs
is the restored word. Blanks are arcs of a lattice over tokens: where tokens are single signs or no
known words, a path may end a word at a blank or drop the blank within a word, which must then be a
known one. The words of the restored text, and their first letters, are the features of a logistic
regression.

All labelled training rows count. Executors count their words, restore them and count the features;
the driver gets the words of at least `KNOWN_SHARE` of the rows of a label, which bounds the character
model, and the features whose log-odds stand out. The regression is fitted by L-BFGS, whose loss and
gradient executors sum over the rows. `Toxicity(texts, labels)` does the same within one process.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Callable, Iterable
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, pieces, remainder, scratch, staged, table, texts_of

#: A known word stands in that share of the training rows of either label, and in 3 rows.
KNOWN_SHARE = 3 / 5000
#: Labels are broadcast up to so many rows; beyond, the texts of documents pass one shuffle.
BROADCAST_LABELS = 1 << 20
#: Names a task counts before it hands them on.
COUNTED = 200_000
#: Rows of which a task sums loss and gradient.
TASK_ROWS = 50_000
#: Steps of L-BFGS, the pairs it remembers, and the largest part of a gradient at which it ends.
STEPS, PAIRS, FLAT = 60, 8, 1e-6
MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.3
PREFIXES = (4, 5)
#: Features whose log-odds are so many standard errors from 0, and the L2 penalty in rows.
SIGNIFICANT, PENALTY = 2.5, 0.05
#: Look-alikes: what a sign may stand for besides itself.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
SWAP_COST, KEEP_COST, REPEAT_COST, DROP_COST = 0.7, 4.0, 0.7, 0.2
#: A blank dropped within a word; a word that is not known, and each of its signs; signs of a word with blanks in it at most.
BLANK_COST, UNKNOWN_COST, SIGN_COST, BLANKED_WORD = 0.3, 6.0, 2.0, 32

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_ODD = re.compile(r"[^\W\d_].*[0-9@$!|+(<€£*._\-]|[0-9@$!|+(<€£].*[^\W\d_]|(.)\1\1|([^\W\d_])\2")
#: Look-alikes that are plain marks before a word and behind it, and a token's signs at its ends.
_PLAIN_BEFORE, _PLAIN_BEHIND = "(<", "!"
_MARKS = "".join(c for c in LOOKALIKES if not c.isalnum())
_MARKED = frozenset(_MARKS)
_ENDS = string.punctuation + _MARKS
_ENDS_PLAIN = "".join(c for c in _ENDS if c not in _MARKED)
_NO_LETTER = re.compile(rf"^(?:(?![{re.escape(_MARKS)}])[\W_])+|(?:(?![{re.escape(_MARKS)}])[\W_])+$")
_SIGN = re.compile(r"[0-9@$!|+(<€£]")
#: Letters that a sign may stand for, signs and marks go; runs of what is left count once: a word's frame, the same however it is obscured.
_SOFT = {ord(c): None for c in {*"".join(LOOKALIKES.values()), *LOOKALIKES, *"._*-,;:?#%&'\"~^=/\\)[]{}"}}
_TWICE = re.compile(r"(.)\1+")
_DOUBLE = re.compile(r"(.)\1+", re.S)
#: Marks that a word's ends may have and that stand for no letter.
_PLAIN = ".,;:?\"'#%&*-"
#: Letters in a row or another sign, and what a look-alike may stand for in a word of letters.
_PARTS = re.compile(r"[^\W\d_]+|.", re.S)
_READINGS = {c: (*x,) if c.isdigit() else (*x, "") for c, x in LOOKALIKES.items()}
#: Between restored words, which hold no white space.
_SEPARATOR = "\n"


def frame(text: str) -> str:
    return _TWICE.sub(r"\1", text.translate(_SOFT))


def edgeless(token: str) -> str:
    """The token without marks at its ends; the pattern is only needed for rare ones."""
    bare = token.strip(_ENDS)
    return bare if bare[:1].isalnum() and bare[-1:].isalnum() else _EDGE.sub("", token)


class CharModel:
    """Interpolated character trigrams of lower-case words, ^ and $ at their ends."""

    def __init__(self, words: Counter):
        self.three, self.two, self.one = Counter(), Counter(), Counter()
        for w, n in words.items():
            s = f"^^{w}$"
            for a, b, c in zip(s, s[1:], s[2:], strict=False):
                self.three[a + b + c] += n
                self.two[b + c] += n
                self.one[c] += n
        self.ctx2, self.ctx1 = Counter(), Counter()
        for k, n in self.three.items():
            self.ctx2[k[:2]] += n
        for k, n in self.two.items():
            self.ctx1[k[0]] += n
        self.total = sum(self.one.values()) or 1
        self.memo: dict[str, float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        if (got := self.memo.get(a + b + c)) is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[a + b + c] = self.fresh(a, b, c)
        return got

    def fresh(self, a: str, b: str, c: str) -> float:
        p = 0.75 * self.three[a + b + c] / (self.ctx2[a + b] or 1) + 0.2 * self.two[b + c] / (self.ctx1[b] or 1) + 0.05 * (self.one[c] + 0.5) / (self.total + 64)
        return -math.log(p)


class Restorer:
    """Viterbi decoding of one token; the state of a path is its last two letters."""

    def __init__(self, model: CharModel, words: Counter):
        self.model, self.known, self.memo = model, dict(words), {}
        self.total, self.frames = sum(words.values()) or 1, {frame(w) for w in words}
        self.squeezed = {_TWICE.sub(r"\1", w) for w in words}
        self.settled: dict[str, str] = {}

    @cached_property
    def starts(self) -> set[str]:
        """Beginnings of known words, two signs at least; made where it is used, so it is not sent along."""
        return {w[:n] for w in self.known for n in range(2, len(w))}

    def word(self, token: str) -> str:
        """The restored form of a lower-case token; known and plain tokens stay as they are.

        Signs at its ends are kept if they may stand for letters, so the decoder sees them.
        """
        return token if token in self.known else self.form(token)[0]

    def form(self, token: str) -> tuple[str, str]:
        """The restored form of a token that is not known, and if that is a single sign or no known word the token without plain marks at its ends."""
        if (got := self.memo.get(token)) is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            bare = core = token.strip(_PLAIN)
            letters = bare.isalpha()
            if not letters:
                bare, core = edgeless(token), token.strip(_ENDS_PLAIN)
                if not ((core[:1].isalnum() or core[:1] in _MARKED) and (core[-1:].isalnum() or core[-1:] in _MARKED)):
                    core = _NO_LETTER.sub("", token)
            if core == bare and (bare in self.known or not (_DOUBLE if letters else _ODD).search(bare)):
                word = bare
            elif letters:
                word = self.unrepeated(bare)
            else:
                word = self.edged(bare, core) if core != bare else self.decoded(token.rstrip(".,;:?\"')"))
            got = self.memo[token] = (word, core if len(word) < 2 or word not in self.known else "")
        return got

    def edged(self, bare: str, core: str) -> str:
        """The likeliest known word with the signs at the ends dropped or read as letters, else the decoded token."""
        if not bare:  # signs alone, such as @$$
            return word if len(set(core)) > 1 and (word := self.decoded(core)) in self.known else ""
        at = core.index(bare)
        before, behind = _end_readings(core[:at][::-1], _PLAIN_BEFORE), _end_readings(core[at + len(bare) :], _PLAIN_BEHIND)
        found = [(c + d - math.log(self.known[w]), w) for x, c in before for y, d in behind if (w := x[::-1] + bare + y) in self.known]
        if found:
            return min(found)[1]
        return self.decoded(core) if _ODD.search(core.lstrip(_PLAIN_BEFORE).rstrip(_PLAIN_BEHIND)) else bare

    def decoded(self, token: str) -> str:
        """The likeliest letters of a whole token."""
        if token.isalpha():
            return self.unrepeated(token)
        paths = {"^^": (0.0, ())}
        for i in range(len(token)):
            paths = self.extended(paths, token, i)
        return self.ended(paths)[1]

    def unrepeated(self, token: str) -> str:
        """decoded() of letters alone. Paths part where a letter is repeated and meet behind the next one, so each repetition is settled by itself."""
        out, at, seen = [], 0, self.settled
        for m in _DOUBLE.finditer(token):
            start, end = m.span()
            around = (token[start - 1] if start else "^") + token[start:end] + (token[end] if end < len(token) else "$")
            if (got := seen.get(around)) is None:
                if len(seen) > 50_000:
                    seen.clear()
                got = seen[around] = self.repetition(around)
            out += token[at:start], got
            at = end
        return "".join(out) + token[at:]

    def repetition(self, around: str) -> str:
        """What a repeated letter stands for, given with the letters before and behind it."""
        cost, before, c, behind, n = self.model.cost, around[0], around[1], around[-1], len(around) - 2
        again = cost(c, c, c) if n > 2 else REPEAT_COST
        once = (n - 1) * REPEAT_COST + cost(before, c, behind)
        more = cost(before, c, c) + (n - 2) * min(again, REPEAT_COST) + cost(c, c, behind)
        return c if once < more else c * (n if again <= REPEAT_COST else 2)

    def ended(self, paths: dict) -> tuple[float, str]:
        """Cost and letters of the best path; paths hold their letters as cells (earlier letters, last one), which they share."""
        cost, _, cell = min((cost + self.model.cost(*state, "$"), state, cell) for state, (cost, cell) in paths.items())
        letters = []
        while cell:
            cell, c = cell
            letters.append(c)
        return cost, "".join(reversed(letters))

    def extended(self, paths: dict, token: str, i: int, start: int = 0) -> dict:
        """The paths behind place i of the token, for a word that begins at start."""
        c = token[i]
        new: dict[str, tuple[float, tuple]] = {}
        known, fresh = self.model.memo.get, self.model.cost
        again = i > start and token[i - 1] == c
        letter = c.isalpha()
        readings = c if letter else LOOKALIKES.get(c, "")
        swap = 0.0 if letter else SWAP_COST
        keep = None if letter or not c.isdigit() else KEEP_COST
        drop = None if letter or c.isdigit() else DROP_COST if start < i < len(token) - 1 or c not in LOOKALIKES else KEEP_COST / 2
        for state, (cost, cell) in paths.items():
            last = state[1]
            for x in readings:
                if (own := known(state + x)) is None:
                    own = fresh(state[0], last, x)
                own += cost + swap
                if (old := new.get(last + x)) is None or own < old[0]:
                    new[last + x] = (own, (cell, x))
                if again and last == x and ((old := new.get(state)) is None or cost + REPEAT_COST < old[0]):
                    new[state] = (cost + REPEAT_COST, cell)
            if keep is not None:
                own = cost + keep + fresh(state[0], last, c)
                if (old := new.get(last + c)) is None or own < old[0]:
                    new[last + c] = (own, (cell, c))
            elif drop is not None and ((old := new.get(state)) is None or cost + drop < old[0]):
                new[state] = (cost + drop, cell)
        return new

    def own_cost(self, word: str) -> float:
        """Of a word that stands by itself."""
        return -math.log(self.known[word] / self.total) if word in self.known else UNKNOWN_COST + SIGN_COST * len(word)

    def joins(self, tokens: list[str], signs: list[bool], start: int):
        """(end, word, channel cost) of the known words that tokens[start:end] make, two tokens at least, without their blanks; `signs` says which hold signs."""
        text, paths, single = tokens[start], None, _one_sign(tokens[start])
        known, starts = self.known, self.starts
        last, signed = start + 3 if any(signs[start : start + 4]) else start, signs[start]  # signs are read up to there
        for end in range(start + 1, len(tokens)):
            before, text = text, text + tokens[end]
            if len(text) > BLANKED_WORD:
                return
            cost = BLANK_COST * (end - start)
            single, signed = single and _one_sign(tokens[end]), signed or signs[end]
            if text in known:
                yield end + 1, text, cost
            elif not single and end > last and text not in starts:
                return
            elif single and end >= start + 2:  # letter by letter: the paths go on from the last sign
                if paths is None:
                    paths = {"^^": (0.0, ())}
                    for i in range(len(before)):
                        paths = self.extended(paths, before, i)
                for i in range(len(before), len(text)):
                    paths = self.extended(paths, text, i)
                if (word := self.ended(paths)[1]) in self.known:
                    yield end + 1, word, cost + SWAP_COST
            elif not single and signed and end <= last and (text.strip(_MARKS) in known or (frame(text) in self.frames and self.possible(text))) and (word := self.word(text)) in self.known:
                yield end + 1, word, cost + SWAP_COST

    def possible(self, text: str) -> bool:
        """Whether some reading of the signs makes a known word, but for repeated letters; also true where there are too many readings to try."""
        out = [""]
        for part in _PARTS.findall(text):
            if len(out) > 64:
                return True
            own = (_TWICE.sub(r"\1", part),) if part.isalpha() else _READINGS.get(part, ("",))
            out = [x + (y[1:] if x[-1:] == y[:1] else y) for x in out for y in own]
        return not self.squeezed.isdisjoint(out)

    def joinable(self, tokens: list[str]) -> bool:
        """Whether joins() of plain tokens finds any."""
        known, starts = self.known, self.starts
        for i, text in enumerate(tokens):
            for t in tokens[i + 1 :]:
                text += t
                if text in known:
                    if len(text) <= BLANKED_WORD:
                        return True
                elif text not in starts:
                    break
        return False

    def unblanked(self, tokens: list[str], words: list[str]) -> list[str]:
        """The words of the cheapest path over tokens: each by itself as in `words`, or a known word with blanks dropped."""
        signs = [not t.isalpha() and _SIGN.search(t) is not None for t in tokens]
        arcs, seen = [], {}
        for i in range(len(tokens)):
            if len(tokens) <= BLANKED_WORD:
                arcs.append(list(self.joins(tokens, signs, i)))
                continue
            around = (*tokens[i : i + BLANKED_WORD + 1],)  # a long run may repeat itself
            if (got := seen.get(around)) is None:
                if len(seen) > 2000:
                    seen.clear()
                got = seen[around] = list(self.joins(around, signs[i : i + BLANKED_WORD + 1], 0))
            arcs.append([(i + end, word, cost) for end, word, cost in got])
        if not any(arcs):
            return words
        best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(math.inf, 0, "")] * len(tokens)
        for i, word in enumerate(words):
            here = best[i][0]
            for end, w, cost in [(i + 1, word, 0.0), *arcs[i]]:
                if (cost := here + cost + self.own_cost(w)) < best[end][0]:
                    best[end] = (cost, i, w)
        out, at = [], len(tokens)
        while at:
            _, at, word = best[at]
            out.append(word)
        return out[::-1]

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a text."""
        tokens, known = text.lower().split(), self.known
        distinct = set(tokens)
        alone, core = {}, {t: t for t in distinct if len(t) < 2}
        seen, double = self.memo.get, _DOUBLE.search
        unknown = distinct.difference(known)
        for t in unknown:
            if (bare := t.strip(_PLAIN)).isalpha() and len(bare) > 1:  # as form() has it, most tokens by far
                if bare in known:
                    alone[t] = bare
                    continue
                if not double(bare):
                    alone[t] = core[t] = bare
                    continue
            alone[t], weak = seen(t) or self.form(t)
            if weak:
                core[t] = weak
            elif len(t) < 2:
                del core[t]
        whole = distinct
        whole -= unknown
        whole.update(alone.values())
        weak = [i for i, t in enumerate(tokens) if t in core]
        if not weak:
            return whole
        single, signed = {t for t, c in core.items() if len(c) < 4 and _one_sign(c)}, {t for t, c in core.items() if not c.isalpha() and _SIGN.search(c)}
        odd = single | signed
        out, used = set(), set()  # words with blanks, and the places they stand in
        for first, last in _runs(weak):
            lo, hi = max(0, first - 1), min(len(tokens), last + 2)
            here = tokens[lo:hi]
            own = [core.get(t) or alone.get(t, t) for t in here]
            if not all(own):  # a sign without letters parts words
                lo, hi, here = first, last + 1, tokens[first : last + 1]
                own = [core[t] for t in here]
            # joins() needs a sign, three single ones in a row or a known word of plain tokens
            if (odd.isdisjoint(here) or (signed.isdisjoint(here) and not _three(own))) and not self.joinable(own):
                continue
            got = self.unblanked(own, [alone.get(t, t) for t in tokens[lo:hi]])
            if len(got) < len(own):
                out.update(got)
                used.update(range(lo, hi))
        if not used:
            return whole
        for i in used:
            tokens[i] = ""
        rest = set(tokens)
        rest.discard("")
        return out.union(rest.difference(unknown), [alone[t] for t in rest.intersection(unknown)])


@lru_cache(maxsize=1 << 12)
def _end_readings(signs: str, plain: str) -> list[tuple[str, float]]:
    """What signs at an end, from the word outwards, may stand for, with costs: the first few for letters, the others for nothing."""
    drop = [DROP_COST if c in plain or c not in LOOKALIKES else KEEP_COST / 2 for c in signs]
    out, own = [("", sum(drop))], [("", 0.0)]
    for i, c in enumerate(signs[:4]):
        if c not in LOOKALIKES:
            break
        own = [(t + x, cost + SWAP_COST) for t, cost in own for x in LOOKALIKES[c]]
        out += [(t, cost + sum(drop[i + 1 :])) for t, cost in own]
    return out


def _one_sign(token: str) -> bool:
    """A single sign, which may be repeated."""
    return len(token) < 4 and token == token[0] * len(token)


def _three(tokens: list[str]) -> bool:
    """Whether three single signs follow each other."""
    n = 0
    for t in tokens:
        n = n + 1 if _one_sign(t) else 0
        if n == 3:
            return True
    return False


def _runs(places: list[int]):
    """First and last of the runs that follow each other in ascending places, one at least."""
    first = last = places[0]
    for i in places:
        if i > last + 1:
            yield first, last
            first = i
        last = i
    yield first, last


def features(words: set[str]) -> set[str]:
    return words | {"^" + w[:n] for w in words for n in PREFIXES if len(w) >= n}


def plain_words(text: str) -> set[str]:
    """The distinct lower-case words of a text without marks at their ends."""
    return {w if w.isalpha() else edgeless(w) for w in set(text.lower().split())}


def is_known(clean, toxic, n_clean, n_toxic):
    """Whether a word in so many rows of either label is known; of numbers or of columns."""
    return (clean + toxic >= 3) & ((clean >= KNOWN_SHARE * n_clean) | (toxic >= KNOWN_SHARE * n_toxic))


def stands_out(clean, toxic, n_clean, n_toxic, log=np.log, sqrt=np.sqrt):
    """Whether a feature of so many rows of either label is one of the regression's; of numbers or of columns."""
    odds = log((toxic + 0.5) / (max(1, n_toxic) + 1)) - log((clean + 0.5) / (max(1, n_clean) + 1))
    spread = sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return (clean + toxic >= 3) & ((odds >= SIGNIFICANT * spread) | (odds <= -SIGNIFICANT * spread))


def restorer_of(counts: dict[str, int]) -> Restorer:
    """The decoder of known words with their numbers of rows; only words of letters count."""
    plain = Counter({w: counts[w] for w in sorted(counts) if w.isalpha()})
    return Restorer(CharModel(plain), plain)


def loss(w: np.ndarray, ids: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The logistic loss of rows, given by the columns of their features one after the other, and its gradient. The last weight is the bias."""
    row = np.repeat(np.arange(len(y)), lengths)
    z = w[-1] + np.bincount(row, weights=w[ids], minlength=len(y))
    off = 0.5 * (1 + np.tanh(z / 2)) - y
    return float(np.logaddexp(0, np.where(y > 0, -z, z)).sum()), np.append(np.bincount(ids, weights=off[row], minlength=len(w) - 1), off.sum())


def least(total: Callable, n: int, columns: int) -> np.ndarray:
    """The weights of least mean loss with L2, by L-BFGS; total(w) is the loss of all n rows and its gradient."""

    def penalized(w):
        value, slope = total(w)
        return (value + PENALTY / 2 * float(w[:-1] @ w[:-1])) / n, (slope + PENALTY * np.append(w[:-1], 0)) / n

    w, pairs = np.zeros(columns + 1), []
    if not n:
        return w
    value, slope = penalized(w)
    for _ in range(STEPS):
        if np.abs(slope).max() < FLAT:
            break
        way, kept = -slope, []
        for s, d in reversed(pairs):
            kept.append((s @ way) / (s @ d))
            way = way - kept[-1] * d
        if pairs:
            way *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for s, d in pairs:
            way = way + s * (kept.pop() - (d @ way) / (s @ d))
        step = 1.0 if pairs else 1 / max(1.0, float(np.abs(slope).sum()))
        for _ in range(20):
            new, (own, turn) = w + step * way, penalized(w + step * way)
            if own <= value + 1e-4 * step * float(slope @ way):
                break
            step /= 2
        else:
            break
        if (turn - slope) @ (new - w) > 1e-12:
            pairs = [*pairs, (new - w, turn - slope)][-PAIRS:]
        w, value, slope = new, own, turn
    return w


class Found:
    """Values of features by name, such as weights, and those that sets of words have."""

    def __init__(self, values: dict, known: Iterable[str]):
        self.values, self.known = values, known
        #: Of beginnings by their length; shorter words have none of it.
        self.prefixes = {n: {f[1:]: v for f, v in values.items() if f[0:1] == "^" and len(f) == n + 1} for n in PREFIXES}

    @cached_property
    def silent(self) -> set[str]:
        """Known words without a value of their own or of a beginning; made where it is used, so it is not sent along."""
        return {w for w in self.known if w not in self.values and not any(w[:n] in own for n, own in self.prefixes.items())}

    def of(self, words: set[str]) -> list:
        words, own = words - self.silent, self.values
        found = [own[w] for w in words if w in own]
        for n, own in self.prefixes.items():
            found += [own[f] for f in {w[:n] for w in words} if f in own]
        return found


class Toxicity:
    """Fitted models; score(text) is the probability of label 1."""

    def __init__(self, texts: list[str], labels: list[int]):
        y = np.array([int(bool(label)) for label in labels], np.int64)
        n = len(y) - int(y.sum()), int(y.sum())

        def of_labels(rows: list[set[str]]) -> dict[str, tuple[int, int]]:
            counts = Counter(), Counter()
            for row, label in zip(rows, y, strict=True):
                counts[label].update(row)
            return {name: (counts[0][name], counts[1][name]) for name in {*counts[0], *counts[1]}}

        self.restorer = restorer_of({w: sum(c) for w, c in of_labels([plain_words(t) for t in texts]).items() if is_known(*c, *n)})
        rows = [features(self.restorer.words(t)) for t in texts]
        names = sorted(f for f, c in of_labels(rows).items() if stands_out(*c, *n))
        number = {f: i for i, f in enumerate(names)}
        ids = [[number[f] for f in row if f in number] for row in rows]
        flat, lengths = np.array([i for row in ids for i in row], np.int64), np.array([len(row) for row in ids], np.int64)
        self.weigh(names, least(lambda w: loss(w, flat, lengths, y), len(y), len(names)))

    @classmethod
    def of(cls, restorer: Restorer, names: list[str], weights: np.ndarray) -> Toxicity:
        self = cls.__new__(cls)
        self.restorer = restorer
        self.weigh(names, weights)
        return self

    def weigh(self, names: list[str], weights: np.ndarray) -> None:
        self.weights = {f: float(w) for f, w in zip(names, weights, strict=False) if w}
        self.bias = float(weights[-1])
        self.found = Found(self.weights, self.restorer.known)

    def score(self, text: str) -> float:
        return self.of_words(self.restorer.words(text))

    def of_words(self, words: set[str]) -> float:
        """The score of a text with these restored words."""
        z = math.fsum([self.bias, *self.found.of(words)])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int, each: bool) -> list:
    """(text, label) of at most `rows` labelled training rows, of each label if `each`: the smallest by the hash of doc_id.

    Rows without label, id or text are left out. A doc_id with differing labels counts with its largest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_q_y"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = known.where("_q_y = 1").orderBy(*order).limit(rows).unionByName(known.where("_q_y = 0").orderBy(*order).limit(rows)) if each else known.orderBy(*order).limit(rows)
    own = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    found = own.join(F.broadcast(some), "doc_id").orderBy(*order, F.xxhash64("text")).select("text", "_q_y").limit(2 * rows)
    return [(r[0], int(r[1])) for r in found.collect()]


def labelled(labels: DataFrame) -> DataFrame:
    """_q_id and label (0 or 1) of all training rows; a doc_id with differing labels counts with its largest."""
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), MODULUS) != HELD_OUT))
    return train.groupBy(F.col("doc_id").alias("_q_id")).agg(F.max("toxic").cast("int").alias("_q_y")).where("_q_y in (0, 1)")


def listed(text: str | None) -> set[str]:
    """Restored words as learned() writes them."""
    return set() if text is None else set(text.split(_SEPARATOR))


def counted(rows: DataFrame, names_of: Callable[[], Callable[[str | None], Iterable[str]]]) -> DataFrame:
    """name, clean, toxic: in how many rows of either label a name stands; the null name counts the rows."""

    def run(batches):
        names, counts = names_of(), (Counter(), Counter())

        def out():
            for label, seen in enumerate(counts):
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([label] * len(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["name", "label", "n"])
                seen.clear()

        for b in pieces(batches, "text"):
            for text, label in zip(b.column("text").to_pylist(), b.column("_q_y").to_pylist(), strict=True):
                counts[label].update(names(text))
                counts[label][None] += 1
                if len(counts[label]) > COUNTED:
                    yield from out()
        yield from out()

    number = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    return rows.mapInArrow(run, "name string, label int, n long").groupBy("name").agg(number(0).alias("clean"), number(1).alias("toxic"))


def fitted(docs: DataFrame, labels: DataFrame, broadcast: int = BROADCAST_LABELS) -> Toxicity:
    """The models of all labelled training rows. Null texts are left out; repeated rows each count."""
    return learned(docs, labelled(labels), broadcast)[0]


def learned(docs: DataFrame, known: DataFrame, broadcast: int, keep: bool = False) -> tuple[Toxicity, DataFrame | None]:
    """The models, and doc_id with restored words of the training rows if `keep` and there are no more than `broadcast` labels."""
    spark = docs.sparkSession
    with scratch(spark):
        few = known.limit(broadcast + 1).count() <= broadcast
        own = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
        rows = own.join(F.broadcast(known) if few else known.hint("merge"), F.col("doc_id") == F.col("_q_id")).drop("_q_id")
        rows = rows if few else staged(rows, "toxic-rows")
        words = staged(counted(rows, lambda: lambda text: plain_words(text)), "toxic-words")
        n = next(((r.clean, r.toxic) for r in words.where("name is null").collect()), (0, 0))
        of = F.col("clean"), F.col("toxic")
        restorer = restorer_of({r.name: r.clean + r.toxic for r in words.where(F.col("name").isNotNull() & is_known(*of, *n)).collect()})
        shared = spark.sparkContext.broadcast(restorer)

        def restored():
            words_of = shared.value.words
            return lambda b: {"doc_id": b.column("doc_id"), "text": [_SEPARATOR.join(words) if (words := words_of(t)) else None for t in texts_of(b)], "_q_y": b.column("_q_y")}

        rows = done = staged(map_batches(rows, f"doc_id {dict(rows.dtypes)['doc_id']}, text string, _q_y int", "text", restored), "toxic-restored", keep=keep and few)
        seen = counted(rows, lambda: lambda text: features(listed(text)))
        good = seen.where(F.col("name").isNotNull() & stands_out(*of, *n, log=F.log, sqrt=F.sqrt)).select("name")
        names = sorted(r.name for r in good.collect())
        chosen = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

        def numbered():
            number = Found(chosen.value, shared.value.known)
            return lambda b: {"ids": pa.array([number.of(listed(text)) for text in b.column("text").to_pylist()], pa.list_(pa.int32())), "_q_y": b.column("_q_y")}

        rows = staged(map_batches(rows, "ids array<int>, _q_y int", "text", numbered), "toxic-ids").coalesce(1 + sum(n) // TASK_ROWS)

        def total(w: np.ndarray) -> tuple[float, np.ndarray]:
            weights = spark.sparkContext.broadcast(w)

            def run(batches):
                value, slope = 0.0, np.zeros(len(weights.value))
                for b in batches:
                    ids = b.column("ids")
                    got = loss(weights.value, ids.flatten().to_numpy(), ids.value_lengths().to_numpy(), b.column("_q_y").to_numpy())
                    value, slope = value + got[0], slope + got[1]
                yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([slope.tobytes()], pa.binary())], ["value", "slope"])

            got = rows.mapInArrow(run, "value double, slope binary").collect()
            weights.destroy()
            return math.fsum(r.value for r in got), sum((np.frombuffer(r.slope) for r in got), np.zeros(len(w)))

        return Toxicity.of(restorer, names, least(total, sum(n), len(names))), done if keep and few else None


def scored(docs: DataFrame, model: Toxicity, restored: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted; with `restored` the texts are words as learned() writes them. Null texts are scored as empty; repeated rows each return
    a row; an empty table returns none; extra columns are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]
    only = docs.select("doc_id", "text", (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"))

    def make():
        own = shared.value
        score = (lambda t: own.of_words(listed(t))) if restored else lambda t: own.score(t or "")
        return lambda b: {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": [score(t) for t in b.column("text").to_pylist()]}

    rows = map_batches(only, f"doc_id {kind}, held_out boolean, score double", "text", make)
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = table(spark, sf_dir, "documents").select("doc_id", "text"), labelled(table(spark, sf_dir, "labels"))
    model, done = learned(docs, known, BROADCAST_LABELS, keep=True)
    if done is None:
        return scored(docs, model)
    rest = docs.join(F.broadcast(known), (F.col("doc_id") == F.col("_q_id")) & F.col("text").isNotNull(), "left_anti")
    return scored(rest, model).unionByName(scored(done, model, restored=True))


def drop_toxic(docs: DataFrame, model: Toxicity) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns, whatever their names.

    Null texts are scored as empty; repeated rows share one fate; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for b in pieces(batches, "text"):
            yield b.filter(pa.array([own.score(t) < THRESHOLD for t in texts_of(b)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
