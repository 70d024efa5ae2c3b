"""Text and embedding models behind small protocols, with deterministic rules as defaults.

A remote model is a CallModel or CallEmbedder, which hand batches of texts to a function of the
caller's through a pandas_udf, with retries; nothing else changes. The rules make no claim about
language, only that results repeat.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .vector import hash_embedding, let


class TextModel(Protocol):
    def __call__(self, prompt: Column) -> Column: ...


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class Params:
    """Inference parameters; those that a rule can honour are column expressions."""

    temperature: float = 0.0
    top_p: float = 1.0
    max_tokens: int = 256
    stop: tuple[str, ...] = ()


@dataclass(frozen=True)
class RuleModel:
    """Answers with the last line of the prompt, cut at stops and at max_tokens words."""

    params: Params = field(default_factory=Params)

    def __call__(self, prompt: Column) -> Column:
        out = T.stop_at(T.last_line(prompt), list(self.params.stop))
        return F.array_join(F.slice(T.words(out), 1, self.params.max_tokens), " ")


@dataclass(frozen=True)
class HashEmbedder:
    dim: int = 16

    def __call__(self, text: Column) -> Column:
        return hash_embedding(T.words(text), self.dim)


@dataclass(frozen=True)
class Retry:
    """Attempts at a call, and the bounds of the random wait between two, in seconds."""

    attempts: int = 7
    wait: tuple[float, float] = (1.0, 2.0)

    def run(self, call: Callable):
        for left in reversed(range(self.attempts)):
            try:
                return call()
            except Exception:
                if not left:
                    raise
                time.sleep(random.uniform(*self.wait))


def _called(call: Callable, returns: str, retry: Retry, batch: int) -> Callable[[Column], Column]:
    """call(texts) on at most `batch` texts at a time; a null text stays null and isn't sent."""

    @F.pandas_udf(returns)
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype=object)
        known = [i for i, t in enumerate(texts) if t is not None]
        for at in range(0, len(known), batch):
            own = known[at : at + batch]
            got = retry.run(lambda: list(call([texts.iloc[i] for i in own])))  # noqa: B023
            if len(got) != len(own):
                raise ValueError(f"{len(got)} answers to {len(own)} texts")
            for i, x in zip(own, got, strict=True):
                out.iat[i] = x
        return out

    return run


@dataclass(frozen=True)
class CallModel:
    """A TextModel by a function of (prompts, params), such as a client of a service."""

    call: Callable[[list[str], Params], list[str]]
    params: Params = field(default_factory=Params)
    retry: Retry = field(default_factory=Retry)
    batch: int = 16

    def __call__(self, prompt: Column) -> Column:
        call, params = self.call, self.params
        return _called(lambda texts: call(texts, params), "string", self.retry, self.batch)(prompt)


@dataclass(frozen=True)
class CallEmbedder:
    """An Embedder by a function of texts; every vector must have `dim` entries."""

    call: Callable[[list[str]], list[list[float]]]
    dim: int
    retry: Retry = field(default_factory=Retry)
    batch: int = 16

    def __call__(self, text: Column) -> Column:
        call, dim = self.call, self.dim

        def checked(texts):
            got = [[float(x) for x in v] for v in call(texts)]
            if any(len(v) != dim for v in got):
                raise ValueError(f"a vector without {dim} entries")
            return got

        return _called(checked, "array<double>", self.retry, self.batch)(text)


POSITIVE = ("good", "great", "best", "happy", "love", "thanks")
NEGATIVE = ("bad", "worse", "worst", "sad", "hate", "awful")


def count_of(words: Column, listed: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*listed)))


def sentiment(text: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    """positive, negative or neutral by which list's words are more; the lists are parameters of the rule."""
    w = T.words(F.lower(text))
    d = count_of(w, positive) - count_of(w, negative)
    return F.when(d > 0, "positive").when(d < 0, "negative").otherwise("neutral")


def subject(text: Column, least: int = 4) -> Column:
    """One word: of those of `least` letters the most frequent, the first in order of ties; empty without any."""
    w = F.filter(F.transform(T.words(F.lower(text)), lambda x: F.regexp_replace(x, r"[^\p{L}]", "")), lambda x: F.length(x) >= least)
    counted = lambda ws: F.array_max(F.transform(F.array_distinct(ws), lambda x: F.struct(F.size(F.filter(ws, lambda y: y == x)).alias("n"), (-F.array_position(ws, x)).alias("at"), x.alias("x"))))["x"]
    return F.coalesce(let(w, counted), F.lit(""))


def sentiment_json(text: Column, **lists) -> Column:
    """{"sentiment": ..., "subject": ...}."""
    return F.to_json(F.struct(sentiment(text, **lists).alias("sentiment"), subject(text).alias("subject")))


#: The nine entity types and the patterns that stand for them. A rule names no language's words but these.
_PROPER = r"[A-Z][A-Za-z&]+"
ENTITY_RULES = {
    "ORGANIZATION": rf"\b{_PROPER}(?: {_PROPER})* (?:Inc|Corp|Ltd|LLC|Company|Bank|University)\b",
    "DATE": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{2}-[0-9]{2}-[0-9]{4}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}(?:, [0-9]{4})?\b",
    "PERSON": rf"(?<=\b(?:Mr|Ms|Dr|Mrs)\. ){_PROPER}(?: {_PROPER})?",
    "FACILITY": rf"\b{_PROPER} (?:Airport|Hospital|Tower|Stadium|Plant|Bridge)\b",
    "PERSON_TITLE": r"\b(?:Chief [A-Z][a-z]+ Officer|CEO|CFO|CTO|President|Chairman|Chairwoman|Director|Manager)\b",
    "LOCATION": rf"(?<=\b(?:in|at|from|near) ){_PROPER}\b",
    "MONETARY_VALUE": r"[$€£][0-9][0-9,]*(?:\.[0-9]+)?(?: (?:million|billion))?",
    "STOCK_CODE": r"\b(?:NYSE|NASDAQ)[: ]+[A-Z]{1,5}\b|(?<![A-Za-z$])\$[A-Z]{1,5}\b",
    "QUANTITY": r"\b[0-9][0-9,]*(?:\.[0-9]+)? (?:percent|shares|units|people|tons|miles|kg|km)\b",
}


def entities(text: Column, rules: dict[str, str] = ENTITY_RULES) -> Column:
    """map from entity type to the distinct matches in order; types without a match are left out.

    A stock code has its market in front, UNKNOWN where none stands with it.
    """

    def found(kind: str, pattern: str) -> Column:
        got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if kind == "STOCK_CODE":
            got = F.transform(got, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\$", "UNKNOWN:"), r"[: ]+", ":"))
        return F.struct(F.lit(kind).alias("key"), F.array_distinct(got).alias("value"))

    return F.map_from_entries(F.filter(F.array(*(found(k, p) for k, p in rules.items())), lambda e: F.size(e.value) > 0))


def question_type(question: Column) -> Column:
    """Connections if it asks how things relate, Inquiry if it asks, else Unknown."""
    low = F.lower(question)
    return F.when(low.contains("between") | low.contains("connect"), "Connections").when(low.endswith("?") | low.rlike("^(what|who|where|when|how|tell)"), "Inquiry").otherwise("Unknown")


def question_metadata(question: Column, rules: dict[str, str] = ENTITY_RULES) -> Column:
    """{"questionType": ..., "entities": {type: [...]}}."""
    return F.to_json(F.struct(question_type(question).alias("questionType"), entities(question, rules).alias("entities")))
