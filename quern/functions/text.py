"""Text functions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import let

SPACE = "[ \n\t\r]+"


def words(text: Column) -> Column:
    """Words between blanks; null gives null."""
    return F.array_remove(F.split(text, SPACE), "")


def last_line(text: Column) -> Column:
    """The last line after trimming blanks at both ends."""
    return F.element_at(F.split(F.btrim(text, F.lit(" \n\r\t")), "\n"), -1)


def stop_at(text: Column, stops: list[str]) -> Column:
    """text up to the earliest of the stop sequences."""
    for stop in stops:  # cutting at each in turn leaves the part before the earliest
        text = F.substring_index(text, stop, 1)
    return text


def strip_tags(html: Column) -> Column:
    """Page text: scripts, styles and tags become blanks, and blanks one space."""
    for pattern in (r"(?s)<(script|style)[^>]*>.*?</(script|style)>", r"<[^>]+>", r"[ \n\t\r]+"):
        html = F.regexp_replace(html, pattern, " ")
    return F.btrim(html)


def token_format(token: Column, width: int = 5) -> Column:
    return F.format_string(f"%0{width}d", token)


def chunk_step(size: int, overlap: float = 0.2) -> int:
    return size - math.floor(size * overlap)


def fixed_chunks(text: Column, size: int, overlap: float = 0.2) -> Column:
    """Array of chunks of `size` words, each beginning `size` less the overlap after the last. A text without words has none."""
    step = chunk_step(size, overlap)

    def chunks(w: Column) -> Column:
        n = F.greatest(F.lit(0), F.ceil((F.size(w) - size) / F.lit(step)).cast("int")) + 1
        chunk = lambda i: F.array_join(F.slice(w, i * step + 1, size), " ")
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), n - 1), chunk)).otherwise(F.array().cast("array<string>"))

    return let(words(text), chunks)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])[ \n\t\r]+"), lambda s: F.btrim(s, F.lit(" \n\r\t"))), lambda s: s != "")


def sentence_chunks(text: Column, limit: int = 128) -> Column:
    """Sentences packed greedily, in order, into chunks of at most `limit` words; a longer sentence is a chunk of its own."""
    size = lambda s: F.size(words(s))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        fits = (acc.n == 0) | (acc.n + size(s) <= limit)
        return F.struct(
            F.when(fits, acc.done).otherwise(F.concat(acc.done, F.array(acc.now))).alias("done"),
            F.when(acc.n == 0, s).when(fits, F.concat_ws(" ", acc.now, s)).otherwise(s).alias("now"),
            F.when(fits, acc.n + size(s)).otherwise(size(s)).alias("n"),
        )

    return F.aggregate(sentences(text), start, step, lambda a: F.when(a.n > 0, F.concat(a.done, F.array(a.now))).otherwise(a.done))


def bpe_tokens(text: Column, path: str) -> Column:
    """The tokens of a text by a tokenizers file, each decoded; null gives null. The path is the caller's."""

    @F.arrow_udf("array<string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        coder, known, kind = Tokenizer.from_file(path), {}, pa.list_(pa.string())

        def token(i):
            if i not in known:
                known[i] = coder.decode([i])
            return known[i]

        for texts in parts:  # a row's tokens become Arrow data at once: as Python objects a batch of them takes gigabytes
            own = (pa.array([[token(i) for i in coder.encode(t.as_py(), add_special_tokens=False).ids] if t.is_valid else None], kind) for t in texts)
            yield pa.concat_arrays([pa.array([], kind), *own])

    return run(text)


def bpe_count(text: Column, path: str) -> Column:
    """The number of bpe_tokens() of a text, without the tokens; null gives null."""

    @F.arrow_udf("bigint")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        for texts in parts:
            yield pa.array((len(coder.encode(t.as_py(), add_special_tokens=False).ids) if t.is_valid else None for t in texts), pa.int64())

    return run(text)
