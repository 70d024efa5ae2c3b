"""Operator 3, token ids in shards with Elias-Fano document boundaries.

A shard is a blob: a header, the concatenated ids (2 bytes each where the vocabulary allows it,
else 4), and two Elias-Fano sequences, the places where documents begin and their ids less the
first. An Elias-Fano sequence keeps the low bits of each value packed, and the high bits in unary,
with the place of every 64th one bit as a select sample: about 2 + log2(u / n) bits an entry in
place of 64, and any entry is found without decoding the others.

Documents are range-partitioned by id, so shards follow each other in id order; shards are written
as rows of a Parquet table at a path of the caller's, which Spark commits once however often a task
is lost, and which any store that Spark writes can hold. A shard's row says how many ids its part
holds before it, so readers need besides one number a part, and blobs are never shuffled.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, staged, table, texts_of

MAGIC = b"QEF1"
END_ID = 1
#: A shard is closed when it holds so many ids.
SHARD_IDS = 1 << 20
#: Parts of texts remembered by a Python worker's tokenizer before it starts anew.
MEMO = 600_000
#: A word of Latin letters and the ASCII marks behind it, without apostrophes: any pre-tokenizer here parts the two.
_MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-^`{-~]*)")
#: White space that keeps a text in one piece: two together, or any other than space and line end.
_UNEVEN = ("  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """encode(text, add_special_tokens=False) by a tokenizers file, with a memo for parts of texts.

    `spaced` says how parts may be cut. False: the tokenizer drops white space and folds case, so any
    space or line end is a cut. True: a space belongs to the word behind it, and a line end is a part
    of its own; a text with other white space, or with two together, is encoded in one piece. New
    parts are cut further, before marks behind a word. A text that holds the name of an added token is
    encoded in one piece. Either way the ids are those of the tokenizer's own call on the whole text.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = spaced
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.model, self.kind = self.tokenizer.model, "H" if self.width == "<u2" else "I"
        # Byte-level models see each byte as a printable character: itself, or the next free one from 256 on.
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.shown = {b: 256 + i for i, b in enumerate(hidden)}
        self.memo: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of Latin letters, which stay together until the model: the tokenizer's model alone."""
        shown = ((" " if self.spaced else "") + word).encode().decode("latin-1").translate(self.shown)
        return array(self.kind, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _get(self, part: str) -> bytes:
        """Ids of a part as parts are keyed: behind a space if `spaced`, unless it begins with a line end."""
        got = self.memo.get(part)
        if got is None:
            if m := _MARKED.fullmatch(part):
                word, marks = (m[1] if self.spaced else m[1].lower()), m[2]
                got = self._word(word) if word == part else self._get(word)
                if marks:
                    if marks not in self.marks and len(self.marks) < MEMO:
                        self.marks[marks] = self._whole(marks)
                    got += self.marks.get(marks) or self._whole(marks)
            else:
                got = self._plain(part)
            if len(part) <= 64:
                self.memo[part] = got
        return got

    def _plain(self, part: str) -> bytes:
        if self.spaced and part[0] == "\n":
            return (self._whole("\n") if len(part) > 1 else b"") + self._whole(part[1:] or part)
        return self._whole(" " + part if self.spaced else part)

    def encode(self, text: str) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo.clear()
        if any(x in text for x in self.added):
            return np.frombuffer(self._whole(text), self.width)
        if self.spaced:
            if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _UNEVEN):
                return np.frombuffer(self._whole(text), self.width)
            head, *parts = text.replace("\n", " \n").split(" ")
        else:
            head, parts = "", text.replace("\n", " ").split(" ")
        got = list(map(self.memo.get, parts))
        if None in got:
            got = [self._get(x) if g is None else g for x, g in zip(parts, got, strict=True)]
        return np.frombuffer((self._whole(head) if head else b"") + b"".join(got), self.width)


def encoder_of(path: str, spaced: bool) -> WordEncoder:
    """The encoder of this Python process, which keeps its memo from task to task."""
    kept = sys.modules.setdefault("_quern_encoders", types.ModuleType("_quern_encoders")).__dict__
    if (path, spaced) not in kept:
        kept[path, spaced] = WordEncoder(path, spaced)
    return kept[path, spaced]


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class EliasFano:
    """A non-decreasing sequence of integers from 0 up, by `values` or by its `blob`."""

    SAMPLE = 64

    def __init__(self, values=None, blob: bytes | memoryview | None = None):
        if blob is None:
            values = np.asarray(values, np.uint64)
            self.n = len(values)
            top = int(values[-1]) if self.n else 0
            self.low_bits = max(0, (top // self.n).bit_length() - 1) if self.n else 0
            shifts = np.arange(self.low_bits, dtype=np.uint64)
            self.low = np.packbits((values[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
            ones = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(self.n)
            bits = np.zeros(int(ones[-1]) + 1 if self.n else 0, np.uint8)
            bits[ones] = 1
            self.high, self.samples = np.packbits(bits, bitorder="little"), ones[:: self.SAMPLE].astype("<u4")
        else:
            self.n, self.low_bits, low, high, samples = struct.unpack_from("<IIIII", blob)
            at = 20
            self.low = np.frombuffer(blob, np.uint8, low, at)
            self.high = np.frombuffer(blob, np.uint8, high, at + low)
            self.samples = np.frombuffer(blob, "<u4", samples, at + low + high)

    def blob(self) -> bytes:
        return struct.pack("<IIIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    def select(self, i: int) -> int:
        """Entry i, by the select sample before it and a count of the bits from there."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // self.SAMPLE]), i % self.SAMPLE
        byte, skip = at >> 3, at & 7
        here = int(self.high[byte]) >> skip << skip
        while (ones := here.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            here = int(self.high[byte])
        for _ in range(left):
            here &= here - 1
        place = byte * 8 + (here & -here).bit_length() - 1
        first = i * self.low_bits
        last = first + self.low_bits
        low = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little") >> (first & 7)
        return (place - i) << self.low_bits | low & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every entry, as uint64."""
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (place.astype(np.uint64) << np.uint64(self.low_bits)) | (low * weights).sum(1, dtype=np.uint64)


def write_shard(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A blob of documents in ascending order of id, nulls first."""
    width = ids[0].dtype.itemsize
    nulls = sum(x is None for x in doc_ids)
    known = doc_ids[nulls:]
    base = known[0] if known else 0
    starts = EliasFano(np.concatenate([[0], np.cumsum([len(x) for x in ids])])).blob()
    names = EliasFano(np.array([x - base for x in known], np.uint64)).blob()
    flat = np.concatenate(ids).tobytes()
    return struct.pack("<4sIIqQQQ", MAGIC, width, nulls, base, len(flat), len(starts), len(names)) + flat + starts + names


class Shard:
    """A blob read back; `doc(i)` takes one document without touching the others."""

    def __init__(self, blob: bytes):
        magic, width, self.nulls, self.base, flat, starts, names = struct.unpack_from("<4sIIqQQQ", blob)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = struct.calcsize("<4sIIqQQQ")
        self.ids = np.frombuffer(blob, f"<u{width}", flat // width, at)
        self.starts = EliasFano(blob=memoryview(blob)[at + flat : at + flat + starts])
        self.names = EliasFano(blob=memoryview(blob)[at + flat + starts : at + flat + starts + names])

    def __len__(self) -> int:
        return self.starts.n - 1

    def doc(self, i: int) -> np.ndarray:
        return self.ids[self.starts.select(i) : self.starts.select(i + 1)]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.names.select(i - self.nulls)


def write_shards(docs: DataFrame, encoder: Callable[[], WordEncoder], path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the table of shards (part, shard, before, n_ids, blob) to `path`, or to the shared folder
    without one, and reads it again. Parts and shards are in ascending order of doc_id.

    Equal ids are dealt by their texts' hash too, so neither a null id nor a repeated one makes a hot partition.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches):
        from pyspark import TaskContext

        part, shard, before, coder = TaskContext.get().partitionId(), 0, 0, encoder()
        end = np.array([end_id], coder.width)
        names, ids, size = [], [], 0

        def closed():
            numbers = {"part": (part, pa.int32()), "shard": (shard, pa.int32()), "before": (before, pa.int64()), "n_ids": (size, pa.int64()), "blob": (write_shard(names, ids), pa.binary())}
            return pa.RecordBatch.from_pydict({c: pa.array([v], t) for c, (v, t) in numbers.items()})

        for batch in pieces(batches, "text"):
            for name, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                own = np.concatenate([coder.encode(text), end])
                names.append(name)
                ids.append(own)
                size += len(own)
                if size >= shard_ids:
                    yield closed()
                    shard, before, names, ids, size = shard + 1, before + size, [], [], 0
        if names:
            yield closed()

    return staged(rows.select("doc_id", "text").mapInArrow(run, SHARDS), "shards", path)


SHARDS = "part int, shard int, before long, n_ids long, blob binary"


def shards_at(spark: SparkSession, path: str) -> DataFrame:
    """The shards that write_shards() left at path."""
    return spark.read.schema(SHARDS).parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the blobs alone."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    bases = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = shards.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("base"), "blob")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                base, blob = (batch.column(c)[i].as_py() for c in ("base", "blob"))
                shard = Shard(blob)
                cuts = shard.starts.all().astype(np.int64)
                names = [None] * shard.nulls + [int(x) + shard.base for x in shard.names.all()]
                crc = [crc_of(shard.ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(cuts[:-1] + base), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_elias_fano_ids(spark: SparkSession, sf_dir: str, path: str | None = None, out: str | None = None) -> DataFrame:
    """Null texts are empty and hold the end id alone; null ids come first; repeated rows each return
    a row; an empty table gives no shard and no row; extra columns are left out. `out` keeps the shards there."""
    path = path or tokenizer_path("word_bpe_49k.json")
    return read_shards(write_shards(table(spark, sf_dir, "documents"), lambda: encoder_of(path, spaced=False), out))
