"""Operator 10, language-model scores by deleted interpolation of orders one to three.

P(w|u,v) = a[b] c(u,v,w)/c(u,v) + d[b] c(v,w)/c(v) + e[b] c(w)/N + z[b]/(V+1), where b is the bucket
of the longest context that was seen, by its order and by powers of two of its count. The weights of
each bucket are learned by expectation-maximisation on counts of training documents that are held
out from the other counts. A document's first word has the START context alone at both orders.

Counting is bulk-synchronous. Documents become batches, a row each with the token numbers and the
hashes of the words; the table is bucketed by batch, so it is never shuffled. A batch sends its
distinct n-grams as sorted keys, cut into ranges of the key space and packed in bytes; the reducer of
a range adds up and answers with counts in the same order. An n-gram comes once from a batch, however
frequent it is, so none is a hot key; and a few bytes an n-gram are shipped, where a shuffle of rows
and a join back would ship tens. Answers are bucketed as the batches are. Three words whose first or
last two occur once in the corpus occur once themselves, so they are counted without being sent.

Batches and ranges both follow the input, so a row for each pair of them would grow as its square.
Therefore no sender has more than `FAN` ranges: beyond that, batches meet by cells first, where their
n-grams are merged, and the merged ones are sent on to finer ranges, over as many levels as it takes;
counts come back the same way. Rows then grow as the input times the levels, and what a reducer
holds stays the same.

EM runs on the driver over a histogram of held-out events by bucket and by ratios to half an octave;
a cell holds the exact means of its events. Its size is bounded by its axes. Scores use exact counts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, remainder, scratch, scratch_path, staged, table
from .simhash import LOWER

MODULUS, HELD_OUT = 5, 1
#: Of the training documents, those whose crc32 // MODULUS is 0 modulo this are held out for EM.
FOLDS = 8
#: Counts of an n-gram: in training documents without the fold, in the fold, in held-out documents.
COUNTS = ("rest", "held", "out")
#: Bytes of text in a batch, and ranges that one sender has.
BATCH_TEXT = 8 << 20
FAN = 1024
#: Buckets of contexts of two words, then those of one word where the two were not seen; 0 of the latter: neither was.
TWO, BUCKETS = 64, 64 + 65
EM_STEPS = 60
#: Cells of the histogram an octave.
RESOLUTION = 2
END, START = 0, 1
_END_HASH, _START_HASH = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Low bits that keys of an order leave out: words keep 64 bits, longer n-grams 56, which ship in fewer bytes.
SHORT = {1: np.uint64(0), 2: np.uint64(8), 3: np.uint64(8)}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def narrow(a: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs, lowest bytes of all first: high ones compress well."""
    a = np.ascontiguousarray(a, "<u8")
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes((width,)) + np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def widened(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view("<u8").ravel()


def packed_counts(a: np.ndarray) -> bytes:
    return zlib.compress(narrow(a), 1)


def unpacked_counts(b: bytes) -> np.ndarray:
    return widened(zlib.decompress(b)).astype(np.int64)


def packed_keys(keys: np.ndarray, n: int) -> bytes:
    """Ascending keys as the first and the steps between them."""
    return keys[:1].tobytes() + narrow(np.diff(keys >> SHORT[n]))


def unpacked_keys(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(blob[:8], np.uint64), widened(blob[8:]) << SHORT[n]]), dtype=np.uint64)


@dataclass(frozen=True)
class Shape:
    """Levels of the exchange and ranges a sender has at each; `tasks` wrote the batches."""

    fan: int
    levels: int
    tasks: int

    @classmethod
    def of(cls, tasks: int, most: int = FAN) -> Shape:
        ranges, levels = max(16, 2 * tasks), 1
        while (fan := next(f for f in range(2, ranges + 1) if f**levels >= ranges) if levels > 1 else ranges) > max(2, most):
            levels += 1
        return cls(fan, levels, tasks)

    def cell(self, batch: int) -> int:
        """The first level's cell of a batch: tasks that follow each other, fan ** (levels - 1) cells in all."""
        return (batch >> 32) * self.fan ** (self.levels - 1) // self.tasks


class Batch:
    """Tokens of some documents, each ended by END: `token` numbers words of `hashes`.

    `pair` numbers the distinct pairs, by the place where they end. At a document's first place
    `first` is true; `before` is the pair that ends a place earlier.
    """

    def __init__(self, token: np.ndarray, hashes: np.ndarray, lengths: np.ndarray):
        self.token, self.lengths, n = token.astype(np.int32), lengths, len(hashes)
        self.ends = np.cumsum(lengths)
        starts = self.ends - lengths
        self.context = np.concatenate([[START], self.token[:-1]]).astype(np.int32)
        self.context[starts] = START
        self.first = np.zeros(len(token), bool)
        self.first[starts] = True
        code, pair = np.unique(self.context * np.int64(n) + self.token, return_inverse=True)
        self.pair = pair.astype(np.int32)
        self.before = np.concatenate([self.pair[:1], self.pair[:-1]])
        self.hashes, self.two = hashes, mixed(mixed(hashes[code // n]) * np.uint64(3) + hashes[code % n])
        self.keys, self.order = {}, {}
        self._keyed(1, mixed(hashes))
        self._keyed(2, self.two)

    def _keyed(self, order: int, keys: np.ndarray) -> None:
        self.keys[order] = keys >> SHORT[order] << SHORT[order]
        self.order[order] = np.argsort(self.keys[order], kind="stable").astype(np.int32)

    def ask(self, lone: np.ndarray) -> None:
        """Numbers in `three` the distinct threes at the places `asked`: those of no pair that is `lone`, which occurs once."""
        self.lone = lone
        self.asked = ~(self.first | lone[self.before] | lone[self.pair])
        n = len(self.hashes)
        code, three = np.unique(self.before[self.asked] * np.int64(n) + self.token[self.asked], return_inverse=True)
        self.three = three.astype(np.int32)
        self._keyed(3, mixed(self.two[code // n] * np.uint64(5) + self.hashes[code % n]))

    def counts(self, order: int, docs: np.ndarray) -> np.ndarray:
        """How often each n-gram stands in the documents with docs true, by ascending key; START counts documents."""
        weight = np.repeat(docs, self.lengths)
        own, weight = {1: (self.token, weight), 2: (self.pair, weight), 3: (getattr(self, "three", None), weight[self.asked] if order == 3 else None)}[order]
        n = np.bincount(own[weight], minlength=len(self.keys[order]))
        if order == 1:
            n[START] = docs.sum()
        return n[self.order[order]]

    def sorted_keys(self, order: int) -> np.ndarray:
        return self.keys[order][self.order[order]]


class Store:
    """Tables in the shared folder, bucketed by batch so that joins on it shuffle nothing; drop() takes them from the catalog."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def put(self, df: DataFrame, key: str) -> DataFrame:
        self.names.append(f"quern_lm_{uuid.uuid4().hex}")
        df.write.format("parquet").option("path", scratch_path(self.spark, "lm")).option("compression", "zstd").bucketBy(self.buckets, key).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def answers(self, df: DataFrame) -> DataFrame:
        return self.put(df.repartition(self.buckets, "src"), "src")

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def batched(docs: DataFrame) -> DataFrame:
    """Batches of docs as rows."""
    kind = dict(docs.dtypes)["doc_id"]
    crc = remainder(F.col("doc_id"), 1 << 32)
    only = docs.select("doc_id", F.col("text").alias("text"), (crc % MODULUS == HELD_OUT).alias("held_out"), (F.floor(crc / MODULUS) % FOLDS == 0).alias("fold"))

    def run(batches):
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        number = TaskContext.get().partitionId() << 32
        for rb in joined(batches, BATCH_TEXT):
            words: dict[bytes, int] = {}
            flat, lengths = [], []
            for text in rb.column("text"):
                own = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
                for w in own:
                    if w not in words:
                        words[w] = len(words) + 2
                flat.append(np.array([*map(words.__getitem__, own), END], np.uint32))
                lengths.append(len(own) + 1)
            hashes = np.array([_END_HASH, _START_HASH, *(xxh64_intdigest(w, 1) for w in words)], np.uint64)
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([rb.column("doc_id").to_pylist()], pa.list_(rb.schema.field("doc_id").type)), pa.array([rb.column("held_out").to_pylist()]), pa.array([rb.column("fold").to_pylist()]),
                pa.array([narrow(np.array(lengths))]), pa.array([narrow(np.concatenate(flat))]), pa.array([hashes.tobytes()]),
            ], names=["batch", "doc_id", "held_out", "fold", "lengths", "tokens", "hashes"])
            number += 1

    return only.mapInArrow(run, f"batch long, doc_id array<{kind}>, held_out array<boolean>, fold array<boolean>, lengths binary, tokens binary, hashes binary")


def joined(batches, limit: int):
    """Record batches put together until `text` holds about `limit` bytes in each."""
    held, size = [], 0
    for rb in pieces(batches, "text", limit):
        own = rb.column("text").nbytes
        if held and size + own > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(rb)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def rows_of(rb: pa.RecordBatch):
    """Rows as dicts, one in memory at a time if the caller lets go of each before the next."""
    for i in range(rb.num_rows):
        yield rb.slice(i, 1).to_pylist()[0]


def batch_of(row: dict) -> Batch:
    return Batch(widened(row["tokens"]), np.frombuffer(row["hashes"], np.uint64), widened(row["lengths"]).astype(np.int64))


SENT = "n int, cell long, part long, src long, keys binary, rest binary, held binary, out binary"
ANSWERS = "src long, n int, part long, rest binary, held binary, out binary, totals array<long>"
TOKENS = ["batch", "held_out", "fold", "lengths", "tokens", "hashes"]


def cut(n: int, cell: int, src: int, keys: np.ndarray, counts: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    """Rows of SENT: a sender's ascending keys with their counts, by the range of the key space they lie in."""
    part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
    rows = [(n, cell, int(part[lo]), src, packed_keys(keys[lo:hi], n), *(packed_counts(c[lo:hi]) for c in counts)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["n", "cell", "part", "src", "keys", *COUNTS])


def sent(batches: DataFrame, shape: Shape, orders: tuple[int, ...]) -> DataFrame:
    """SENT: distinct n-grams of each batch by range, with their counts. Order 3 needs the answers to 1 and 2 as `answers`."""

    def run(rbs):
        for rb in rbs:
            for row in rows_of(rb):
                b = batch_of(row)
                if 3 in orders:
                    b.ask(Counts(b, row["answers"], COUNTS).pairs == 1)
                out, fold = np.array(row["held_out"], bool), np.array(row["fold"], bool)
                for n in orders:
                    yield cut(n, shape.cell(row["batch"]), row["batch"], b.sorted_keys(n), [b.counts(n, docs) for docs in (~out & ~fold, ~out & fold, out)], shape.fan)
                del row, b  # before the next row is read and numbered

    return batches.mapInArrow(run, SENT)


def _summed(group: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Of the rows of a range: where each one's keys begin among all, the number of each key, the distinct keys, their counts."""
    keys = [unpacked_keys(b, n) for b in group.column("keys").to_pylist()]
    cuts = np.cumsum([0, *map(len, keys)])
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = {c: np.bincount(at, weights=np.concatenate([unpacked_counts(x) for x in group.column(c).to_pylist()]), minlength=len(found)).astype(np.int64) for c in COUNTS}
    return cuts, at, found, total


def _answer_table(group: pa.Table, n: int, cuts: np.ndarray, at: np.ndarray, total: dict, first: list | None = None) -> pa.Table:
    own = {c: pa.array([packed_counts(v[at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for c, v in total.items()}
    totals = [first, *[None] * (group.num_rows - 1)]
    return pa.table({"src": group.column("src"), "n": pa.array([n] * group.num_rows, pa.int32()), "part": group.column("part"), **own, "totals": pa.array(totals, pa.list_(pa.int64()))})


def answered(blobs: DataFrame) -> DataFrame:
    """ANSWERS: corpus counts of each row's keys in its order. totals is [tokens, kinds] of training
    without and [tokens, kinds] with the fold, on the first row of a range of words."""

    def run(key, group):
        n = key[0].as_py()
        cuts, at, found, total = _summed(group, n)
        first = None
        if n == 1:
            word = found != mixed(np.array([_START_HASH], np.uint64))[0]
            both = total["rest"] + total["held"]
            first = [int(total["rest"][word].sum()), int((total["rest"][word] > 0).sum()), int(both[word].sum()), int((both[word] > 0).sum())]
        return _answer_table(group, n, cuts, at, total, first)

    return blobs.groupBy("n", "part").applyInArrow(run, ANSWERS)


def exchanged(blobs: DataFrame, shape: Shape, keep: Callable[[DataFrame], DataFrame], level: int = 1) -> tuple[DataFrame, DataFrame]:
    """ANSWERS to the rows of SENT, as `keep` stores them, and those of the last level, which hold the totals."""
    if level == shape.levels:
        out = keep(answered(blobs))
        return out, out
    blobs = staged(blobs, "sent")

    def merge(key, group):
        n, cell, part = (k.as_py() for k in key)
        _, _, found, total = _summed(group, n)
        own = {"keys": packed_keys(found, n), **{c: packed_counts(v) for c, v in total.items()}}
        return pa.table({"n": pa.array([n], pa.int32()), "cell": [cell], "part": [part], "src": [cell << 32 | part], **{c: pa.array([v], pa.binary()) for c, v in own.items()}})

    def lift(rbs):
        for rb in rbs:
            for r in rows_of(rb):
                yield cut(r["n"], r["cell"] // shape.fan, r["src"], unpacked_keys(r["keys"], r["n"]), [unpacked_counts(r[c]) for c in COUNTS], shape.fan ** (level + 1))

    def back(key, group, above):
        n = key[0].as_py()
        cuts, at, _, _ = _summed(group, n)
        got = sorted(above.to_pylist(), key=lambda r: r["above"])
        return _answer_table(group, n, cuts, at, {c: np.concatenate([unpacked_counts(r[c]) for r in got]) for c in COUNTS})

    units = staged(blobs.groupBy("n", "cell", "part").applyInArrow(merge, SENT), "merged")
    above, last = exchanged(units.mapInArrow(lift, SENT), shape, lambda df: staged(df, "answers"), level + 1)
    unit = above.select("n", F.shiftright("src", 32).alias("cell"), F.col("src").bitwiseAND((1 << 32) - 1).alias("part"), F.col("part").alias("above"), *COUNTS)
    return keep(blobs.groupBy("n", "cell", "part").cogroup(unit.groupBy("n", "cell", "part")).applyInArrow(back, ANSWERS)), last


class Counts:
    """Corpus counts for a batch from the answers to it, over the documents that `of` names.

    `pairs` of each distinct pair; once asked() for each token c(u,v,w), c(u,v), c(v,w), c(v), c(w)."""

    def __init__(self, batch: Batch, answers: list[dict], of: tuple[str, ...]):
        self.batch, self.answers, self.of = batch, answers, of
        self.words, self.pairs = self._got(1), self._got(2)

    def _got(self, n: int) -> np.ndarray:
        mine = sorted((a for a in self.answers if a["n"] == n), key=lambda a: a["part"])
        got = np.zeros(len(self.batch.keys[n]), np.int64)
        if mine:
            got[self.batch.order[n]] = sum(np.concatenate([unpacked_counts(a[c]) for a in mine]) for c in self.of)
        return got

    def asked(self, more: list[dict] | None) -> Counts:
        """Counts of threes from further answers; a three of a pair that occurs once has that pair's count."""
        b, self.answers = self.batch, more or []
        self.pair, self.context, self.word = self.pairs[b.pair], self.words[b.context], self.words[b.token]
        self.two = np.where(b.first, self.context, self.pairs[b.before])
        self.three = np.where(b.lone[b.before] & ~b.first, self.two, self.pair)
        self.three[b.asked] = self._got(3)[b.three]
        return self

    def parts(self, tokens: int, on: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
        """The three maximum-likelihood estimates; 0 for a context not seen."""
        return [self.three[on] / np.maximum(self.two[on], 1), self.pair[on] / np.maximum(self.context[on], 1), self.word[on] / max(1, tokens)]


def counted(row: dict, of: tuple[str, ...]) -> tuple[Batch, Counts]:
    """A row's batch, with counts over the documents that `of` names."""
    b = batch_of(row)
    b.ask(Counts(b, row["answers"], COUNTS).pairs == 1)
    return b, Counts(b, row["answers"], of).asked(row["more"])


def bucket_of(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """1 + log2 of the count of the two-word context, or where it is 0, TWO and so much of the one-word context (TWO for 0)."""
    of = lambda c: np.frexp(c.astype(np.float64))[1]
    return np.where(two > 0, np.minimum(of(two), TWO - 1), TWO + of(one) * (one > 0)).astype(np.int64)


def ratio_cell(ratio: np.ndarray, resolution: int) -> np.ndarray:
    """-resolution * log2(ratio) rounded; the last cell for 0."""
    with np.errstate(divide="ignore"):
        x = -resolution * np.log2(ratio)
    return np.where(ratio > 0, np.clip(np.rint(x), 0, 64 * resolution - 1), 64 * resolution).astype(np.int64)


def learned(bucket: np.ndarray, parts: np.ndarray, n: np.ndarray, kinds: int) -> np.ndarray:
    """Weights (BUCKETS, 4) of three words, two, one and none by EM over events of `n` counts with `parts` (events, 3)."""
    f = np.concatenate([parts, np.full((len(n), 1), 1 / (kinds + 1))], 1)
    can = np.ones((BUCKETS, 4))
    can[TWO:, 0] = 0  # an unseen context has no estimate
    can[TWO, 1] = can[0] = 0
    can[:, 3] = 1
    weights = can * [0.3, 0.3, 0.3, 0.1]
    weights /= weights.sum(1, keepdims=True)
    for _ in range(EM_STEPS if len(n) else 0):
        p = f * weights[bucket]
        p *= (n / p.sum(1))[:, None]
        new = can * (np.stack([np.bincount(bucket, p[:, j], BUCKETS) for j in range(4)], 1) + [1e-3, 1e-3, 1e-3, 1e-2])
        weights = new / new.sum(1, keepdims=True)
    return weights


def op10_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


def scores(docs: DataFrame, fan: int = FAN, resolution: int = RESOLUTION) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row per row of docs.

    Null texts are empty: one end token. A null doc_id counts as the empty id when documents are
    dealt into training. Repeated rows each count and each return a row. Without training documents
    all words are unknown and N is 0. An empty table returns none; extra columns are left out.
    Two n-grams whose hashes (64 bits for words, 56 for longer ones) collide share a count.
    """
    spark = docs.sparkSession
    with scratch(spark):
        shape = Shape.of(max(1, docs._jdf.rdd().getNumPartitions()), fan)
        store = Store(spark, min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * shape.tasks)))
        try:
            return staged(_scored(store.put(batched(docs), "batch"), shape, store, dict(docs.dtypes)["doc_id"], resolution), "lm_scores", keep=True)
        finally:
            store.drop()


def _scored(batches: DataFrame, shape: Shape, store: Store, kind: str, resolution: int) -> DataFrame:
    def gathered(answers: DataFrame, name: str) -> DataFrame:
        """A row a batch: `fan` answers an order at most."""
        return answers.groupBy("src").agg(F.collect_list(F.struct("n", "part", *COUNTS)).alias(name)).withColumnRenamed("src", f"{name}_of")

    answers, last = exchanged(sent(batches.select(TOKENS), shape, (1, 2)), shape, store.answers)
    sums = last.where(F.col("totals").isNotNull()).agg(*(F.sum(F.col("totals")[i]) for i in range(4))).first()
    rest_tokens, rest_kinds, tokens, kinds = (int(x or 0) for x in sums)
    met = batches.join(gathered(answers, "answers"), F.col("batch") == F.col("answers_of")).drop("answers_of")
    more, _ = exchanged(sent(met.select(*TOKENS, "answers"), shape, (3,)), shape, store.answers)
    met = met.join(gathered(more, "more"), F.col("batch") == F.col("more_of"), "left").drop("more_of")
    axis = 64 * resolution + 1

    def events(rbs):
        for rb in rbs:
            for row in rows_of(rb):
                b, c = counted(row, ("rest",))
                on = np.repeat(~np.array(row["held_out"], bool) & np.array(row["fold"], bool), b.lengths)
                code, parts = bucket_of(c.two[on], c.context[on]), c.parts(rest_tokens, on)
                for p in parts:
                    code = code * axis + ratio_cell(p, resolution)
                found, at, n = np.unique(code, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64()), *(pa.array(np.bincount(at, p, len(found))) for p in parts)], names=["code", "n", "s3", "s2", "s1"])
                del row, b, c, on, code, parts, p, at

    wanted = met.where(F.exists(F.zip_with("held_out", "fold", lambda h, f: f & ~h), lambda x: x)).select(*TOKENS, "answers", "more")
    cells = wanted.mapInArrow(events, "code long, n long, s3 double, s2 double, s1 double").groupBy("code").agg(*(F.sum(c).alias(c) for c in ("n", "s3", "s2", "s1"))).toArrow()
    n = cells.column("n").to_numpy()
    parts = np.stack([cells.column(c).to_numpy() / np.maximum(n, 1) for c in ("s3", "s2", "s1")], 1)
    weights = learned(cells.column("code").to_numpy() // axis**3, parts, n, rest_kinds)

    def run(rbs):
        for rb in rbs:
            for row in rows_of(rb):
                b, c = counted(row, ("rest", "held"))
                bucket = bucket_of(c.two, c.context)
                p = weights[bucket, 3] / (kinds + 1)
                for j, part in enumerate(c.parts(tokens)):
                    p += weights[bucket, j] * part
                starts = b.ends - b.lengths
                add = lambda x: np.add.reduceat(x, starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_id"], rb.schema.field("doc_id").type.value_type), pa.array(row["held_out"], pa.bool_()), pa.array(b.lengths, pa.int64()), pa.array(add((c.word > 0).astype(np.int64))), pa.array(np.full(len(starts), tokens), pa.int64()),
                    pa.array(add(np.log10((c.word + 0.5) / (tokens + 0.5 * (kinds + 1))))), pa.array(add(np.log10(p))),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                del row, b, c, bucket, p, part, starts

    return met.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
