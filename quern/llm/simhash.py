"""Operator 5, SimHash near-dedup over a Gray-order hierarchical index.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. Fingerprints
that differ in few bits are linked, and links join documents into components.

Search: distinct fingerprints are dealt into buckets that agree on a block of bits. Radius r and
r + 1 blocks make this exact, since two fingerprints within r bits agree on one block at least. A
bucket over `bucket_rows` is dealt again by blocks of its remaining bits, so no hot bucket stays
whole; distinct fingerprints end this by themselves. In each bucket the fingerprints are sorted by
Gray rank, which puts alike bit patterns side by side; runs of them form nodes that hold the bits
all members share, a parent factors out what its children share, and a search adds up differences
from the root and drops a whole group once they pass the radius. A bucket returns a spanning forest
of its links, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, reserved, staged, table, texts_of

SHINGLE = 3
RADIUS = 3
BUCKET_ROWS = 1024
#: Rows of a list of (id, hash) that is broadcast at most.
BROADCAST_ROWS = 500_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ALL = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; 0 without words. Null is the empty text; any length is taken whole."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i : i + n] for i in range(shingle)), strict=True))
    hashes = np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the binary reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A hierarchical Hamming index over distinct uint64 codes.

    Level 0 holds nodes of `fan` codes that follow each other in Gray order; each higher level
    groups `fan` nodes. `bits[l]` are the positions on which all below a node agree and its parent
    does not say so yet, `value[l]` the agreed bits.
    """

    def __init__(self, codes: np.ndarray, fan: int = 8):
        self.fan, self.order = fan, np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        low, high, levels = self.codes, self.codes, []  # AND and OR of all members
        while True:
            at = np.arange(0, len(low), fan)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            levels.append((low, ~(low ^ high)))
            if len(low) <= fan:
                break
        self.value = [v for v, _ in levels]
        own = [m for _, m in levels]
        self.bits = [m & ~np.repeat(own[i + 1], fan)[: len(m)] if i + 1 < len(own) else m for i, m in enumerate(own)]
        self.rest = ~np.repeat(own[0], fan)[: len(codes)]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, code number) at `radius` bits or fewer."""
        q = np.repeat(np.arange(len(queries)), len(self.value[-1]))
        node = np.tile(np.arange(len(self.value[-1])), len(queries))
        off = np.zeros(len(q), np.uint8)
        for level in range(len(self.value) - 1, -2, -1):
            value, bits = (self.value[level], self.bits[level]) if level >= 0 else (self.codes, self.rest)
            off = off + np.bitwise_count((queries[q] ^ value[node]) & bits[node])
            keep = off <= radius
            q, node, off = q[keep], node[keep], off[keep]
            if level >= 0:
                below = len(self.value[level - 1]) if level else len(self.codes)
                q, off = np.repeat(q, self.fan), np.repeat(off, self.fan)
                node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                keep = node < below
                q, node, off = q[keep], node[keep], off[keep]
        return q, self.order[node]


def forest(codes: np.ndarray, radius: int, block: int = 256) -> np.ndarray:
    """For each code the number of the first code of its component under links of `radius` bits."""
    label = np.arange(len(codes))
    index = GrayIndex(codes)
    for at in range(0, len(codes), block):
        a, b = index.search(codes[at : at + block], radius)
        a = a + at
        a, b = a[a != b], b[a != b]
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def blocks_of(mask: int, parts: int) -> list[int]:
    """The bits that `mask` leaves, in `parts` blocks of nearly equal size, each with `mask`."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(codes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) between the distinct codes of column `fp` that span the links of every bucket."""
    spark, found = codes.sparkSession, None
    masks, todo = blocks_of(0, radius + 1), codes.select("fp")
    dealt = todo.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    for level in range(64):
        dealt = dealt.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"), "fp")
        hot = staged(dealt.groupBy("mask", "bucket").count().where(F.col("count") > bucket_rows).select("mask", "bucket"), "hot")
        some = bool(hot.take(1))
        cold = dealt.join(hot, ["mask", "bucket"], "left_anti") if some else dealt
        own = _bucket_links(cold, radius)
        found = own if found is None else found.unionByName(own)
        if not some:
            return found
        masks = list(dict.fromkeys(masks))
        finer = spark.createDataFrame([(_signed(m), _signed(x)) for m in masks for x in dict.fromkeys(blocks_of(m, radius + 1)) if x != m], "mask long, finer long")
        masks = [x for m in masks for x in dict.fromkeys(blocks_of(m, radius + 1)) if x != m]
        again = dealt.join(hot, ["mask", "bucket"], "left_semi")
        dealt = staged(again.join(F.broadcast(finer), "mask").select("fp", F.col("finer").alias("mask")).distinct(), f"hot{level}")
    raise AssertionError("distinct codes have at most 64 bits to split by")


def _bucket_links(dealt: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        held = None  # the rows of the last bucket may go on in the next batch
        for batch in [*batches, None]:
            if batch is not None:
                rows = np.stack([np.asarray(batch.column(c)) for c in ("mask", "bucket", "fp")])
                held = rows if held is None else np.concatenate([held, rows], axis=1)
            if held is None or not held.shape[1]:
                continue
            new = np.flatnonzero((held[:2, 1:] != held[:2, :-1]).any(0)) + 1
            cuts = [0, *new.tolist(), held.shape[1]]
            done = len(cuts) - 1 if batch is None else len(cuts) - 2
            a, b = [], []
            for lo, hi in zip(cuts[:done], cuts[1 : done + 1], strict=True):
                if hi - lo > 1:
                    own = held[2, lo:hi]
                    root = forest(own.view(np.uint64), radius)
                    other = root != np.arange(len(own))
                    a.append(own[other])
                    b.append(own[root[other]])
            held = held[:, cuts[done] :].copy()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return dealt.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of an edge (a, b) the least node it reaches.

    Alternates large-star and small-star steps (Kiveris et al. 2014) as joins on minima, each round
    written to the shared folder, until a round changes nothing. Hubs meet in sums and in joins
    that can be split at run time.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = staged(small.where("u <> v").distinct(), "small")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, copy): copy is the XXH64 of the text, which tells rows of one id apart."""
    kind = dict(docs.dtypes)[id_col]
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("copy"))

    def make():
        return lambda b: {"doc_id": b.column("doc_id"), "fp": np.array([fingerprint(t, shingle) for t in texts_of(b)], np.uint64).view(np.int64), "copy": b.column("copy")}

    return map_batches(only, f"doc_id {kind}, fp long, copy long", "text", make)


def roots(prints: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, root) for each distinct fingerprint of `prints`."""
    codes = staged(prints.groupBy("fp").agg(F.count("*").alias("rows")), "codes")
    star = components(links(codes, radius, bucket_rows))
    return staged(codes.join(star, codes["fp"] == star["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def near_groups(docs: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, copy, root, component_id), a row per row of docs.

    Nulls: a null text is the empty text, with fingerprint 0 as any text without words; a null
    doc_id is never the smallest, so component_id is null only if no id of the component is known.
    Repeated rows each return a row. An empty table returns an empty result. Extra columns are left
    out, whatever their names.
    """
    prints = staged(with_fingerprints(docs, shingle=shingle), "prints")
    of = roots(prints, radius, bucket_rows)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    least = of.join(first, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    named = staged(of.join(least, "root"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "copy", "root", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, one of each near-duplicate group: that of the smallest doc_id, and of these the
    smallest text hash, with all their columns, whatever their names.

    A null text is the empty text, and one of those stays; of repeated rows one stays; a null doc_id
    is chosen only in a group without others; an empty table stays empty. Groups and ties are
    resolved on ids and hashes. The list of rows that go, or of repeated rows to be told apart, is
    broadcast up to `broadcast_rows`, and texts stay where they are; beyond that they move once.
    """
    groups = staged(near_groups(docs), "groups")
    pick = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copy")).alias("k")).select(F.col("root").alias("of"), F.col("k.doc_id").alias("first"), F.col("k.copy").alias("first_copy"))
    # By row, not by root, which may be one for a third of all rows; the root follows from the text.
    rows = groups.groupBy("doc_id", "copy").agg(F.count("*").alias("times"), F.min("root").alias("root"))
    id_, hash_, times = (reserved(x, docs) for x in ("id", "hash", "times"))
    # Rows that go whole (times 0) and those of which one of several stays.
    listed = rows.join(pick, F.col("root") == F.col("of"))
    stays = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("copy") == F.col("first_copy"))
    listed = listed.select(F.col("doc_id").alias(id_), F.col("copy").alias(hash_), F.when(stays, F.col("times")).otherwise(0).alias(times)).where(F.col(times) != 1)
    listed = staged(listed, "listed")
    near = (lambda df: F.broadcast(df)) if listed.count() <= broadcast_rows else (lambda df: df.hint("merge"))
    own = docs.withColumn(hash_, F.xxhash64(F.coalesce("text", F.lit(""))))
    own_id, own_hash = own["doc_id"], own[hash_]
    listed = listed.withColumnRenamed(hash_, f"{hash_}_listed")
    several = listed.where(F.col(times) > 1)
    on = lambda df: own_id.eqNullSafe(df[id_]) & (own_hash == df[f"{hash_}_listed"])
    once = own.join(near(listed), on(listed), "left_anti")
    again = own.join(near(several), on(several), "left_semi").dropDuplicates(["doc_id", hash_])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return once.select(*columns).unionByName(again.select(*columns))
