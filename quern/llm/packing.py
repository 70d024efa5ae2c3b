"""Operator 4, sequence packing by best fit and swap-based local search.

Documents become pieces of at most `capacity` tokens. Pieces are dealt evenly into groups of about
`GROUP` and packed there: best fit in descending order, then a local search over underfull bins
that moves a piece, exchanges one for one, or gives one for two, always so that the sum of squared
fills grows, until a round over all underfull bins changes nothing or no bin can be saved any more.

Pieces of bins that stay underfull are dealt out anew, by another hash, into fewer groups and packed
again, round after round, as long as a round saves a bin for each of its groups, and at last one
group. A group is bounded, so the driver never sees pieces. Where best fit alone meets the bound of
tokens over capacity, the search has nothing to do.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, staged, table, texts_of
from .tokens import WordEncoder, crc_of, encoder_of, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: Pieces packed together.
GROUP = 20_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: each piece, longest first, goes to the fullest bin with room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the values of by_room that hold bins, ascending
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        at = bisect.bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room := room - need:
            if not by_room[room]:
                bisect.insort(rooms, room)
            by_room[room].append(b)
    return bins


class Search:
    """Local search over underfull bins; `bins` changes in place, emptied bins stay as empty lists.

    Receivers are taken from the fullest underfull bin down. Its room r takes, from a bin no fuller
    than itself, the exchange with the largest gain d <= r: a piece (move), a piece for a smaller
    one of its own, or a piece for two smaller ones. Tokens flow from an emptier to a fuller bin,
    so the sum of squared fills grows with each exchange and the search ends. `made` counts exchanges
    by the number of pieces given back.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.made = [0, 0, 0]

    def run(self) -> None:
        """Rounds in which every underfull bin receives, and may give to, all others, until one changes nothing."""
        while True:
            open_ = sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.capacity), key=lambda b: (self.fill[b], b))
            if sum(self.fill[b] for b in open_) > (len(open_) - 1) * self.capacity:
                return  # even a perfect packing needs as many bins
            if not self.round(open_):
                return

    def round(self, open_: list[int]) -> bool:
        self.owner = {i: b for b in open_ for i in self.bins[b]}
        self.heaps: dict[int, list] = {}
        self.least = np.full(self.capacity + 1, np.iinfo(np.int64).max)
        for b in open_:
            self.offer(b)
        for n in self.heaps:
            self.clean(n)
        changed = False
        for to in reversed(open_):
            while (room := self.capacity - self.fill[to]) and self.fill[to] and (step := self.best(to, room)):
                mine, piece = step
                source, gave = self.owner[piece], sum(self.lengths[i] for i in mine)
                touched = {self.lengths[i] for b in (to, source) for i in self.bins[b]}
                self.bins[source].remove(piece)
                self.bins[to].append(piece)
                self.owner[piece] = to
                for i in mine:
                    self.bins[to].remove(i)
                    self.bins[source].append(i)
                    self.owner[i] = source
                self.fill[to] += self.lengths[piece] - gave
                self.fill[source] -= self.lengths[piece] - gave
                if self.fill[to] == self.capacity:
                    for i in self.bins[to]:
                        del self.owner[i]
                else:
                    self.offer(to)
                self.offer(source)
                for n in touched:
                    self.clean(n)
                self.made[len(mine)] += 1
                changed = True
        return changed

    def offer(self, b: int) -> None:
        """Enters a bin's pieces by length, with its fill of now; entries of an earlier fill are void."""
        for i in self.bins[b]:
            heapq.heappush(self.heaps.setdefault(self.lengths[i], []), (self.fill[b], i))

    def valid(self, entry: tuple[int, int]) -> bool:
        return entry[1] in self.owner and self.fill[self.owner[entry[1]]] == entry[0]

    def clean(self, n: int) -> None:
        """Sets least[n]: the least fill of a bin with a piece of length n, less n."""
        heap = self.heaps[n]
        while heap and not self.valid(heap[0]):
            heapq.heappop(heap)
        self.least[n] = heap[0][0] - n if heap else np.iinfo(np.int64).max

    def best(self, to: int, room: int) -> tuple[tuple, int] | None:
        """(own pieces to give, piece to take) with the largest gain. Of pieces of one length one stands for all."""
        own = list({self.lengths[i]: i for i in self.bins[to]}.items())
        pairs = {n + m: (i, j) for x, (n, i) in enumerate(own) for m, j in own[x + 1 :]}
        pairs |= {2 * n: (i, j) for n, i in own if (j := next((j for j in self.bins[to] if self.lengths[j] == n and j != i), None)) is not None}
        top, choice = 0, None
        for size, mine in [(0, ()), *((n, (i,)) for n, i in own), *pairs.items()]:
            first = size + top + 1
            # A bin of that length's gives if it stays behind this one: its fill is below fill[to] + length - size.
            for n in (np.flatnonzero(self.least[first : size + room + 1] < self.fill[to] - size) + first)[::-1].tolist():
                heap, limit = self.heaps[n], self.fill[to] + n - size
                got = heap[0] if self.owner[heap[0][1]] != to else min((e for e in heap if e[0] < limit and self.valid(e) and self.owner[e[1]] != to), default=None)
                if got and got[0] < limit:
                    top, choice = n - size, (mine, got[1])
                    break
            if top == room:
                break
        return choice


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of piece numbers; empty bins are left out."""
    bins = best_fit(lengths, capacity)
    Search(bins, lengths, capacity).run()
    return [b for b in bins if b]


def pieces_of(docs: DataFrame, encoder: Callable[[], WordEncoder], end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def make():
        coder = encoder()
        end = np.array([end_id], coder.width)

        def step(batch):
            out = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = np.concatenate([coder.encode(text), end])
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    for c, v in zip(out, (doc, k, start, n, crc_of(ids[start : start + n])), strict=True):
                        out[c].append(v)
            return out

        return step

    return map_batches(only, "doc_id long, piece int, start long, length long, ids_crc32 long", "text", make)


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, mark long, sequence_id long, offset long, full boolean"
#: Bits of a sequence's number for the round, the group there and the bin there; numbers of sequences of one whole piece are below 0.
_GROUP_BITS, _BIN_BITS = 32, 24


def pack_groups(pieces: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """pieces with their sequence, the offset there, and whether it is full; each group by itself."""

    def run(key, group):
        group = group.sort_by("mark")
        lengths = group.column("length").to_pylist()
        bins = pack(lengths, capacity)
        name, offset, full = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
        for b, members in enumerate(bins):
            at, whole = 0, sum(lengths[i] for i in members) == capacity
            for i in members:
                name[i], offset[i], full[i] = (level << _GROUP_BITS | key[0].as_py()) << _BIN_BITS | b, at, whole
                at += lengths[i]
        return group.drop_columns(["g"]).append_column("sequence_id", pa.array(name, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).append_column("full", pa.array(full, pa.bool_()))

    return pieces.withColumn("g", F.pmod(F.xxhash64("mark", F.lit(level)), F.lit(groups)).cast("int")).groupBy("g").applyInArrow(run, PLACED)


def packed(docs: DataFrame, encoder: Callable[[], WordEncoder], end_id: int = END_ID, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty and hold the end id alone; null ids and repeated rows are packed like
    others; an empty table returns none; extra columns are left out.
    """
    # Each piece gets a number before it is written, by which even repeated rows are dealt evenly.
    rest = staged(pieces_of(docs, encoder, end_id, capacity).withColumn("mark", F.monotonically_increasing_id()), "pieces")
    whole = rest.where(F.col("length") == capacity)
    done = [whole.select("*", (-1 - F.col("mark")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("full"))]
    rest = rest.where(F.col("length") < capacity)
    left, before, level = rest.count(), None, 0
    while True:
        groups = max(1, -(-left // group))
        out = staged(pack_groups(rest, groups, capacity, level), f"packed{level}")
        open_ = out.where("not full")
        left, bins = open_.agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        if groups == 1 or (before is not None and before - bins - out.where("full and offset = 0").count() < groups):
            done.append(out)
            break
        done.append(out.where("full"))
        rest, before, level = open_.drop("sequence_id", "offset", "full"), bins, level + 1
    return reduce(DataFrame.unionByName, done).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_swap_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or tokenizer_path("byte_bpe_50k.json")
    return packed(table(spark, sf_dir, "documents"), lambda: encoder_of(path, spaced=True))
