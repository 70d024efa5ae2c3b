"""Operator 9, benchmark decontamination by winnowing, in DataFrame functions only.

Of every `SPAN - GRAM + 1` consecutive k-gram hashes winnowing keeps those equal to the least, so
any `SPAN` shared words share a kept hash (Schleimer et al. 2003). Kept hashes of documents meet
those of the benchmark in a join, and each meeting is extended word by word to both sides: `SPAN`
equal words or more are a hit, exactly. Items shorter than SPAN are one window of their own
length, of which every gram is kept; grams of all lengths are taken in one pass over a text.

A sieve of one bit a hash, made from the benchmark's index, tells most grams of documents apart from
all of the index's before they are winnowed, so minima are sought and words gathered for the few that
are left. These meet the index where they lie if it has at most `BROADCAST_ROWS` rows, of about
2 * SPAN words each, and by a shuffle of both otherwise. Texts are never shuffled by the search.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import reserved, staged, table

SPAN = 10
GRAM = 5
#: Rows of the index, or keys of documents, that are broadcast at most.
BROADCAST_ROWS = 250_000
#: Documents are searched in segments of so many words, which overlap by a window.
SEGMENT = 4096
#: Bits of the sieve that grams pass before they are winnowed, a power of two.
SIEVE_BITS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def n_words(text: Column) -> Column:
    """How many words(text) has; letters of either case are none of its separators, so it counts them as they stand."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long")


def sieve(index: DataFrame) -> Callable[[Column], Column]:
    """A test that each hash of the index passes, and others seldom: one bit of SIEVE_BITS by the hash.

    The bits are a constant of the plan, of one size for every index.
    """
    place = F.col("hash").bitwiseAND(SIEVE_BITS - 1)
    rows = index.select(F.shiftright(place, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    held = {r[0]: r[1] for r in rows.collect()}  # SIEVE_BITS / 64 rows at most
    table = F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(SIEVE_BITS >> 6))), ",").cast("array<bigint>")
    return lambda g: F.getbit(F.get(table, F.shiftright(g.bitwiseAND(SIEVE_BITS - 1), 6).cast("int")), g.bitwiseAND(63).cast("int")) == 1


def kept_grams(span: int, gram: int, some: Callable[[Column], Column] | None = None) -> Column:
    """Array of (at, hash, n): the grams of column `words` that winnowing keeps, from their word hashes in
    column `hashes`; at from 0, n the span.

    With `some`, only grams that it lets through are looked at: each kept one of those is picked.
    Array entries are taken one by one: slice() copies the whole array each time.
    """
    width, n = span - gram + 1, F.size("hashes")
    salt = F.lit(span)  # grams of several lengths share one index
    grams = F.transform("hashes", lambda h, i: F.when(i <= n - gram, F.xxhash64(salt, h, *(F.get("hashes", i + j) for j in range(1, gram)))))

    def picked(all_grams: Column) -> Column:
        def kept(g: Column, i: Column) -> Column:
            """Whether g is the least of a whole window of grams with place i."""
            least = lambda s: F.least(*(F.get(all_grams, s + j) for j in range(width))) if width > 1 else F.get(all_grams, s)
            return reduce(Column.__or__, ((i - j >= 0) & (i - j <= n - span) & (g == least(i - j)) for j in range(width)))

        def pick(g: Column, i: Column) -> Column:
            found = F.when(kept(g, i), F.struct(i.alias("at"), g.alias("hash"), F.lit(span).alias("n")))
            return F.when(g.isNotNull() & some(g) if some else g.isNotNull(), found)

        return F.filter(F.transform(all_grams, pick), lambda p: p.isNotNull())

    return F.flatten(F.transform(F.array(grams), picked))


def grams_around(df: DataFrame, keep: list[str], lengths: dict[int, int], some: Callable[[Column], Column] | None = None) -> DataFrame:
    """The columns `keep` and at, hash, n, ctx of each kept gram of `words`, for each span with its gram in
    `lengths`. ctx holds the words around it that a window with it can reach, null beyond the ends.

    explode_outer(), as a filter that Spark infers for explode() would evaluate the picks once more,
    inlined down to the text; and no array of a whole document goes along with each gram.
    """
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("picks", F.concat(*(kept_grams(span, gram, some) for span, gram in lengths.items())))
    reach = max((span - gram for span, gram in lengths.items()), default=0)
    size = reach + max(lengths.values())
    around = F.transform("picks", lambda p: F.struct(p.at.alias("at"), p.hash.alias("hash"), p.n.alias("n"), F.array(*(F.get("words", p.at + j) for j in range(-reach, size))).alias("ctx")))
    return df.select(*keep, F.explode_outer(around).alias("p")).where(F.col("p").isNotNull()).select(*keep, "p.*")


def segments(docs: DataFrame, span: int) -> DataFrame:
    """docs (key, words) cut into (key, base, words) of at most SEGMENT + span - 1 words, so that each window stands whole in one."""
    n = F.floor(F.greatest(F.size("words") - 1, F.lit(0)) / SEGMENT).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((i * SEGMENT).alias("base"), F.slice("words", i * SEGMENT + 1, F.lit(SEGMENT + span - 1)).alias("words")))
    return docs.select("key", F.explode_outer(parts).alias("s")).select("key", "s.base", "s.words")


def hits_of(docs: DataFrame, index: DataFrame, lengths: dict[int, int], broadcast_rows: int) -> DataFrame:
    """(key, content, start, end) of the spans of docs (key, words) that hold windows of the index (content, hash, n, item_ctx)."""
    rows = grams_around(segments(docs, max(lengths)), ["key", "base"], lengths, sieve(index))
    met = rows.join(F.broadcast(index) if index.count() <= broadcast_rows else index.hint("merge"), ["hash", "n"])
    reach = max(span - gram for span, gram in lengths.items())
    gram = reduce(lambda c, x: c.when(F.col("n") == x[0], x[1]), lengths.items(), F).otherwise(0)
    here = lambda i: F.get("ctx", i) == F.get("item_ctx", i)

    def run(step: int, first: Column | int) -> Column:
        """How many words agree one after the other, to the left (step -1) or the right, up to the window's reach."""
        out = F
        for d in range(reach):
            out = out.when((F.lit(d) >= F.col("n") - F.col("gram")) | ~F.coalesce(here(F.lit(first + d * step) if isinstance(first, int) else first + d * step), F.lit(False)), d)
        return out.otherwise(reach) if reach else F.lit(0)

    met = met.withColumn("gram", gram)
    same = F.lit(True)
    for j in range(max(lengths.values())):
        same = same & ((F.col("gram") <= j) | F.coalesce(here(F.lit(reach + j)), F.lit(False)))
    met = met.where(same).select("key", "content", "n", "gram", (F.col("base") + F.col("at") + 1).alias("pos"), run(-1, reach - 1).alias("left"), run(1, F.lit(reach) + F.col("gram")).alias("right"))
    return met.where(F.col("left") + F.col("right") + F.col("gram") >= F.col("n")).select("key", "content", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("gram") - 1 + F.col("right")).alias("end")).distinct()


def key_of(text: Column) -> Column:
    """Documents of one text share one result, found by this key."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def find_hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Spans (key, content, start, end), and items (content, item): `content` names a distinct item text.

    Null or wordless texts have no spans; a null item_id counts as the empty id.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = staged(items.withColumn("content", F.md5(F.array_join("words", " ").cast("binary"))), "items")
    texts = staged(items.dropDuplicates(["content"]).select("content", "words"), "contents")
    short = [r[0] for r in texts.where(F.size("words") < span).select(F.size("words")).distinct().collect()]  # below `span` values
    lengths = {span: gram} | {n: n for n in sorted(short)}
    own = lambda n: F.size("words") >= span if n == span else F.size("words") == n
    index = staged(grams_around(texts, ["content", "words"], lengths).where(reduce(Column.__or__, ((F.col("n") == n) & own(n) for n in lengths))).select("content", "hash", "n", F.col("ctx").alias("item_ctx")).distinct(), "index")
    long = docs.select(key_of(F.col("text")).alias("key"), words(F.col("text")).alias("words"))
    return staged(hits_of(long, index, lengths, broadcast_rows), "hits"), items.select("content", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words; repeated rows each return a row; empty tables give no hits or no
    rows; extra columns are left out, whatever their names.
    """
    hits, items = find_hits(docs, benchmark, span, gram, broadcast_rows)
    placed = hits.select("key", F.explode(F.sequence("start", "end")).alias("at")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    named = hits.select("key", "content").distinct().join(items, "content").select("key", "item").distinct()
    named = named.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    result = staged(placed.join(named, "key").select("key", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256")), "hit_docs")
    own = docs.select("doc_id", key_of(F.col("text")).alias("key"), n_words(F.col("text")).alias("n_words"))
    return own.join(result, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op9_winnow_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns, whatever their names.

    Null and wordless texts stay; repeated rows share one fate; an empty table stays empty, an empty
    benchmark drops none. Keys of contaminated texts, 16 bytes each, are broadcast up to
    `broadcast_rows`, so texts stay where they are; beyond that both sides are shuffled once.
    """
    hits, _ = find_hits(docs, benchmark, broadcast_rows=broadcast_rows)
    key = reserved("key", docs)
    keys = staged(hits.select(F.unhex("key").alias(key)).distinct(), "keys")
    keys = F.broadcast(keys) if keys.count() <= broadcast_rows else keys.hint("merge")
    own = docs.withColumn(key, F.unhex(key_of(F.col("text")))).join(keys, key, "left_anti")
    return own.select(*(own[f"`{c}`"] for c in docs.columns))


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
dw AS (
  SELECT rid, p, n, array_to_string(ws[p:p + n - 1], ' ') AS win
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p
        FROM w, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
h AS (SELECT rid, item_id, p, n FROM dw JOIN iw USING (n, win)),
a AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS place FROM h) GROUP BY rid),
b AS (SELECT rid, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS s
      FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN a USING (rid) LEFT JOIN b USING (rid)
"""
