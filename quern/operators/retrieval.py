"""Retrieval: exact top-k by vectors, filters before the top, rank fusion, prompts with facts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..functions.models import TextModel

#: Query vectors that one pass scores against a corpus, and rows of it scored at once.
QUERY_ROWS = 1000
SLICE = 4096


def top_k(corpus: DataFrame, score: Column, key: str, k: int) -> DataFrame:
    """The k rows with the largest score, ties by key: a bounded heap a task, no sort of the corpus."""
    return corpus.withColumn("score", score).orderBy(F.desc_nulls_last("score"), key).limit(k)


def top_k_each(queries: DataFrame, corpus: DataFrame, query_id: str, query_vec: str, key: str, vec: str, k: int) -> DataFrame:
    """For each query its k best rows of the corpus by cosine, with rank, ties by key.

    The queries go in blocks of about QUERY_ROWS by hash of their ids. A block comes to the driver and
    is broadcast, so the corpus is scored where it lies; k rows a query and slice of rows are shuffled.
    """
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    rows = queries.select(F.col(query_id), F.col(query_vec).cast("array<double>"), F.pmod(F.xxhash64(query_id), F.lit(blocks)).alias("_block"))
    found = None
    for n in range(blocks):
        part = _nearest(rows.where(F.col("_block") == n), corpus, query_id, query_vec, key, vec, k)
        found = part if found is None else found.unionByName(part)
    return ranked(found, [F.desc_nulls_last("score"), F.col(key)], by=[query_id]).where(F.col("rank") <= k).select(query_id, key, "score", "rank")


def _units(vectors: list, dim: int) -> np.ndarray:
    """Vectors as rows of length 1; 0 for null ones, those of another dimension, with nulls, or without length."""
    zero = [0.0] * dim
    m = np.array([v if v is not None and len(v) == dim and None not in v else zero for v in vectors], np.float64).reshape(len(vectors), dim)
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(size == 0, 1, size)


def _nearest(block: DataFrame, corpus: DataFrame, query_id: str, query_vec: str, key: str, vec: str, k: int) -> DataFrame:
    """The block's best k rows of each slice of the corpus: query_id, key, score."""
    kinds, q_type = dict(block.dtypes) | dict(corpus.dtypes), to_arrow_type(block.schema[query_id].dataType)
    got = block.select(query_id, query_vec).collect()
    by_dim: dict[int, list] = {}
    for qid, v in got:
        by_dim.setdefault(len(v or ()), []).append((qid, v))
    shared = block.sparkSession.sparkContext.broadcast([([q for q, _ in rows], _units([v for _, v in rows], dim).T, dim) for dim, rows in by_dim.items()])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                b = b.take(pc.sort_indices(b.column(0), null_placement="at_start"))
                vectors = b.column(1).to_pylist()
                for ids, m, dim in shared.value:
                    scores = np.round(_units(vectors, dim) @ m, 6)
                    for _ in range(min(k, b.num_rows)):
                        top = scores.argmax(0)  # the first of equals has the smallest key
                        yield pa.RecordBatch.from_arrays([pa.array(ids, q_type), b.column(0).take(pa.array(top)), pa.array(scores[top, np.arange(len(ids))] + 0.0)], [query_id, key, "score"])
                        scores[top, np.arange(len(ids))] = -np.inf

    return corpus.select(key, F.col(vec).cast("array<double>")).mapInArrow(run, f"`{query_id}` {kinds[query_id]}, `{key}` {kinds[key]}, score double")


def fused(ranks: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of frames (key, rank)."""
    rows = ranks[0].select(key, "rank")
    for r in ranks[1:]:
        rows = rows.unionByName(r.select(key, "rank"))
    return rows.groupBy(key).agg(F.round(F.sum(F.lit(1.0) / (F.col("rank") + k)), 6).alias("rrf"))


def stuffed(rows: DataFrame, by: list[str], order: str, text: Column, sep: str = "\n") -> DataFrame:
    """One text for each group, its parts in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x.t), sep).alias("context"))


def ranked(df: DataFrame, order: list[Column], name: str = "rank", by: list[str] | None = None) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def keyword_score(text: Column, query: str) -> Column:
    """How many of a text's words are words of the query; 0 for null."""
    asked = sorted(set(query.lower().split()))
    return F.coalesce(F.size(F.filter(T.words(F.lower(text)), lambda w: w.isin(*asked))), F.lit(0)) if asked else F.lit(0)


def answered(rows: DataFrame, by: str, order: str, key: str, text: str, shown: Column, prompt: Callable[[Column], Column], model: TextModel, sep: str = " ") -> DataFrame:
    """(by, prompt, answer, sources) for each group of retrieved rows: sources are the rows as (id, text), in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).alias("id"), F.col(text).alias("text"), shown.alias("shown"))))
    found = rows.groupBy(by).agg(parts.alias("parts"))
    found = found.select(by, prompt(F.array_join(F.transform("parts", lambda p: p.shown), sep)).alias("prompt"), F.transform("parts", lambda p: F.struct(p.id.alias("id"), p.text.alias("text"))).alias("sources"))
    return found.withColumn("answer", model(F.col("prompt")))


def checked_dimension(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """df, in which a vector of another dimension, or null, is an error when it is read."""
    wrong = F.raise_error(F.concat(F.lit(f"a vector without {dim} entries: "), F.coalesce(F.size(vec), F.lit(-1)).cast("string")))
    return df.withColumn(vec, F.when(F.size(vec) == dim, F.col(vec)).otherwise(wrong))
