"""Token counts leave Python as numbers: no array of tokens is built for them."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.queries import QUERIES


def test_counts_without_tokens(spark, tmp_path):
    pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    texts = ["hello world", "", None, "it's  naïve\n", "word " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    both = docs.select("doc_id", T.bpe_count(F.col("text"), path).alias("n"), T.bpe_tokens(F.col("text"), path).alias("t")).collect()
    assert [(r.doc_id, r.n) for r in both] == [(r.doc_id, None if r.t is None else len(r.t)) for r in both]
    assert [r.n for r in both][:3] == [2, 0, None] and both[4].n >= 5000
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["token_count_bpe"](spark, str(tmp_path))
    assert {r.doc_id: r.n_tokens for r in df.collect()} == {r.doc_id: r.n for r in both}
    assert "size(" not in df._jdf.queryExecution().optimizedPlan().toString()
