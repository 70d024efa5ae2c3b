"""Places of rows over several files, which Spark deals to partitions by size."""

import pytest
from pyspark.sql import functions as F

from quern.queries import QUERIES
from quern.sources.files import with_line_index

FILES = [("part-0000", range(0, 5)), ("part-0001", range(5, 400)), ("part-0002", range(400, 410)), ("part-0003", range(410, 3000))]


@pytest.fixture
def pages(spark, tmp_path):
    for name, ids in FILES:
        one = spark.range(ids.start, ids.stop, 1, 1).select(F.col("id").alias("page_id"), F.format_string("u%d", "id").alias("url"), F.repeat(F.lit("x"), 50).alias("html"))
        one.toPandas().to_parquet(_dir(tmp_path / "pages.parquet") / f"{name}.parquet")
        one.toPandas().to_json(_dir(tmp_path / "pages.json") / f"{name}.json", orient="records", lines=True)
    spark.createDataFrame([(i, "t") for i in (0, 4, 5, 399, 400, 409, 410, 2999, 3000)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    return tmp_path


def _dir(path):
    path.mkdir(exist_ok=True)
    return path


def test_lookup_over_files(spark, pages):
    got = QUERIES["positional_lookup"](spark, str(pages)).collect()
    assert sorted((r.item_id, r.page_id, r.url) for r in got) == [(i, i, f"u{i}") for i in (0, 4, 5, 399, 400, 409, 410, 2999)]


def test_files_cut_and_packed(spark, pages):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("1000b", "64m"):
            for k in before:
                spark.conf.set(k, size if k.endswith("PartitionBytes") else "0b")
            for df in (spark.read.parquet(str(pages / "pages.parquet")), spark.read.json(str(pages / "pages.json"))):
                assert all(r.line_index == r.page_id for r in with_line_index(df.select("page_id")).collect())
                few = with_line_index(df.where("page_id % 7 = 0").select("page_id", F.lit(1).alias("part"), F.lit(2).alias("path"), F.lit(3).alias("start"))).collect()
                assert sorted(r.line_index for r in few) == list(range(429)) and all(r.line_index * 7 == r.page_id for r in few)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sorted_rows_keep_their_order(spark, pages):
    rows = with_line_index(spark.read.parquet(str(pages / "pages.parquet")).select("page_id").orderBy(F.desc("page_id"))).collect()
    assert all(r.line_index + r.page_id == 2999 for r in rows) and len(rows) == 3000
