"""Graph queries write what they match, not the graph, and match alike however many ids a hop has."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.plans import graph
from quern.queries import QUERIES, SQL, graphs

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
KEYS = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "orders": ["o_orderkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"]}


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """The tables three times, with keys far apart."""
    path = tmp_path_factory.mktemp("grown")
    for t, keys in KEYS.items():
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        df.crossJoin(spark.range(3).withColumnRenamed("id", "copy")).select(*((F.col(c) + F.col("copy") * 10**7 if c in keys else F.col(c)).alias(c) for c in df.columns)).coalesce(2).write.parquet(f"{path}/{t}.parquet")
    return str(path)


def _run(name, spark, path, monkeypatch):
    written = []

    def stored(df, what, _stored=graph.stored):
        out = _stored(df, what)
        written.append(out.count())
        return out

    with monkeypatch.context() as m:
        for module in (graph, graphs):
            m.setattr(module, "stored", stored)
        df = QUERIES[name](spark, path)
        return sorted(map(tuple, df.select(*sorted(df.columns)).collect())), written


def test_written_rows_do_not_grow_with_the_tables(spark, grown, monkeypatch):
    rows, written = _run("oc_label_hop", spark, DATA, monkeypatch)
    more, again = _run("oc_label_hop", spark, grown, monkeypatch)
    assert rows and rows == more and written == again
    assert sum(written) < spark.read.parquet(f"{DATA}/lineitem.parquet").count() / 10


@pytest.mark.parametrize("name", ["kg_inquiry", "kg_connections"])
def test_many_ids_of_rows_that_repeat(name, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graphs, "PUSHED", 3)
    monkeypatch.setattr(graphs, "BROADCAST", 8)
    con = duckdb.connect()
    for t in KEYS:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        (df.union(df.where("l_orderkey % 3 = 0").withColumn("l_returnflag", F.lit("Z"))) if t == "lineitem" else df).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rows, _ = _run(name, spark, str(tmp_path), monkeypatch)
    result = con.sql(SQL[name])
    at = [result.columns.index(c) for c in sorted(result.columns)]
    assert rows == sorted(tuple(r[i] for i in at) for r in result.fetchall()) and rows
