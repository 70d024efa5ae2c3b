"""What the operators share: reading tables, scratch tables on the shared folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An operator handles at most about this many bytes of text at once, or one row if that is longer.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may go without, as tests do."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_open: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder. It goes when the `scratch` around it ends, or with `keep` or outside when the driver's JVM does."""
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    where, fs = _hadoop(spark, path)
    fs.deleteOnExit(where)
    if _open and not keep:
        _open[-1].append(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def scratch(spark: SparkSession):
    """Scratch tables made inside are deleted at its end, so what it returns must be staged with `keep`."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            where, fs = _hadoop(spark, path)
            fs.delete(where, True)


def staged(df: DataFrame, name: str, path: str | None = None, keep: bool = False) -> DataFrame:
    """df written to the shared folder, or to a path of the caller's, and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name, keep)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reserved(name: str, df: DataFrame) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that `column` holds about `limit` bytes in each."""
    for batch in batches:
        start, size = 0, 0
        for i, text in enumerate(batch.column(column)):
            own = len(text.as_buffer()) if text.is_valid else 0
            if i > start and size + own > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += own
        if batch.num_rows > start:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A column's strings, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def map_batches(df: DataFrame, schema: str, column: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], limit: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow over size-bounded batches; `make` runs once a task and returns the function of a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    if not isinstance(kind, StructType):
        raise ValueError("a row schema is needed")
    arrow = to_arrow_schema(kind)

    def run(batches):
        step = make()
        for batch in pieces(batches, column, limit):
            out = step(batch)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
