"""Knowledge bases: a configuration, an ingestion job that writes chunks with vectors, and its status.

A base is a folder: `config` and `jobs` are small tables, `chunks/job=...` the index. A job writes its
chunks under its own number and is named COMPLETE only behind them, so readers see whole jobs alone.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.models import Embedder

COMPLETE, FAILED, STARTED = "COMPLETE", "FAILED", "STARTED"
_JOBS = "job string, status string, reason string, documents long, chunks long, seq int"


@dataclass(frozen=True)
class Config:
    """What a base is made of; fields name the columns of its index."""

    name: str
    description: str = ""
    dimension: int = 16
    max_tokens: int = 512
    overlap: float = 0.2
    vector_field: str = "vector"
    text_field: str = "text"
    metadata_field: str = "text_metadata"


@dataclass(frozen=True)
class KnowledgeBase:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: Config) -> KnowledgeBase:
        """A new base at path; an error if there is one."""
        spark.createDataFrame([(json.dumps(asdict(config)),)], "config string").write.parquet(f"{path}/config")
        return cls(spark, path)

    def config(self) -> Config:
        return Config(**json.loads(self.spark.read.parquet(f"{self.path}/config").first()[0]))

    def describe(self) -> DataFrame:
        """A row of the configuration, with how many jobs are complete and how many chunks those wrote."""
        c = asdict(self.config())
        row = self.spark.createDataFrame([tuple(c.values())], ", ".join(f"{k} {dict(int='int', float='double').get(type(v).__name__, 'string')}" for k, v in c.items()))
        done = self.jobs().where(F.col("status") == COMPLETE).agg(F.count("*").alias("jobs"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
        return row.crossJoin(done)  # a row each

    def jobs(self) -> DataFrame:
        """The last status of each job."""
        try:
            rows = self.spark.read.schema(_JOBS).parquet(f"{self.path}/jobs")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], _JOBS)
        last = F.max_by(F.struct("status", "reason", "documents", "chunks"), "seq").alias("s")
        return rows.groupBy("job").agg(last).select("job", "s.*")

    def _note(self, job: str, seq: int, status: str, reason: str | None = None, documents: int | None = None, chunks: int | None = None) -> None:
        self.spark.createDataFrame([(job, status, reason, documents, chunks, seq)], _JOBS).coalesce(1).write.mode("append").parquet(f"{self.path}/jobs")

    def ingest(self, docs: DataFrame, embedder: Embedder, id_col: str, text_col: str, metadata: list[str]) -> str:
        """Chunks, embeds and writes docs in one pass; the job's number. Vectors of another dimension fail the job, as does any error."""
        c, job = self.config(), uuid.uuid4().hex
        self._note(job, 0, STARTED)
        try:
            index(docs, embedder, c, id_col, text_col, metadata).write.parquet(f"{self.path}/chunks/job={job}")
            written = self.spark.read.parquet(f"{self.path}/chunks/job={job}").agg(F.count("*"), F.count(F.when(F.col("chunk_no") == 0, 1))).first()
            self._note(job, 1, COMPLETE, None, written[1], written[0])
        except Exception as e:
            self._note(job, 1, FAILED, str(e)[:500])
            raise
        return job

    def wait(self, job: str, timeout: float = 60.0, every: float = 1.0) -> str:
        """The status of a job as soon as it is COMPLETE or FAILED; TimeoutError beyond the timeout."""
        end = time.monotonic() + timeout
        while True:
            row = self.jobs().where(F.col("job") == job).select("status").first()
            if row and row[0] in (COMPLETE, FAILED):
                return row[0]
            if time.monotonic() > end:
                raise TimeoutError(f"job {job} is {row[0] if row else 'unknown'}")
            time.sleep(every)

    def chunks(self) -> DataFrame:
        """The index: what complete jobs have written."""
        done = self.jobs().where(F.col("status") == COMPLETE).select("job")
        return self.spark.read.parquet(f"{self.path}/chunks").join(F.broadcast(done), "job", "left_semi")  # a row a job


def index(docs: DataFrame, embedder: Embedder, c: Config, id_col: str, text_col: str, metadata: list[str]) -> DataFrame:
    """(id, chunk_no, text, vector, metadata as JSON), a row a chunk; texts without words have none."""
    said = F.to_json(F.struct(*(F.col(m).cast("string").alias(m) for m in metadata)), {"ignoreNullFields": "false"})
    rows = docs.select(F.col(id_col).alias("id"), said.alias(c.metadata_field), F.posexplode(T.fixed_chunks(F.col(text_col), c.max_tokens, c.overlap)).alias("chunk_no", c.text_field))
    vector = embedder(F.col(c.text_field))
    fits = F.when(F.size("_v") == c.dimension, F.col("_v")).otherwise(F.raise_error(F.concat(F.lit(f"a vector without {c.dimension} entries: "), F.size("_v").cast("string"))))
    return rows.withColumn("_v", vector).withColumn(c.vector_field, fits).drop("_v")


def remember(spark: SparkSession, path: str, name: str, value: str) -> None:
    """Stores a variable for later sessions, in place of its earlier value."""
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def recall(spark: SparkSession, path: str, name: str) -> str:
    return spark.read.schema("value string").parquet(f"{path}/{name}").first()[0]
