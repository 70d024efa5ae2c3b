"""Files: CSV, JSON lines, whole texts, positional rows, graph tables; metadata documents as a sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import stored


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Free text may hold quotes and line ends."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, text) of whole files; glob restricts names."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def with_line_index(df: DataFrame, name: str = "line_index") -> DataFrame:
    """df with the 0-based place of each row, without a sort or a single task: of rows as files hold them in the
    order of the files' paths and of lines in each, else in the order of its partitions.

    Spark deals the files to partitions by size, so partitions do not tell the files' order. Rows are
    written with their places in their partitions and read again, so the two agree however often a
    task runs; a number a stretch of a file, or a partition, is joined to them.
    """
    part, place, path, block, start = (_free(x, df) for x in ("part", "place", "path", "block", "start"))
    at = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start")) if _as_in_files(df) else (F.lit(""), F.lit(0).cast("long"))
    placed = stored(df.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(place), at[0].alias(path), at[1].alias(block)), "lines")
    stretch = [path, block, part]
    before = Window.orderBy(*stretch).rowsBetween(Window.unboundedPreceding, -1)  # over a row a stretch
    starts = placed.groupBy(*stretch).agg(F.count("*").alias("n"), F.min(place).alias("first")).select(*stretch, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias(start))
    return placed.join(F.broadcast(starts), stretch).withColumn(name, F.col(start) + F.col(place)).select(*(F.col(f"`{c}`") for c in df.columns), name)


def _as_in_files(df: DataFrame) -> bool:
    """Whether the rows of df come from one scan of files, with nothing but projections and filters behind it."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in (c.lower() for c in df.columns) and plan.metadataOutput().nonEmpty()


def _free(name: str, df: DataFrame) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def metadata_docs(df: DataFrame, text: str, attributes: list[str], order: str, limit: int) -> DataFrame:
    """A row per document: 1-based name, text, and its attributes as the JSON of a sidecar file; missing values are nan."""
    said = F.struct(*(F.coalesce(F.col(a).cast("string"), F.lit("nan")).alias(a) for a in attributes))
    first = df.orderBy(order).limit(limit)
    index = F.row_number().over(Window.orderBy(order))  # of at most `limit` rows
    return first.select(F.format_string("doc_%d.txt", index).alias("name"), F.col(text).alias("text"), F.to_json(F.struct(said.alias("metadataAttributes"))).alias("sidecar"))


def write_docs(df: DataFrame, path: str) -> None:
    """Documents as rows of a table: never a file for each."""
    df.write.mode("overwrite").parquet(path)


def load_graph_csv(spark: SparkSession, vertices: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Vertex and edge tables from CSV in the bulk-load header form (~id, ~label; ~id, ~from, ~to, ~label)."""

    def others(df: DataFrame, known: tuple[str, ...]) -> Column:
        rest = [c for c in df.columns if c not in known]
        return F.map_from_arrays(F.array(*map(F.lit, rest)).cast("array<string>"), F.array(*(F.col(f"`{c}`") for c in rest)).cast("array<string>"))

    v, e = (spark.read.csv(p, header=True) for p in (vertices, edges))
    v = v.select(F.col("`~id`").alias("id"), F.split("`~label`", ";").alias("labels"), others(v, ("~id", "~label")).alias("props"))
    e = e.select(F.col("`~id`").alias("edge_id"), F.col("`~from`").alias("src"), F.col("`~to`").alias("dst"), F.col("`~label`").alias("type"), others(e, ("~id", "~from", "~to", "~label")).alias("props"))
    return v, e
