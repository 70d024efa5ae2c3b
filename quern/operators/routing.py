"""Routing of records to destinations by name, with a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Destinations are a table by hand; more than this is no registry.
REGISTRY_ROWS = 10_000


def routed(df: DataFrame, name: Column, registry: DataFrame, default: str) -> DataFrame:
    """df with `destination` and `prompt_template` of the registry row of that name, or the default's name."""
    if registry.limit(REGISTRY_ROWS + 1).count() > REGISTRY_ROWS:
        raise ValueError("the registry is too large to broadcast")
    small = registry.select(F.col("name").alias("_dest"), F.col("prompt_template"))
    out = df.withColumn("_name", name).join(F.broadcast(small), F.col("_name") == F.col("_dest"), "left")
    return out.withColumn("destination", F.coalesce("_dest", F.lit(default))).drop("_name", "_dest")


def listing(registry: DataFrame) -> DataFrame:
    """One line a destination, `name: description`, in order of name."""
    lines = F.sort_array(F.collect_list(F.struct("name", F.concat_ws(": ", "name", "description").alias("line"))))
    return registry.agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("destinations"))
