"""Record chains as column expressions: passthrough, assign, parallel maps, pipes, branches, alternatives."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def passthrough(df: DataFrame) -> DataFrame:
    return df


def assign(**columns: Column) -> Step:
    """Keeps the input and adds columns."""
    return lambda df: df.withColumns(columns)


def parallel(**branches: Column) -> Step:
    """The same input to every branch, in one projection."""
    return lambda df: df.select(*(c.alias(k) for k, c in branches.items()))


def pipe(*steps: Step) -> Step:
    return lambda df: reduce(DataFrame.transform, steps, df)


def sequential(outputs: list[str], **steps: Callable[[], Column]) -> Step:
    """Named steps that may read all before them; only declared outputs stay."""

    def run(df: DataFrame) -> DataFrame:
        for name, make in steps.items():
            df = df.withColumn(name, make())
        return df.select(*outputs)

    return run


def branch(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first case that holds."""
    out = F
    for test, value in cases:
        out = out.when(test, value)
    return out.otherwise(default) if cases else default


@dataclass(frozen=True)
class Configurable:
    """A field with named alternatives, resolved on the driver; with_config gives a changed copy."""

    alternatives: dict[str, Callable[[Column], Column]]
    default: str
    config: dict[str, str] = field(default_factory=dict)
    name: str = "model"

    def with_config(self, **config: str) -> Configurable:
        return replace(self, config=self.config | config)

    def __call__(self, c: Column) -> Column:
        key = self.config.get(self.name, self.default)
        if key not in self.alternatives:
            raise KeyError(f"{self.name} has no alternative {key!r}")
        return self.alternatives[key](c)


def lifted(f: Callable, returns: str) -> Callable[..., Column]:
    """A Python function of values as a step on columns, by Arrow batches; where built-in functions do, use those."""
    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*values) for values in zip(*columns, strict=True)], dtype=object)

    return run


def configured(f: Callable[..., Step], **config) -> Step:
    """A step made by a function that takes its configuration at run time."""
    return lambda df: f(df, config)


def logged(prompt: Column, path: str, step: str) -> Step:
    """Keeps the input, after its prompts were appended to the log at path as rows (step, prompt)."""

    def run(df: DataFrame) -> DataFrame:
        df.select(F.lit(step).alias("step"), prompt.alias("prompt")).write.mode("append").parquet(path)
        return df

    return run
