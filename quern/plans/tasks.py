"""Agents and tasks as two small tables; a run takes the tasks in their order, each with what those before it gave."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import TextModel
from ..operators.template import compiled


def plan(spark: SparkSession, agents: list[dict], tasks: list[dict], inputs: dict[str, str]) -> DataFrame:
    """(ord, role, goal, prompt): each task's text with the inputs put in, and its agent's goal. Extra inputs are allowed, missing ones an error."""
    a = spark.createDataFrame([(x["role"], x["goal"]) for x in agents], "role string, goal string")
    t = spark.createDataFrame([(i, x["agent"], x["description"], x["expected_output"]) for i, x in enumerate(tasks)], "ord int, agent string, description string, expected_output string")
    for x in tasks:
        for name in re.findall(r"\{(\w+)\}", x["description"]):
            if name not in inputs:
                raise KeyError(f"the task needs {name!r}")
    text = None
    for i, x in enumerate(tasks):
        text = (F if text is None else text).when(F.col("ord") == i, compiled(x["description"], inputs))
    rows = t.join(F.broadcast(a), t["agent"] == a["role"])
    return rows.select("ord", "role", "goal", F.concat_ws("\n", text, F.concat(F.lit("Expected: "), "expected_output")).alias("prompt"))


def crew(inputs: DataFrame, agents: list[dict], tasks: list[dict], values: dict[str, Column | str], model: TextModel, manager: TextModel | None = None) -> DataFrame:
    """The rows of inputs with `outputs`: an array of (ord, role, prompt, output), a task each.

    Every row is a run. A task's prompt has its agent's role, goal and backstory, its own text with the
    values put in, and the outputs handed over by all tasks before it; a manager model reviews each
    output before it goes on. All is one projection, so runs are as parallel as rows.
    """
    by_role = {a["role"]: a for a in agents}
    made, outputs = inputs, []
    for i, t in enumerate(tasks):
        a = by_role[t["agent"]]
        head = f"{a['role']}: {a['goal']}" + (f" {a['backstory']}" if a.get("backstory") else "")
        own = [F.lit(head), compiled(t["description"], values), F.concat(F.lit("Expected: "), compiled(t["expected_output"], values))]
        handed = [F.concat(F.lit(f"{role} said: "), F.col(c)) for role, c in outputs]
        name = f"_output_{i}"
        made = made.withColumn(f"_prompt_{i}", F.concat_ws("\n", *own, *handed))
        made = made.withColumn(name, model(F.col(f"_prompt_{i}")))
        made = made.withColumn(name, manager(F.col(name))) if manager else made
        outputs.append((a["role"], name))
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(role).alias("role"), F.col(f"_prompt_{i}").alias("prompt"), F.col(c).alias("output")) for i, (role, c) in enumerate(outputs)))
    return made.select(*(F.col(f"`{c}`") for c in inputs.columns), rows.alias("outputs"))
