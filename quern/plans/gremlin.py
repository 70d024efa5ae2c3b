"""A small set of traversal steps, parsed and compiled to DataFrame operations; text is never evaluated.

g.V(), g.E(), hasLabel('x'), has('key','value'), out('t'), in('t'), values('key'), dedup(), limit(n),
count(), groupCount().by('key'), valueMap(true). Values from outside are bound by name, as in
has('name', who), so that no quote or bracket in them is read as a step.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph

_ARG = r"'[^']*'|\"[^\"]*\"|\w+"
_STEP = re.compile(rf"\.\s*(\w+)\(\s*((?:{_ARG})(?:\s*,\s*(?:{_ARG}))*)?\s*\)")


def steps(text: str, bindings: Mapping[str, str] = {}) -> list[tuple[str, list[str]]]:
    text = text.strip()
    if not text.startswith("g") or _STEP.sub("", text[1:]).strip():
        raise ValueError(f"not a traversal of known form: {text!r}")
    value = lambda a: a[1:-1] if a[0] in "'\"" else bindings.get(a, a)
    return [(m[1], [value(a) for a in re.findall(_ARG, m[2] or "")]) for m in _STEP.finditer(text)]


def run(graph: Graph, text: str, bindings: Mapping[str, str] = {}) -> DataFrame:
    """Results of a traversal; vertices need a `props` map for has, values and groupCount."""
    todo, df, kind = steps(text, bindings), None, None
    i = 0
    while i < len(todo):
        name, args = todo[i]
        i += 1
        if name in ("V", "E"):
            df, kind = (graph.vertices, "v") if name == "V" else (graph.edges, "e")
        elif name == "hasLabel":
            df = df.where(F.array_contains("labels", args[0]) if kind == "v" else F.col("type") == args[0])
        elif name == "has":
            df = df.where(F.col("props")[args[0]] == args[1])
        elif name in ("out", "in"):
            near, far = ("src", "dst") if name == "out" else ("dst", "src")
            e = graph.edges.where(F.col("type") == args[0]) if args else graph.edges
            ids = df.select(F.col("id").alias(near)).join(e.select(near, far), near).select(F.col(far).alias("id"))
            df = ids.join(graph.vertices, "id")
        elif name == "values":
            df = df.select(F.col("props")[args[0]].alias("value"))
        elif name == "dedup":
            df = df.distinct()
        elif name == "limit":
            df = df.orderBy(df.columns[0]).limit(int(args[0]))
        elif name == "count":
            df = df.agg(F.count("*").alias("count"))
        elif name == "groupCount":
            by = todo[i][1][0] if i < len(todo) and todo[i][0] == "by" else None
            i += by is not None
            df = df.groupBy((F.col("props")[by] if by else F.col("value")).alias("key")).agg(F.count("*").alias("count"))
        elif name == "valueMap":
            label = F.array_join("labels", "::") if kind == "v" else F.col("type")
            df = df.select(F.col("id" if kind == "v" else "edge_id").alias("id"), label.alias("label"), F.to_json(F.transform_values("props", lambda _, v: F.array(v))).alias("properties"))
        else:
            raise ValueError(f"unknown step {name!r}")
    return df


#: Questions in words and the traversal that a rule model gives for each; a, b are the question's values.
QUESTIONS = (
    (r"how many (?P<a>\w+) does (?P<b>.+?) have", "g.V().has('name', b).out(a).count()"),
    (r"list the distinct (?P<a>\w+) of (?P<b>\w+)", "g.V().hasLabel(b).values(a).dedup()"),
    (r"count (?P<a>\w+) by (?P<b>\w+)", "g.V().hasLabel(a).groupCount().by(b)"),
    (r"who does (?P<a>.+?) (?P<b>\w+)\W*$", "g.V().has('name', a).out(b).values('name')"),
)


def traversal_of(question: str) -> tuple[str, dict[str, str]] | None:
    """The traversal for a question with its values, or None if no rule takes it."""
    for pattern, text in QUESTIONS:
        if m := re.search(pattern, question, re.I):
            return text, m.groupdict()
    return None


def answer(graph: Graph, question: str) -> DataFrame | None:
    """The question's result; None where it, or its traversal, isn't understood."""
    try:
        return run(graph, *found) if (found := traversal_of(question)) else None
    except ValueError:
        return None
