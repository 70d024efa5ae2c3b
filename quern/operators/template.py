"""Prompt templates compiled to columns. Substituted text is never scanned again."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def compiled(template: str, values: Mapping[str, Column | str]) -> Column:
    """concat of literals and values; {{ and }} stand for braces, unused values are allowed, missing ones are an error."""
    parts, at, literal = [], 0, ""
    for m in _PART.finditer(template):
        literal += template[at : m.start()]
        at = m.end()
        if m[1] is None:
            literal += m[0][0]
            continue
        if m[1] not in values:
            raise KeyError(f"the template needs {m[1]!r}")
        value = values[m[1]]
        parts += [F.lit(literal), F.coalesce(value.cast("string"), F.lit("")) if isinstance(value, Column) else F.lit(value)]
        literal = ""
    return F.concat(*parts, F.lit(literal + template[at:]))


def messages(roles: list[tuple[str, str]], values: Mapping[str, Column | str]) -> Column:
    """array of struct(role, content)."""
    return F.array(*(F.struct(F.lit(role).alias("role"), compiled(t, values).alias("content")) for role, t in roles))


def with_results(template: str, context: Column) -> Column:
    """The template with $search_results$ replaced."""
    return F.replace(F.lit(template), F.lit("$search_results$"), F.coalesce(context, F.lit("")))
