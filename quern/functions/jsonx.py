"""JSON: parsing with repair, schema checks, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY_MAP = "map<string,array<string>>"


def is_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def quote_bare(text: Column) -> Column:
    """Rule repair: quotes around bare keys and values of an object."""
    keys = F.regexp_replace(text, r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'$1"$2"$3')
    return F.regexp_replace(keys, r"(:\s*)(?!true\b|false\b|null\b)([A-Za-z_]\w*)(\s*[,}])", r'$1"$2"$3')


def parse_or_repair(text: Column, repair=quote_bare, tries: int = 3, sentinel: str = "Failed to parse") -> Column:
    """struct(ok, value): the text or the first of its repairs that parses. `tries` texts are tried: the original counts as one."""
    now, found = text, None
    for _ in range(tries):
        own = F.when(is_json(now), now)
        found = own if found is None else F.coalesce(found, own)
        now = repair(now)
    return F.struct(found.isNotNull().alias("ok"), F.coalesce(found, F.lit(sentinel)).alias("value"))


def typed_verdict(text: Column, fields: dict[str, str], strict: bool = False) -> Column:
    """The fields of an object by DDL type; null if a field is missing, and in strict mode if there are others."""
    value = F.from_json(text, ", ".join(f"{k} {t}" for k, t in fields.items()))
    ok = is_json(text)
    for k in fields:
        ok = ok & value[k].isNotNull()
    if strict:
        ok = ok & (F.size(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, fields)))) == 0)
    return F.when(ok, value)


def contains_any(entities: Column, kind: str, names: list[str]) -> Column:
    """Whether the list of `kind` shares a name with `names`; without the kind, or for null, false."""
    return F.coalesce(F.arrays_overlap(F.filter(entities[kind], lambda x: x.isNotNull()), F.array(*map(F.lit, names))), F.lit(False))


def validated(rows: DataFrame) -> DataFrame:
    """rows (kind, entities as JSON) with status, used (the first two entities as kind:name) and warned, if there are more than two."""
    pairs = F.flatten(F.transform(F.map_entries(F.from_json("entities", ENTITY_MAP)), lambda e: F.transform(e.value, lambda v: F.concat_ws(":", e.key, v))))
    status = F.when(F.size("pairs") == 0, "no entities").when((F.col("kind") == "Connections") & (F.size("pairs") == 1), "connections need two entities").otherwise("ok")
    return rows.withColumn("pairs", pairs).select("*", status.alias("status"), F.array_join(F.slice("pairs", 1, 2), ",").alias("used"), (F.size("pairs") > 2).alias("warned"))
