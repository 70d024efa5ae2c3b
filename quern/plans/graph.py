"""Property graphs as vertex and edge tables, and patterns compiled to joins.

A pattern such as `(a)<-[r]-(e:EVENT)-[s:PART]->(b), (e)<-[x]-(d:DOCUMENT)` becomes one inner join
with the edges a hop, started from the vertices bound beforehand, so a match grows from its anchor.
Edges of one match are distinct. Labels become semi-joins; names are looked up after DISTINCT, all
in one join. A stored graph has its edges twice, in order of either end: the ids of an anchor reach
the scan as a filter, and the files' statistics leave out what lies elsewhere. A graph may also leave
its edges in the tables they come from, and give a hop those of its bound vertices alone (edges_at).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Bound vertices that a hop hands to the scan of edges as a filter at most; more meet the edges in a join alone.
PUSHED = 1000

_NODE = re.compile(r"\(\s*(\w*)\s*(?::(\w+))?\s*\)")
_EDGE = re.compile(r"(<?)-\[\s*(\w*)\s*(?::(\w+))?\s*\]-(>?)")


@dataclass(frozen=True)
class Hop:
    src: str
    edge: str
    dst: str
    kind: str | None


def parse(pattern: str) -> tuple[list[Hop], dict[str, str]]:
    """Hops with unnamed parts numbered, and labels by node variable."""
    hops, labels, at, n = [], {}, 0, 0

    def node() -> str:
        nonlocal at, n
        m = _NODE.match(pattern, at)
        if not m:
            raise ValueError(f"a node is expected at {pattern[at:]!r}")
        at, n = m.end(), n + 1
        name = m[1] or f"_n{n}"
        if m[2]:
            labels[name] = m[2]
        return name

    pattern = re.sub(r"\s+", "", pattern)
    left = node()
    while at < len(pattern):
        if pattern[at] == ",":
            at += 1
            left = node()
            continue
        m = _EDGE.match(pattern, at)
        if not m or bool(m[1]) == bool(m[4]):
            raise ValueError(f"a directed edge is expected at {pattern[at:]!r}")
        at, n = m.end(), n + 1
        name, right = m[2] or f"_e{n}", node()
        hops.append(Hop(right, name, left, m[3]) if m[1] else Hop(left, name, right, m[3]))
        left = right
    return hops, labels


@dataclass(frozen=True)
class Graph:
    """vertices(id, labels, names, primary_name), edges(edge_id, src, dst, type); by_dst holds the edges in another order."""

    vertices: DataFrame
    edges: DataFrame
    by_dst: DataFrame | None = None

    @classmethod
    def kept(cls, vertices: DataFrame, edges: DataFrame) -> Graph:
        """The graph written once, for many queries: vertices by id, edges by either end."""
        edges = stored(edges.repartitionByRange("src").sortWithinPartitions("src"), "edges")
        by_dst = stored(edges.repartitionByRange("dst").sortWithinPartitions("dst"), "edges")
        return cls(stored(vertices.repartitionByRange("id").sortWithinPartitions("id"), "vertices"), edges, by_dst)

    def labelled(self, label: str) -> DataFrame:
        return self.vertices.where(F.array_contains("labels", label))

    def named(self, text: str, label: str) -> DataFrame:
        """Ids of the vertices with that name and label; values are bound as literals, never spliced."""
        return self.labelled(label).where(F.array_contains("names", text)).select("id")

    def edges_at(self, frame: DataFrame, hop: Hop, pushed: dict[str, list]) -> tuple[DataFrame, DataFrame]:
        """The frame, and the edges among which the hop's are: here all, in the order of the bound end, with `pushed` ids as a filter."""
        e = self.by_dst if self.by_dst is not None and hop.src not in frame.columns else self.edges
        for v, c in ((hop.src, "src"), (hop.dst, "dst")):
            e = e.where(F.col(c).isin(pushed[v])) if v in pushed else e
        return frame, e

    def vertices_at(self, frame: DataFrame, *nodes: str) -> tuple[DataFrame, DataFrame]:
        """The frame, and the vertices among which those of its columns `nodes` are: here all."""
        return frame, self.vertices

    def match(self, pattern: str, frame: DataFrame, optional: bool = False, where: Column | None = None) -> DataFrame:
        """frame, which binds at least one variable, joined along the pattern.

        Each hop adds its edge id and `<edge>_type`; a node variable is a column of ids. With
        `optional`, rows without a match stay, and `where` belongs to the match.
        """
        return self._match(pattern, frame, optional, where, {})

    def anchored(self, variable: str, pattern: str, ids: DataFrame, where: Column | None = None) -> DataFrame:
        """match() from `ids` (id) bound to a variable; PUSHED of them or fewer also filter the scan of the first hop."""
        got = [r[0] for r in ids.limit(PUSHED + 1).collect()]
        return self._match(pattern, ids.select(F.col("id").alias(variable)), False, where, {variable: got} if len(got) <= PUSHED else {})

    def _match(self, pattern: str, frame: DataFrame, optional: bool, where: Column | None, pushed: dict[str, list]) -> DataFrame:
        if optional:
            bound = [c for c in frame.columns if c in {v for h in parse(pattern)[0] for v in (h.src, h.dst)}]
            own = self.match(pattern, frame.select(*bound).distinct())
            own = own.where(where) if where is not None else own
            renamed = own.select(*(F.col(c).alias(f"_{c}") if c in bound else F.col(c) for c in own.columns))
            on = [frame[c].eqNullSafe(renamed[f"_{c}"]) for c in bound]
            return frame.join(renamed, on, "left").drop(*(f"_{c}" for c in bound))
        hops, labels = parse(pattern)
        todo, used, checked = list(hops), [], set()
        while todo:
            hop = next((h for h in todo if h.src in frame.columns or h.dst in frame.columns), None)
            if hop is None:
                raise ValueError("bind a variable of each part of the pattern")
            todo.remove(hop)
            known = set(frame.columns)
            frame, e = self.edges_at(frame, hop, pushed)
            e = e if hop.kind is None else e.where(F.col("type") == hop.kind)
            e = e.select(F.col("edge_id").alias(hop.edge), F.col("type").alias(f"{hop.edge}_type"), F.col("src").alias("_s"), F.col("dst").alias("_d"))
            on = [F.col(v) == F.col(c) for v, c in ((hop.src, "_s"), (hop.dst, "_d")) if v in known]
            on += [F.col(hop.edge) != F.col(x) for x in used]
            frame = frame.join(e, on).withColumnsRenamed({c: v for v, c in ((hop.src, "_s"), (hop.dst, "_d")) if v not in known}).drop("_s", "_d")
            used.append(hop.edge)
            for v in (hop.src, hop.dst):
                if v in labels and v not in checked:
                    checked.add(v)
                    frame, own = self.vertices_at(frame, v)
                    frame = frame.join(own.where(F.array_contains("labels", labels[v])).select(F.col("id").alias(v)), v, "left_semi")
        return frame.where(where) if where is not None else frame

    def with_names(self, frame: DataFrame, *nodes: str) -> DataFrame:
        """frame, of distinct rows, with `<node>_name` and `<node>_label` of each node; labels are put together
        as text. One join for all nodes, in which a node that is no vertex has nulls."""
        frame, own = self.vertices_at(frame, *nodes)
        rows = frame.select("*", F.posexplode(F.array(*nodes)).alias("_at", "_id"))
        own = own.select(F.col("id").alias("_id"), F.struct(F.col("primary_name").alias("name"), F.array_join("labels", "").alias("label")).alias("_v"))
        found = rows.join(own, "_id", "left").groupBy(*frame.columns).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_vs"))
        return found.select(*frame.columns, *(F.col("_vs")[i][c].alias(f"{v}_{c}") for i, v in enumerate(nodes) for c in ("name", "label")))


TWO_HOPS = "(entity1)<-[role1]-(event)-[role2]->(entity2)<-[role3]-(event2)-[role4]->(entity3)"


def two_hops(graph: Graph, entity: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Matches of TWO_HOPS from the entity (id) over two events, with `other` (id) only those that meet it as entity2 or entity3."""
    m = graph.anchored("entity1", TWO_HOPS, entity, (F.col("entity1") != F.col("entity3")) & (F.col("event") != F.col("event2")))
    if other is None:
        return m
    second, third = (other.select(F.col("id").alias(f"entity{i}"), F.lit(True).alias(f"_{i}")).distinct() for i in (2, 3))
    return m.join(second, "entity2", "left").join(third, "entity3", "left").where(F.coalesce("_2", "_3", F.lit(False))).drop("_2", "_3")


def facts(graph: Graph, entity: DataFrame, other: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(statements, doc): facts up to two events from the entity, in Connections form only those that meet `other`.

    The match is made once: each row of it gives its fact to either branch, and documents and names
    are looked up for both together. The limit holds for the second branch alone, in order of
    (statements, doc), and the branches end statements differently.
    """
    m = two_hops(graph, entity, other)
    part = lambda end, *c: F.struct(F.lit(end).alias("end"), *(F.col(x).alias(n) for x, n in zip(c, ("event", "a", "r", "b", "s"), strict=True)))
    both = F.array(part(". ", "event", "entity1", "role1_type", "entity2", "role2_type"), part(".", "event2", "entity2", "role3_type", "entity3", "role4_type"))
    rows = m.select(F.explode(both).alias("f")).select("f.*").distinct()
    rows = graph.match("(event)<-[_r]-(doc:DOCUMENT)", rows).select("end", "event", "a", "r", "b", "s", "doc").distinct()
    rows = graph.with_names(rows, "event", "a", "b", "doc")
    text = F.concat(F.lit("Event Type was "), "event_label", F.lit(" involving "), "a_name", F.lit(" in the role of "), "r", F.lit(" and "), "b_name", F.lit(" in the role of "), "s", "end")
    said = stored(rows.select("end", text.alias("statements"), F.col("doc_name").alias("doc")).distinct(), "facts")
    first, second = (said.where(F.col("end") == end).select("statements", "doc") for end in (". ", "."))
    return first.unionByName(second.orderBy("statements", "doc").limit(limit)).distinct()


def provenance(found: DataFrame, lines: DataFrame, strict: bool = False) -> DataFrame:
    """Facts with the uri of the line that ends their doc's name; strict raises where there is none."""
    suffix = F.element_at(F.split("doc", "_"), -1).try_cast("bigint")
    out = found.withColumn("line_index", suffix).join(lines.select("line_index", "uri"), "line_index", "left" if strict else "inner")
    if strict:
        out = out.withColumn("uri", F.when(F.col("uri").isNull(), F.raise_error(F.concat(F.lit("no source line for "), "doc"))).otherwise(F.col("uri")))
    return out.select("statements", "doc", "line_index", "uri")
