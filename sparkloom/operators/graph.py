"""Graph traversal over edge tables with columns in and out, as chains of joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import resolve, type_of
from ..shared import cut

#: Ids of a frontier that is broadcast to the edges at most; a larger one is dealt as they are.
BROADCAST_NODES = 100_000
OUT, IN, BOTH = "out", "in", "both"


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (_from, _to) in the direction of travel; both directions give every edge twice."""
    out = edges.select(F.col("in").alias("_from"), F.col("out").alias("_to"))
    back = edges.select(F.col("out").alias("_from"), F.col("in").alias("_to"))
    if direction == BOTH:
        return out.unionByName(back)
    if direction not in (OUT, IN):
        raise ValueError(f"no such direction: {direction}")
    return out if direction == OUT else back


def hop(at: DataFrame, edges: DataFrame, direction: str = OUT, depth: int = 1) -> DataFrame:
    """From rows (start, node), the rows (start, node) that `depth` hops lead to, once for every path.

    Beyond one hop, paths are numbers on the way, and rows are repeated at the end.
    """
    if depth < 1:
        raise ValueError("depth must be 1 or more")
    if depth == 1:
        return at.join(oriented(edges, direction), F.col("node") == F.col("_from")).select("start", F.col("_to").alias("node"))
    return repeated(counted(at, edges, direction, depth)).select("start", "node")


def counted(at: DataFrame, edges: DataFrame, direction: str = OUT, depth: int = 1) -> DataFrame:
    """From rows (start, node), with a number of paths or once for each, the rows (start, node, paths) that `depth` hops lead to.

    Paths are summed at every hop, so there are never more rows than pairs of a start and a node.
    """
    if depth < 1:
        raise ValueError("depth must be 1 or more")
    steps = oriented(edges, direction)
    if "paths" not in at.columns:
        at = at.groupBy("start", "node").agg(F.count("*").alias("paths"))
    for _ in range(depth):
        at = at.join(steps, F.col("node") == F.col("_from")).groupBy("start", F.col("_to").alias("node")).agg(F.sum("paths").alias("paths"))
    return at


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as its paths say, without the number."""
    return rows.withColumn("_path", F.explode(F.sequence(F.lit(1), F.col("paths")))).drop("_path", "paths")


def starts(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.select(F.col(key).alias("start"), F.col(key).alias("node"))


def edges_of(edges: DataFrame, record: str, direction: str = OUT) -> DataFrame:
    """The edge rows at a record."""
    there = (F.col("in") == record, F.col("out") == record)
    return edges.where(there[0] if direction == OUT else there[1] if direction == IN else there[0] | there[1])


def count_related(edges: DataFrame, record: str, direction: str = OUT) -> int:
    if direction == BOTH:
        raise ValueError("counts go one way: out or in")
    return edges_of(edges, record, direction).count()


def related(edges: DataFrame, nodes: DataFrame, record: str, direction: str = OUT) -> DataFrame:
    """The rows at the other ends of a record's edges, once for every edge."""
    if direction == BOTH:
        raise ValueError("related records go one way: out or in")
    far = edges_of(edges, record, direction).select(F.col("out" if direction == OUT else "in").alias("_far"))
    return far.join(nodes, F.col("_far") == F.col("id")).drop("_far")


def fetch(rows: DataFrame, link: str, target: DataFrame) -> DataFrame:
    """rows with linked records, as structs, in place of their ids: null where there is none.

    A link is a column, or a dotted path into structs, such as those that another fetch has put in; it holds an id or an
    array of ids. Arrays keep their order, repeats and places without a record; equal arrays are gathered once.
    """
    linked = target.select(F.col("id").alias("_id"), F.struct(*target.columns).alias("_linked"))
    root, _, rest = link.partition(".")
    if type_of(link, rows).typeName() == "array":
        lists = rows.select(F.col(link).alias("_links")).where(F.size("_links") > 0).distinct()
        each = lists.select("_links", F.posexplode("_links").alias("_place", "_one")).join(linked, F.col("_one") == F.col("_id"), "left")
        in_order = F.array_sort(F.collect_list(F.struct("_place", "_linked")), lambda a, b: a["_place"] - b["_place"])
        found = each.groupBy("_links").agg(F.transform(in_order, lambda x: x["_linked"]).alias("_linked"))
        out = rows.join(found, F.col(link) == F.col("_links"), "left")
        new = F.when(F.size(link) == 0, F.from_json(F.lit("[]"), found.schema["_linked"].dataType)).otherwise(F.col("_linked"))
    else:
        out, new = rows.join(linked, F.col(link) == F.col("_id"), "left"), F.col("_linked")
    return out.select(*[(F.col(c).withField(rest, new) if rest else new).alias(c) if c == root else F.col(c) for c in rows.columns])


def reverse_references(rows: DataFrame, source: DataFrame, link: str, name: str, *fields: str) -> DataFrame:
    """rows with an array of the source rows (or some of their fields) whose link, or array of links, points at each."""
    target = F.explode(link) if source.schema[link].dataType.typeName() == "array" else F.col(link)
    kept = fields or tuple(source.columns)
    what = F.col(kept[0]) if len(kept) == 1 else F.struct(*kept)
    by_target = source.select(target.alias("_target"), what.alias("_x")).groupBy("_target").agg(F.sort_array(F.collect_list("_x")).alias(name))
    out = rows.join(by_target, F.col("id") == F.col("_target"), "left").drop("_target")
    return out.withColumn(name, F.coalesce(name, F.expr(f"filter({name}, x -> false)"), F.from_json(F.lit("[]"), by_target.schema[name].dataType.simpleString())))


def distances(edges: DataFrame, start: str | Sequence[str], most: int, direction: str = OUT) -> DataFrame:
    """(node, hops) for every node within `most` hops of the start, or of the nearest of several: a frontier that grows by
    one hop, each node once, at its least distance.

    A frontier of up to BROADCAST_NODES ids is broadcast to the edges as they are; beyond, they are dealt by their
    beginnings, once. Each frontier is checkpointed, so that plans stay short; what it holds is ids alone.
    """
    spark = edges.sparkSession
    steps = Steps(oriented(edges, direction))
    seen = frontier = spark.createDataFrame([(x, 0) for x in dict.fromkeys([start] if isinstance(start, str) else start)], "node string, hops int")
    n = len(frontier.take(1))
    for k in range(1, most + 1):
        if not n:
            break
        far = steps.after(frontier, n).select("node").distinct()
        frontier = cut(far.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k)))
        n = frontier.count()
        seen = seen.unionByName(frontier)
    return seen


class Steps:
    """Oriented edges, which are dealt by their beginnings as soon as a frontier is too large to be broadcast."""

    def __init__(self, edges: DataFrame) -> None:
        self.edges, self.dealt = edges, False

    def after(self, frontier: DataFrame, n: int) -> DataFrame:
        """(parent, node) for the edges from a frontier of n nodes."""
        if n > BROADCAST_NODES and not self.dealt:
            self.edges, self.dealt = cut(self.edges.repartition("_from")), True
        at = frontier.select(F.col("node").alias("_at"))
        at = F.broadcast(at) if n <= BROADCAST_NODES else at
        return self.edges.join(at, F.col("_from") == F.col("_at")).select(F.col("_from").alias("parent"), F.col("_to").alias("node"))


def shortest(edges: DataFrame, start: str, end: str, most: int) -> DataFrame:
    """hops, nodes and edges (in, out) of one shortest path of at most `most` outgoing edges between two different nodes; no row if there is none.

    Two frontiers grow towards each other, each time the one with fewer nodes, and keep each node's neighbour on the way
    back; of several paths it is the one that meets at the least id. The path is put together by a join for every hop.
    """
    spark = edges.sparkSession
    none = spark.createDataFrame([], "hops int, nodes array<string>, edges array<struct<in: string, out: string>>")
    if start == end or most < 1:
        return none
    steps = (Steps(oriented(edges, OUT)), Steps(oriented(edges, IN)))
    levels = [[spark.createDataFrame([(x, None)], "node string, parent string")] for x in (start, end)]
    sizes = [1, 1]
    meet = None
    while meet is None:
        if not all(sizes) or sum(len(v) - 1 for v in levels) >= most:
            return none
        side = int(sizes[1] < sizes[0])
        own = levels[side]
        far = steps[side].after(own[-1], sizes[side]).groupBy("node").agg(F.min("parent").alias("parent"))
        for seen in own:
            far = far.join(seen.select("node"), "node", "left_anti")
        own.append(cut(far))
        sizes[side] = own[-1].count()
        found = own[-1].join(levels[1 - side][-1].select("node"), "node", "left_semi").agg(F.min("node")).first()[0]
        meet = found
    path = spark.createDataFrame([(meet,)], "_0 string").select(F.array("_0").alias("nodes"))
    for side in (0, 1):
        for level in reversed(levels[side][1:]):
            at = F.element_at("nodes", -1 if side else 1)
            joined = path.join(level, F.col("node") == at)
            path = joined.select((F.concat("nodes", F.array("parent")) if side else F.concat(F.array("parent"), "nodes")).alias("nodes"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda k: F.struct(F.element_at("nodes", k).alias("in"), F.element_at("nodes", k + 1).alias("out")))
    return path.select((F.size("nodes") - 1).alias("hops"), "nodes", pairs.alias("edges"))


def shortest_path(edges: DataFrame, nodes: DataFrame, start: str, end: str, most: int) -> DataFrame:
    """The end's row with its hops, if `most` hops along outgoing edges reach it; a start that is the end counts only by a cycle."""
    if most < 1:
        return nodes.limit(0).withColumn("hops", F.lit(0))
    if start == end:
        around = distances(edges, start, most - 1).join(edges.where(F.col("out") == end), F.col("node") == F.col("in")).agg((F.min("hops") + 1).alias("hops")).where("hops is not null")
    else:
        around = shortest(edges, start, end, most).select("hops")
    return nodes.where(F.col("id") == end).join(F.broadcast(around), F.lit(True))


def path_to(edges: DataFrame, start: str, end: str, most: int) -> list[str]:
    """The ids along one shortest path, empty if there is none; a start that is the end is a path by itself."""
    if start == end:
        return [start]
    found = shortest(edges, start, end, most).first()
    return list(found["nodes"]) if found else []


@dataclass(frozen=True)
class GraphQuery:
    """A traversal, step by step; each step is immutable, and to_df() makes one plan of joins."""

    start: Any
    steps: tuple[tuple[str, str, int], ...] = ()
    target: str | None = None
    condition: Any = None
    fields: tuple[Any, ...] = ()
    most: int | None = None
    links: tuple[tuple[str, str], ...] = ()

    def out(self, edge: str, depth: int = 1) -> GraphQuery:
        return replace(self, steps=(*self.steps, (edge, OUT, depth)))

    def in_(self, edge: str, depth: int = 1) -> GraphQuery:
        return replace(self, steps=(*self.steps, (edge, IN, depth)))

    def both(self, edge: str, depth: int = 1) -> GraphQuery:
        return replace(self, steps=(*self.steps, (edge, BOTH, depth)))

    def to(self, table: str) -> GraphQuery:
        """The nodes' table; the way there is the last step's."""
        return replace(self, target=table)

    def where(self, condition: Any) -> GraphQuery:
        return replace(self, condition=condition if self.condition is None else (lambda df, a=self.condition: resolve(a, df) & resolve(condition, df)))

    def select(self, *fields: Any) -> GraphQuery:
        return replace(self, fields=(*self.fields, *fields))

    def limit(self, n: int) -> GraphQuery:
        if n < 0:
            raise ValueError("limit must be 0 or more")
        return replace(self, most=n)

    def fetch(self, link: str, table: str) -> GraphQuery:
        return replace(self, links=(*self.links, (link, table)))

    def _ends(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """The rows that paths end at, each once, with the number of paths that do; without to(), the ids as node."""
        some = next(iter(tables.values())).sparkSession
        at, steps = None, self.steps
        if isinstance(self.start, str) and steps:  # the first hop of one record is a filter, which the scan can use
            (edge, direction, depth), *rest = steps
            first = oriented(tables[edge], direction).where(F.col("_from") == self.start)
            at = first.groupBy(F.lit(self.start).alias("start"), F.col("_to").alias("node")).agg(F.count("*").alias("paths"))
            steps = [(edge, direction, depth - 1), *rest] if depth > 1 else rest
        elif isinstance(self.start, str):
            at = some.createDataFrame([(self.start, self.start, 1)], "start string, node string, paths long")
        else:
            at = starts(self.start).withColumn("paths", F.lit(1).cast("long"))
        for edge, direction, depth in steps:
            at = counted(at, tables[edge], direction, depth)
        rows = at.select("node", "paths")
        if self.target:
            rows = rows.join(tables[self.target], F.col("node") == F.col("id")).drop("node")
        if self.condition is not None:
            rows = rows.where(self.condition(rows) if isinstance(self.condition, Callable) and not isinstance(self.condition, Column) else resolve(self.condition, rows))
        return rows

    def to_df(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """The rows that paths end at, each once for every path; without to(), the ids as node."""
        rows = repeated(self._ends(tables))
        for link, table in self.links:
            rows = fetch(rows, link, tables[table])
        if self.fields:
            rows = rows.select(*[resolve(f, rows) for f in self.fields])
        return rows if self.most is None else rows.limit(self.most)

    def count(self, tables: Mapping[str, DataFrame]) -> int:
        """How many rows to_df() has, by the numbers of paths."""
        n = self._ends(tables).agg(F.coalesce(F.sum("paths"), F.lit(0))).first()[0]
        return n if self.most is None else min(n, self.most)

    def exists(self, tables: Mapping[str, DataFrame]) -> bool:
        return self.most != 0 and not self._ends(tables).isEmpty()
