"""Exact top-k by inner product: M-tree best-first search over pages.

Vectors are quantised to integers.  Equal vectors are one entry with its
smallest ids.  The tree has four levels: at most PIVOTS routing objects; under
each, pages of at most PAGE vectors that lie near each other; in a page, nodes
of about NODE entries; and the entries.  A routing object, page and node has a
routing vector and a covering radius, an entry the distance to its node's.

For a query q and an entry v under routing vector p, the triangle inequality
gives q.v <= q.p + |q| d(v, p), and for all under p q.p + |q| r.  Queries, in
blocks of neighbours, first search the page nearest to the block; the k-th scores
found there spare most routing objects and pages, which are tested level by level
for each query.  In a page, nodes are taken best bound first, and an inner product is
computed only if the stored distance lets it reach the k-th best so far.

Scores are integers throughout and must fit a long.  Distances and bounds are
floats, rounded outward by more than their error, so none drops an answer.

Vectors that are null or hold a null or non-finite component take no part, nor do
rows without an id.  Rows that repeat a query's id are the query's own, however many.  Only
vectors of the same length meet.  Ties go to the smaller id.  Other columns are
not read.  With no queries or no candidates there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, sampled

#: Routing objects at most, vectors of a page, entries of a node, queries of a block.
PIVOTS, PAGE, NODE, BLOCK = 2048, 4096, 64, 256
#: log2 of the building tasks whose pages a row of a routing object's directory lists, and blocks that meet a page in a task.
LISTED_BITS, MEETING = 6, 2048
#: Pages built by a task, about.
BUILT = 4
#: Relative error of a sum of float products, for each of its terms; more than twice the true one.
_ERROR = 2.0**-51
_LOW = np.iinfo(np.int64).min
_PAGES = "dim int, pivot int, reach double, centre binary, radius double, ids binary, vectors binary, nodes binary"
_BLOCKS = "dim int, home int, centre binary, query_ids binary, floors binary, queries binary"
_ASKING = "block long, dim int, query_ids binary, floors binary, queries binary, searched long"
_BEGUN = f"{_ASKING}, best binary, best_ids binary, computed long"
_FOUND = "query_id long, vec_id long, score long, computed long"


def quantised(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and v, the integers floor(scale * x), of the rows that take part."""
    x = F.col("embedding")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(fine).select("vec_id", F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _near(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """About the squared distances; which pivot is nearest need not be exact."""
    a, b = vectors.astype(float), pivots.astype(float)
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T


def _away(vectors: np.ndarray, routing: np.ndarray) -> np.ndarray:
    """The distance of each vector to its routing vector, rounded up."""
    gap = vectors.astype(float) - routing.astype(float)
    # Components beyond 2**53 are rounded before they are subtracted.
    most = max(float(np.abs(vectors).max(initial=0)), float(np.abs(routing).max(initial=0)))
    lost = most * 2.0**-52 * math.sqrt(vectors.shape[1]) if most >= 2.0**53 else 0.0
    return np.sqrt(np.square(gap).sum(1)) * (1 + (vectors.shape[1] + 8) * _ERROR) + lost


def _bound(queries: np.ndarray, routing: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each query and routing vector, no less than any inner product within the radius."""
    q, p = queries.astype(float), routing.astype(float)
    length = np.sqrt(np.square(q).sum(1)) * (1 + (q.shape[1] + 8) * _ERROR)
    own = np.sqrt(np.square(p).sum(1))
    return q @ p.T + length[:, None] * (radius + own * (q.shape[1] + 8) * _ERROR) * (1 + 4 * _ERROR)


def _below(scores: np.ndarray) -> np.ndarray:
    """Scores as floats that are not above them."""
    x = scores.astype(float)
    return x - np.abs(x) * 2.0**-52


def _located(pivots: dict[int, np.ndarray]):
    """A function for mapInArrow that adds dim, the nearest pivot of that dimension, the second nearest, and the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            first, second, away = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                if d and int(d) in pivots:
                    v, p = _matrix(batch.column("v").take(pa.array(own)), int(d)), pivots[int(d)]
                    squares = _near(v, p)
                    first[own] = squares.argmin(1)
                    if len(p) > 1:
                        squares[np.arange(len(own)), first[own]] = np.inf
                        second[own] = squares.argmin(1)
                    away[own] = _away(v, p[first[own]])
            yield pa.record_batch([*batch.columns, pa.array(dims.astype(np.int32)), pa.array(first), pa.array(second), pa.array(away)], [*batch.schema.names, "dim", "pivot", "second", "away"])

    return run


def _runs(build, most: int):
    """A function for mapInArrow over rows in order of dim and pivot: build() of each run of `most` rows of a pivot at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, key = 0, None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "pivot")])
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1 if len(keys) else []
            for at, end in zip([0, *ends], [*ends, len(keys)], strict=True):
                while at < end:
                    if rows and (rows == most or key != tuple(keys[at])):
                        yield build(*key, pa.Table.from_batches(held).combine_chunks())
                        held, rows = [], 0
                    key, n = tuple(keys[at]), min(end - at, most - rows)
                    held.append(batch.slice(at, n))
                    rows, at = rows + n, at + n
        if rows:
            yield build(*key, pa.Table.from_batches(held).combine_chunks())

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _row(schema: str, *values) -> pa.RecordBatch:
    """One row; arrays are kept as bytes."""
    kinds = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "long": pa.int64()}
    fields = [pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], kinds[x.split()[1]]) for v, x in zip(values, schema.split(", "), strict=True)]
    return pa.record_batch(fields, _names(schema))


def _page(dim: int, pivot: int, group: pa.Table) -> pa.RecordBatch:
    """One page: its routing vector and radius; entries ordered by node; for each node its routing vector, extent and radius, for each entry the distance to it."""
    vectors = _matrix(group.column("v"), dim)
    middle = vectors[_near(vectors, np.rint(vectors.mean(axis=0, keepdims=True)))[:, 0].argmin()] if dim else vectors[0]
    radius = float(_away(vectors, middle[None, :]).max())
    lists = group.column("ids").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    vectors = np.repeat(vectors, lists.value_lengths().to_numpy(), axis=0)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    routing = vectors[np.linspace(0, len(ids) - 1, max(1, len(ids) // NODE)).astype(int)]
    node = _near(vectors, routing).argmin(1)
    order = np.argsort(node, kind="stable")
    ids, vectors, node = ids[order], vectors[order], node[order]
    parent = _away(vectors, routing[node])
    used, start = np.unique(node, return_index=True)
    head = np.concatenate(([len(used)], start, parent.view(np.int64), np.maximum.reduceat(parent, start).view(np.int64), routing[used].ravel()))
    return _row(_PAGES, dim, pivot, float(group.column("away").to_numpy().max()), middle, radius, ids, vectors, head)


def _block(dim: int, pivot: int, group: pa.Table) -> pa.RecordBatch:
    """One block of queries that lie near each other."""
    own = _matrix(group.column("v"), dim)
    return _row(_BLOCKS, dim, pivot, own.mean(axis=0), group.column("vec_id").to_numpy().astype(np.int64), np.full(len(own), _LOW), own)


def search_page(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, ids: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query its k best (score, id) of a page that reach `floor`, and how many inner products it took.

    own: the queries' ids, which are no candidates of theirs. Missing places have the lowest score.
    """
    m, n = int(nodes[0]), len(ids)
    start = nodes[1 : m + 1]
    stop = np.append(start[1:], n)
    parent, radius = nodes[m + 1 : m + 1 + n].view(float), nodes[m + 1 + n : 2 * m + 1 + n].view(float)
    routing = nodes[2 * m + 1 + n :].reshape(m, queries.shape[1])
    bound = _bound(queries, routing, radius)
    at_node = _bound(queries, routing, np.zeros(m))
    length = np.sqrt(np.square(queries.astype(float)).sum(1)) * (1 + (queries.shape[1] + 8) * _ERROR)
    if queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) < 2**53:
        queries, vectors = queries.astype(float), vectors.astype(float)  # exact, and faster
    best, best_id = np.full((len(queries), k), _LOW), np.full((len(queries), k), np.iinfo(np.int64).max)
    needed = floor.astype(np.int64)
    computed = len(queries) * m
    for node in np.argsort(-bound.max(axis=0, initial=-np.inf), kind="stable"):
        some = np.flatnonzero(bound[:, node] >= _below(needed))
        if not len(some):
            continue
        entries = np.arange(start[node], stop[node])
        reach = at_node[some, node][:, None] + length[some][:, None] * parent[entries] * (1 + 4 * _ERROR) >= _below(needed[some])[:, None]
        kept = reach.any(0)
        entries, reach = entries[kept], reach[:, kept]
        score = queries[some] @ vectors[entries].T
        computed += score.size
        score = score.astype(np.int64)
        hit = reach & (score >= needed[some][:, None]) & (own[some][:, None] != ids[entries])
        rows, columns = hit.any(1), hit.any(0)
        if not rows.any():
            continue
        some, entries = some[rows], entries[columns]
        score = np.where(hit[rows][:, columns], score[rows][:, columns], _LOW)
        score = np.concatenate((best[some], score), axis=1)
        id_ = np.concatenate((best_id[some], np.broadcast_to(ids[entries], (len(some), len(entries)))), axis=1)
        top = np.lexsort((id_, -score.clip(_LOW + 1)), axis=1)[:, :k]
        best[some], best_id[some] = np.take_along_axis(score, top, 1), np.take_along_axis(id_, top, 1)
        needed[some] = np.maximum(needed[some], best[some, -1])
    return best, best_id, computed


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _long(row: dict, name: str) -> np.ndarray:
    return np.frombuffer(row[name], np.int64)


def _searched(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The queries' ids, and what search_page finds for a block in a page."""
    own, ids = _long(row, "query_ids"), _long(row, "ids")
    shaped = [_long(row, c).reshape(n, row["dim"]) for c, n in (("queries", len(own)), ("vectors", len(ids)))]
    return own, *search_page(shaped[0], own, _long(row, "floors"), ids, shaped[1], _long(row, "nodes"), k)


def _found(own: np.ndarray, best: np.ndarray, ids: np.ndarray, computed: int) -> pa.RecordBatch:
    """A row for each answer, and one without a query for the inner products that it took."""
    q, c = np.nonzero(best > _LOW)
    at_end = np.zeros(len(q) + 1, np.int64)
    at_end[-1] = computed
    answer = pa.array(np.append(np.zeros(len(q), bool), True))
    return pa.record_batch([pa.array(np.append(x, 0), mask=answer.to_numpy(zero_copy_only=False)) for x in (own[q], ids[q, c], best[q, c])] + [pa.array(at_end)], ["query_id", "vec_id", "score", "computed"])


def _search(k: int):
    """A function for mapInArrow over (block of queries, page) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield _found(*_searched(row, k))

    return run


def _begin(k: int):
    """A function for mapInArrow over blocks and their first pages: the block with the floors found there, and the answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            _, best, ids, computed = _searched(row, k)
            yield _row(_BEGUN, row["block"], row["dim"], row["query_ids"], np.ascontiguousarray(best[:, -1]), row["queries"], row["page"], best, ids, computed)

    return run


def _answers(k: int):
    """A function for mapInArrow over begun blocks: the answers of their first pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield _found(_long(row, "query_ids"), _long(row, "best").reshape(-1, k), _long(row, "best_ids").reshape(-1, k), row["computed"])

    return run


def _part(row: dict, some: np.ndarray) -> list:
    """A block's columns, with some of its queries only."""
    ids = _long(row, "query_ids")
    return [row["block"], row["dim"], ids[some], _long(row, "floors")[some], _long(row, "queries").reshape(len(ids), row["dim"])[some], row["searched"]]


def _pivots_reached(pivots: dict[int, np.ndarray], radius: dict[int, np.ndarray]):
    """A function for mapInArrow: each block's queries, with every routing object under which some of them can reach their floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            floors = _long(row, "floors")
            hit = _bound(_long(row, "queries").reshape(len(floors), row["dim"]), pivots[row["dim"]], radius[row["dim"]]) >= _below(floors)[:, None]
            for p in np.flatnonzero(hit.any(0)):
                yield _row(f"{_ASKING}, pivot int", *_part(row, np.flatnonzero(hit[:, p])), int(p))

    return run


def _centres(row: dict) -> np.ndarray:
    return np.frombuffer(b"".join(p["centre"] for p in row["listed"]), np.int64).reshape(len(row["listed"]), row["dim"])


def _pages_reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over blocks and a routing object's directory: a block's queries with each page that they can reach, but for the one they began with."""
    for row in _each(batches):
        floors = _long(row, "floors")
        hit = _bound(_long(row, "queries").reshape(len(floors), row["dim"]), _centres(row), np.array([p["radius"] for p in row["listed"]])) >= _below(floors)[:, None]
        for p in np.flatnonzero(hit.any(0)):
            page = row["listed"][p]["page"]
            if page != row["searched"]:
                yield _row(f"{_ASKING}, page long", *_part(row, np.flatnonzero(hit[:, p])), page)


def _closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over blocks' centres and a directory: the page that suits the block best, and how well."""
    for row in _each(batches):
        fit = _centres(row) @ np.frombuffer(row["centre"])
        at = int(fit.argmax())
        yield pa.record_batch([pa.array([row["block"]]), pa.array([row["listed"][at]["page"]]), pa.array([float(fit[at])])], ["block", "page", "fit"])


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Candidates (query_id, vec_id, score) with each query's k best among them, and rows with the inner products computed."""
    each = rows.select("vec_id", "v").withColumn("n", F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("vec_id"))).where(F.col("n") <= k)
    few = each.withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = cut(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))  # k + 1 ids at most, each k times; a query's own may be one
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row for each length
    pivots: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        own = distinct.where(F.size("v") == dim).select("v")
        some = sampled(own, min(PIVOTS, math.ceil(n / PAGE)), n, "v").collect() or own.limit(1).collect()  # PIVOTS vectors at most
        pivots[dim] = np.array([r["v"] for r in some], np.int64).reshape(len(some), dim)
    located = "dim int, pivot int, second int, away double"

    def in_order(df: DataFrame, n: int, most: int) -> DataFrame:
        """df's rows with those near each other in the same partition and in order, about `most` in each."""
        keys = ["dim", "pivot", "second", "away", "v"]
        return df.repartitionByRange(max(1, math.ceil(n / most)), *keys).sortWithinPartitions(*keys)

    placed = in_order(distinct.mapInArrow(_located(pivots), f"v array<bigint>, ids array<bigint>, {located}"), sum(sizes.values()), BUILT * PAGE)
    pages = cut(placed.mapInArrow(_runs(_page, PAGE), _PAGES).withColumn("page", F.monotonically_increasing_id()))
    radius = {d: np.zeros(len(p)) for d, p in pivots.items()}
    for r in pages.groupBy("dim", "pivot").agg(F.max("reach").alias("radius")).collect():  # a row for each pivot
        radius[r["dim"]][r["pivot"]] = r["radius"]
    part = F.shiftright("page", 33 + LISTED_BITS)  # pages of neighbouring partitions
    directory = pages.groupBy("dim", "pivot", part.alias("part")).agg(F.collect_list(F.struct("page", "centre", "radius")).alias("listed")).drop("part")

    known = queries.select("vec_id", "v").where(F.col("vec_id").isNotNull() & F.size("v").isin(*sizes, -2)).dropDuplicates(["vec_id"])
    asked = cut(known.mapInArrow(_located(pivots), f"vec_id long, v array<bigint>, {located}"))
    n = asked.count()
    blocks = cut(in_order(asked, n, BUILT * BLOCK).mapInArrow(_runs(_block, BLOCK), _BLOCKS).withColumn("block", F.monotonically_increasing_id()))
    # A page or directory that all blocks meet is held by several tasks.
    salts = math.ceil(n / BLOCK / MEETING) or 1
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    stored, directory = salted(pages.select("page", "ids", "vectors", "nodes")), cut(salted(directory))

    near = blocks.select("block", "dim", "centre", F.col("home").alias("pivot"), salt).join(directory, ["dim", "pivot", "salt"]).select("block", "dim", "centre", "listed")
    home = near.mapInArrow(_closest, "block long, page long, fit double").groupBy("block").agg(F.max_by("page", F.struct("fit", "page")).alias("page"))
    begun = cut(blocks.join(home, "block").select("block", "dim", "query_ids", "floors", "queries", "page", salt).join(stored, ["page", "salt"]).mapInArrow(_begin(k), _BEGUN))
    visits = begun.select(*_names(_ASKING)).mapInArrow(_pivots_reached(pivots, radius), f"{_ASKING}, pivot int").select("*", salt)
    reached = visits.join(directory, ["dim", "pivot", "salt"]).select(*_names(_ASKING), "listed").mapInArrow(_pages_reached, f"{_ASKING}, page long")
    rest = reached.select("*", salt).join(stored, ["page", "salt"]).select("dim", "query_ids", "floors", "queries", "ids", "vectors", "nodes").mapInArrow(_search(k), _FOUND)
    return begun.select("query_ids", "best", "best_ids", "computed").mapInArrow(_answers(k), _FOUND).unionByName(rest)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each query; both have columns vec_id and v."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = search(rows, queries, k).where("query_id is not null")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
