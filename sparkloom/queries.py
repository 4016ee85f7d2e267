"""Queries over the test tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import results, schema
from .cache import Cache
from .functions import expressions as e
from .functions import field, raw
from .functions import predicates as p
from .ids import RecordId, record_id
from .operators import dml, fulltext, graph, vector
from .operators.vectorindex import CodeIndex, GraphIndex, VectorIndex
from .plans import Database, Query, helpers, hints
from .plans.session import Forbidden, Session
from .shared import cut, scratch
from .sources import Bucket, Conflict, Sequence, Store, Table, Transaction, Work
from .streaming import feeds

# The node tables and their keys, and the edge tables as table, in-table and key, out-table and key.
NODES = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
EDGES = {"placed": ("orders", "customer", "o_custkey", "orders", "o_orderkey"), "contains": ("lineitem", "orders", "l_orderkey", "part", "l_partkey"), "in_region": ("nation", "nation", "n_nationkey", "region", "n_regionkey")}


def database(spark: SparkSession, sf_dir: str) -> Database:
    """The test tables; nodes have ids, and edges are views of the keys that tables share."""
    db = Database(spark)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for name in "region nation customer supplier part orders lineitem events documents embeddings".split():
        db.tables[name] = read(name)
        if name in NODES:
            db.tables[name] = db.tables[name].withColumn("id", record_id(name, NODES[name]))
            db.keys[name] = NODES[name]
    for name, (table, a, a_key, b, b_key) in EDGES.items():
        db.tables[name] = read(table).select(record_id(a, a_key).alias("in"), record_id(b, b_key).alias("out"))
        db.keyed[name] = read(table).select(F.col(a_key).alias("in"), F.col(b_key).alias("out"))
        db.edges.add(name)
        db.ends[name] = (a, b)
    db.tables["supplies"] = read("lineitem").select(record_id("supplier", "l_suppkey").alias("in"), record_id("part", "l_partkey").alias("out")).distinct()
    db.edges.add("supplies")
    return db


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function from a database to a DataFrame under its name."""

    def add(f: Callable[[Database], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(database(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Scans, projections and predicates


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def q_order_by_path(db):
    """Order by a path into a struct that isn't selected, in as many tasks as a hint asks for."""
    db.tables["o"] = db.tables["orders"].select("o_orderkey", F.struct("o_totalprice", "o_orderdate").alias("paid"))
    q = Query().select("o_orderkey").from_table("o").order_by("paid.o_totalprice", "desc").order_by("o_orderkey").limit(25)
    return q.hint(hints.Parallel(4)).to_df(db)


@query("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, l_quantity + l_tax AS mixed, l_quantity - 1 AS less, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio FROM lineitem")
def q_project_filter(db):
    return Query().select("l_orderkey", e.as_(field("l_extendedprice") * (raw("1") - field("l_discount")), "net"), e.as_(field("l_quantity") + field("l_tax"), "mixed"), e.as_(field("l_quantity") - 1, "less"), e.as_(field("l_tax") / field("l_discount"), "ratio")).from_table("lineitem").to_df(db)


@query("SELECT * FROM region")
def q_scan_all(db):
    return Query().from_table("region").to_df(db).drop("id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def q_get_record(db):
    return Query().select("o_orderkey", "o_totalprice").from_table("orders:7").to_df(db)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' AND o_totalprice > 1000 AND o_totalprice >= 1001 AND o_orderkey < 1000000 AND o_orderkey <= 999999")
def q_predicates_cmp(db):
    q = Query().select("o_orderkey").from_table("orders")
    for c in (p.eq("o_orderstatus", "O"), p.ne("o_orderpriority", "1-URGENT"), p.gt("o_totalprice", 1000), p.gte("o_totalprice", 1001), p.lt("o_orderkey", 1000000), p.lte("o_orderkey", 999999)):
        q = q.where_op(c)
    return q.to_df(db)


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def q_inside(db):
    return Query().select("c_custkey").from_table("customer").where_(p.inside("c_mktsegment", ["BUILDING", "MACHINERY"])).to_df(db)


@query("SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def q_not_inside(db):
    return Query().select("c_custkey").from_table("customer").where_(p.not_inside("c_mktsegment", ["BUILDING", "MACHINERY"])).to_df(db)


@query("SELECT p_partkey FROM part WHERE (p_size > 10 AND NOT (p_type = 'PROMO')) OR p_brand = 'Brand#11'")
def q_logic(db):
    return Query().select("p_partkey").from_table("part").where_(p.or_(p.and_(p.gt("p_size", 10), p.not_(p.eq("p_type", "PROMO"))), p.eq("p_brand", "Brand#11"))).to_df(db)


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9 AND p_retailprice * 2 > 1000")
def q_where_text(db):
    return Query().select("p_partkey").from_table("part").where_str("p_size BETWEEN 5 AND 9").where_("p_retailprice * 2 > 1000").to_df(db)


def _words(db) -> Database:
    db.tables["part"] = db.tables["part"].withColumn("words", F.split("p_name", " "))
    return db


_FIRST = "(SELECT string_split(p_name, ' ')[1] FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part))"


def _first_words(db) -> list[str]:
    return list(_words(db).table("part").orderBy("p_partkey").first()["words"])


@query(f"SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), {_FIRST})")
def q_contains(db):
    return Query().select("p_partkey").from_table("part").where_(p.contains("words", _first_words(db)[0])).to_df(db)


@query(f"SELECT p_partkey FROM part WHERE NOT list_contains(string_split(p_name, ' '), {_FIRST})")
def q_contains_not(db):
    return Query().select("p_partkey").from_table("part").where_(p.contains_not("words", _first_words(db)[0])).to_df(db)


_BOTH = "(SELECT string_split(p_name, ' ') FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part))"


@query(f"SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), {_BOTH})")
def q_contains_all(db):
    return Query().select("p_partkey").from_table("part").where_(p.contains_all("words", _first_words(db))).to_df(db)


@query(f"SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), {_BOTH})")
def q_contains_any(db):
    return Query().select("p_partkey").from_table("part").where_(p.contains_any("words", _first_words(db))).to_df(db)


@query("SELECT p_partkey FROM part WHERE contains(p_type, 'AR')")
def q_contains_text(db):
    return Query().select("p_partkey").from_table("part").where_(p.contains("p_type", "AR")).to_df(db)


_VARIANTS = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"k\": null}' WHEN 1 THEN '{}' ELSE props END AS j FROM events"


@query(f"SELECT event_id, CAST(coalesce(json_type(j, '$.k') = 'NULL', false) AS BOOLEAN) AS is_null, json_type(j, '$.k') IS NULL AS is_none, json_type(j, '$.k') IS NOT NULL AS is_not_none FROM ({_VARIANTS}) WHERE json_type(j, '$.k') IS NULL OR json_type(j, '$.k') = 'NULL' OR CAST(json_extract_string(j, '$.k') AS BIGINT) > 50")
def q_null_none(db):
    props = F.when(F.col("event_id") % 3 == 0, '{"k": null}').when(F.col("event_id") % 3 == 1, "{}").otherwise(F.col("props"))
    db.tables["notes"] = db.tables["events"].select("event_id", F.parse_json(props).alias("doc"))
    q = Query().select("event_id", e.as_(p.is_null("doc.k"), "is_null"), e.as_(p.is_none("doc.k"), "is_none"), e.as_(p.is_not_none("doc.k"), "is_not_none")).from_table("notes")
    return q.where_(p.or_(p.is_none("doc.k"), p.is_null("doc.k"), p.gt("doc.k", 50))).to_df(db)


# Aggregates


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2")
def q_group_by(db):
    q = Query().select("l_returnflag", "l_linestatus", e.as_(e.round_(e.sum_("l_quantity"), 2), "sum_qty"), e.as_(e.round_(e.avg("l_discount"), 6), "avg_disc"), e.as_(e.count_all(), "n"))
    return q.from_table("lineitem").where_("l_shipdate <= TIMESTAMP_NTZ '2000-09-02'").group_by("l_returnflag", "l_linestatus").to_df(db)


@query("SELECT count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, count(value) AS known FROM events")
def q_group_all(db):
    return Query().select(e.as_(e.count(), "n"), e.as_(e.round_(e.sum_("value"), 4), "total"), e.as_(e.min_("value"), "low"), e.as_(e.max_("value"), "high"), e.as_(e.count("value"), "known")).from_table("events").group_all().to_df(db)


@query("SELECT event_type, count(*) FILTER (value > 50) AS large FROM events GROUP BY 1")
def q_count_if(db):
    return Query().select("event_type", e.as_(e.count_if(p.gt("value", 50)), "large")).from_table("events").group_by("event_type").to_df(db)


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def q_math_aggs(db):
    return Query().select("o_orderstatus", e.as_(e.round_(e.math_sum("o_totalprice"), 2), "total"), e.as_(e.round_(e.math_mean("o_totalprice"), 4), "mean"), e.as_(e.math_min("o_totalprice"), "low"), e.as_(e.math_max("o_totalprice"), "high")).from_table("orders").group_by("o_orderstatus").to_df(db)


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, CAST(list_min(embedding) AS DOUBLE) AS low, CAST(list_max(embedding) AS DOUBLE) AS high, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 6) AS mean FROM embeddings")
def q_math_arrays(db):
    return Query().select("vec_id", e.as_(e.round_(e.math_sum("embedding"), 6), "total"), e.as_(e.cast(e.math_min("embedding"), "float"), "low"), e.as_(e.cast(e.math_max("embedding"), "float"), "high"), e.as_(e.round_(e.math_mean("embedding"), 6), "mean")).from_table("embeddings").to_df(db)


# Scalar functions


@query("SELECT n_nationkey, upper(n_name) AS up, lower(n_name) AS low, length(n_name) AS len, concat(n_name, '-', CAST(n_nationkey AS VARCHAR)) AS both_ FROM nation")
def q_string_fns(db):
    return Query().select("n_nationkey", e.as_(e.upper("n_name"), "up"), e.as_(e.string_lower("n_name"), "low"), e.as_(e.cast(e.string_len("n_name"), "int"), "len"), e.as_(e.string_concat("n_name", "'-'", e.cast("n_nationkey", "string")), "both_")).from_table("nation").to_df(db)


@query("SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, round(c_acctbal) AS r FROM customer")
def q_math_fns(db):
    return Query().select("c_custkey", e.as_(e.abs_("c_acctbal"), "a"), e.as_(e.ceil("c_acctbal"), "c"), e.as_(e.math_floor("c_acctbal"), "f"), e.as_(e.func("math::round", "c_acctbal"), "r")).from_table("customer").to_df(db)


@query(f"SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n, list_contains(string_split(p_name, ' '), {_FIRST}) AS has FROM part")
def q_array_fns(db):
    first = _first_words(db)[0]
    return Query().select("p_partkey", e.as_(e.array_length("words"), "n"), e.as_(e.array_contains("words", first), "has")).from_table("part").to_df(db)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d at %H:%M') AS day FROM orders")
def q_time_format(db):
    return Query().select("o_orderkey", e.as_(e.time_format("o_orderdate", "%Y-%m-%d at %H:%M"), "day")).from_table("orders").to_df(db)


@query("SELECT l_orderkey, CAST(trunc(l_quantity) AS BIGINT) AS n, CAST(l_linenumber AS VARCHAR) AS t, TRY_CAST(l_returnflag AS BIGINT) AS none FROM lineitem")
def q_cast(db):
    return Query().select("l_orderkey", e.as_(e.cast("l_quantity", "int"), "n"), e.as_(e.cast("l_linenumber", "string"), "t"), e.as_(e.cast("l_returnflag", "int"), "none")).from_table("lineitem").to_df(db)


@query("SELECT c_custkey, true AS number, false AS text, true AS word FROM customer")
def q_type_is(db):
    return Query().select("c_custkey", e.as_(e.type_is("c_acctbal", "number"), "number"), e.as_(e.type_is("c_acctbal", "string"), "text"), e.as_(e.type_is("c_name", "string"), "word")).from_table("customer").to_df(db)


@query("SELECT n_nationkey, 'hi ' || n_name AS greeting FROM nation")
def q_stored_function(db):
    e.register("fn::greet", lambda name: F.concat(F.lit("hi "), name))
    return Query().select("n_nationkey", e.as_(e.func("fn::greet", "n_name"), "greeting")).from_table("nation").to_df(db)


# Order and paging


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 10")
def q_order_limit_offset(db):
    return Query().select("o_orderkey", "o_totalprice").from_table("orders").order_by("o_totalprice", "desc").order_by("o_orderkey").limit(20).offset(10).to_df(db)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1")
def q_first(db):
    return Query().select("o_orderkey").from_table("orders").order_by("o_orderdate").order_by("o_orderkey").first().to_df(db)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def q_last(db):
    return Query().select("o_orderkey").from_table("orders").order_by("o_orderdate").order_by("o_orderkey").last().to_df(db)


# Joins and graphs


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 5000")
def q_join_raw(db):
    db.tables = {k: v.drop("id") for k, v in db.tables.items()}
    return Query().select("c_custkey", "c_name", "o_orderkey").from_table("customer").join("orders", "c_custkey = o_custkey").where_(p.gt("o_totalprice", 5000)).to_df(db)


@query("SELECT o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 7")
def q_hop1_out(db):
    return Query().select("o_orderkey").from_table("customer:7").traverse("->placed->orders").to_df(db)


@query("SELECT c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def q_hop1_in(db):
    db.tables["some"] = db.tables["orders"].where("o_orderstatus = 'P'")
    return Query().select("c_custkey").from_table("some").traverse("<-placed<-customer").to_df(db)


@query("SELECT p_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = 11")
def q_hop2(db):
    return Query().select("p_partkey").from_table("customer:11").traverse("->placed->orders->contains->part").to_df(db)


@query("SELECT 'orders:' || o_orderkey AS node FROM orders WHERE o_custkey = 3 UNION ALL SELECT NULL WHERE false")
def q_both(db):
    return graph.GraphQuery("customer:3").both("placed").to_df(db.tables)


@query("SELECT count(*) AS n FROM orders WHERE o_custkey = 5")
def q_count_related(db):
    return db.edges_at("placed", "customer:5").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 5")
def q_related(db):
    return db.related("placed", "customer:5").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 5 AND o_totalprice > 2000")
def q_graph_where(db):
    return graph.GraphQuery("customer:5").out("placed").to("orders").where("o_totalprice > 2000").select("o_orderkey").to_df(db.tables)


@query("SELECT c_custkey, (SELECT coalesce(list(o_orderkey ORDER BY o_orderkey), []) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer")
def q_reverse_ref(db):
    return graph.reverse_references(db.tables["customer"].select(F.col("c_custkey").alias("id")), db.tables["orders"], "o_custkey", "orders", "o_orderkey").withColumnRenamed("id", "c_custkey")


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def q_fetch(db):
    db.tables["nation"] = db.tables["nation"].withColumn("region", record_id("region", "n_regionkey"))
    rows = Query().select("n_name", "region").from_table("nation").fetch("region", "region").to_df(db)
    return rows.select("n_name", F.col("region.r_name").alias("r_name"))


_REACHED = """
    WITH RECURSIVE e AS (SELECT DISTINCT 'orders:' || l_orderkey AS a, 'part:' || l_partkey AS b FROM lineitem),
    s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r(node, hops) AS (SELECT 'orders:1', 0 UNION SELECT s.b, hops + 1 FROM r JOIN s ON s.a = r.node WHERE hops < 3)
    SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY node"""


@query(_REACHED)
def q_reachable(db):
    return graph.distances(db.tables["contains"], "orders:1", 3, graph.BOTH)


@query("SELECT p_partkey, 2 AS hops FROM part WHERE p_partkey = (SELECT min(l_partkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 11)")
def q_shortest_path(db):
    both = db.tables["placed"].unionByName(db.tables["contains"])
    key = db.tables["lineitem"].join(db.tables["orders"].where("o_custkey = 11"), F.col("l_orderkey") == F.col("o_orderkey")).agg(F.min("l_partkey")).first()[0]
    return graph.shortest_path(both, db.tables["part"], "customer:11", f"part:{key}", 4).select("p_partkey", "hops")


# Vectors

_X = "list_transform(q.embedding, lambda x: CAST(x AS DOUBLE))"
_Y = "list_transform(c.embedding, lambda x: CAST(x AS DOUBLE))"
_GAPS = f"list_transform(list_zip({_X}, {_Y}), lambda z: abs(z[1] - z[2]))"
_DISTANCES = {
    "cosine": f"1 - list_cosine_similarity({_X}, {_Y})",
    "euclidean": f"list_distance({_X}, {_Y})",
    "manhattan": f"list_sum({_GAPS})",
    "chebyshev": f"list_max({_GAPS})",
    "minkowski": f"pow(list_sum(list_transform({_GAPS}, lambda g: pow(g, 3))), 1.0 / 3)",
    "hamming": f"CAST(list_sum(list_transform({_GAPS}, lambda g: CASE WHEN g > 0 THEN 1 ELSE 0 END)) AS DOUBLE)",
    "jaccard": f"1 - CAST(len(list_intersect({_X}, {_Y})) AS DOUBLE) / len(list_distinct(list_concat({_X}, {_Y})))",
    "pearson": f"1 - list_cosine_similarity(list_transform({_X}, lambda x: x - list_avg({_X})), list_transform({_Y}, lambda x: x - list_avg({_Y})))",
}


def _knn(metric: str) -> None:
    def run(db):
        near = db.tables["embeddings"].where("vec_id = 0").first()["embedding"]
        found = Query().from_table("embeddings").vector_search("embedding", near, 10, metric, key="vec_id").to_df(db)
        return found.select("vec_id", F.round("distance", 6).alias("distance"))

    run.__name__ = f"q_knn_{metric}"
    query(f"SELECT c.vec_id, round({_DISTANCES[metric]}, 6) AS distance FROM embeddings q, embeddings c WHERE q.vec_id = 0 ORDER BY {_DISTANCES[metric]}, c.vec_id LIMIT 10")(run)


for _m in _DISTANCES:
    _knn(_m)


@query(f"SELECT c.vec_id, round(1 - ({_DISTANCES['cosine']}), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id = 0")
def q_similarity_score(db):
    near = db.tables["embeddings"].where("vec_id = 0").first()["embedding"]
    rows = Query().select("vec_id").from_table("embeddings").similarity_score("embedding", near, "cosine", "score").to_df(db)
    return rows.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT q.vec_id AS query, c.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCES['euclidean']}, c.vec_id) AS INTEGER) AS rank FROM embeddings q, embeddings c WHERE q.vec_id < 5 AND q.vec_id <> c.vec_id QUALIFY rank <= 3")
def q_knn_join(db):
    asked = db.tables["embeddings"].where("vec_id < 5")
    return vector.knn_join(asked, db.tables["embeddings"], "embedding", 3, "euclidean", "vec_id").select("query", "vec_id", "rank")


@query(f"SELECT q.vec_id AS query, c.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCES['euclidean']}, c.vec_id) AS INTEGER) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id QUALIFY rank <= 3")
def q_knn_join_hundredth(db):
    asked = db.tables["embeddings"].where("vec_id % 100 = 0")
    return vector.knn_join(asked, db.tables["embeddings"], "embedding", 3, "euclidean", "vec_id").select("query", "vec_id", "rank")


@query(f"SELECT c.vec_id, round({_DISTANCES['euclidean']}, 6) AS distance FROM embeddings q, embeddings c WHERE q.vec_id = 0 ORDER BY {_DISTANCES['euclidean']}, c.vec_id LIMIT 10")
def q_knn_hashed(db):
    near = db.tables["embeddings"].where("vec_id = 0").first()["embedding"]
    found = Query().from_table("embeddings").vector_search_indexed("embedding", near, 10, key="vec_id").to_df(db)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


def _nearest_sql(k: int, rows: str = "true") -> str:
    return f"SELECT q.vec_id AS query, c.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCES['euclidean']}, c.vec_id) AS INTEGER) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND {rows} QUALIFY rank <= {k}"


def _index(db, kind: type[VectorIndex], rows=None, unit: int = 128) -> VectorIndex:
    return kind(db.spark, scratch(db.spark, "vectors"), unit=unit).build(db.tables["embeddings"] if rows is None else rows, "vec_id", "embedding")


@query(_nearest_sql(5))
def q_vector_index_exact(db):
    """Graphs find rows nearby, and then only cells that may hold nearer ones are read."""
    rows = db.tables["embeddings"]
    found = _index(db, GraphIndex).search_many(rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 5, exact=True, but_own=True)
    return found.select("query", F.col("key").alias("vec_id"), "rank")


@query(_nearest_sql(5, "c.vec_id % 10 <> 7"))
def q_vector_index_changes(db):
    """Rows that come later, change or go: the index finds what a new one would."""
    rows = db.tables["embeddings"]
    turned = rows.withColumn("embedding", F.reverse("embedding"))
    index = _index(db, CodeIndex, rows.where("vec_id % 3 = 0").unionByName(turned.where("vec_id % 3 = 1")))
    index.append(rows.where("vec_id % 3 <> 0"), "vec_id", "embedding")
    index.delete(rows.where("vec_id % 10 = 7"), "vec_id")
    found = index.search_many(rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 5, exact=True, but_own=True)
    return found.select("query", F.col("key").alias("vec_id"), "rank")


def _recalled(db, index: VectorIndex):
    """How many queries there are, and whether the index finds nine in ten of their ten nearest rows."""
    rows = db.tables["embeddings"]
    asked = rows.where("vec_id % 100 = 0")
    true = vector.knn_join(asked, rows, "embedding", 10, "euclidean", "vec_id").select("query", "vec_id")
    found = index.search_many(asked, "vec_id", "embedding", 10, but_own=True).select("query", F.col("key").alias("vec_id"), F.lit(1).alias("hit"))
    return true.join(found, ["query", "vec_id"], "left").agg(F.countDistinct("query").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def q_vector_index_recall(db):
    return _recalled(db, _index(db, GraphIndex))


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def q_vector_codes_recall(db):
    return _recalled(db, _index(db, CodeIndex))


@query("SELECT vec_id, CAST(0 AS DOUBLE) AS distance FROM embeddings WHERE vec_id = 0")
def q_vector_search_indexed(db):
    """A query that a stored index of the table answers: the row itself is the nearest."""
    db.indexes["embeddings", "embedding"] = _index(db, GraphIndex)
    near = db.tables["embeddings"].where("vec_id = 0").first()["embedding"]
    found = Query().from_table("embeddings").vector_search_indexed("embedding", near, 10, key="vec_id", ef=40).order_by("distance").order_by("vec_id").first().to_df(db)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


# Full text

_TOKENS = f"list_filter(string_split_regex(translate(lower(text), '{fulltext.MARKED}', '{fulltext.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['the', 'this'])")
def q_fts_match(db):
    return Query().select("doc_id").from_table("documents").fulltext_search("text", "This THE").to_df(db)


@query(f"SELECT doc_id FROM documents WHERE list_has_any({_TOKENS}, ['der', 'que'])")
def q_fts_any(db):
    return Query().select("doc_id").from_table("documents").fulltext_search("text", "der que", any_=True).to_df(db)


@query(f"""
    WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
    f AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'this')) AS b FROM d),
    s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f)
    SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean))
                       + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
    FROM f, s WHERE a > 0 AND b > 0""")
def q_bm25(db):
    q = Query().select("doc_id", e.as_(e.round_("score", 6), "score")).from_table("documents").fulltext_search("text", "the this").search_score("score")
    return q.to_df(db)


_SCORED = ORACLE_SQL["q_bm25"]


@query(_SCORED)
def q_bm25_indexed(db):
    """The same scores by an inverted index: only the asked tokens' postings are read."""
    index = fulltext.TextIndex(db.spark, scratch(db.spark, "index")).build(db.tables["documents"], "doc_id", "text")
    return index.search("the this").select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_CHANGED = _SCORED.replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 7)", 1)


def _changed_index(db) -> fulltext.TextIndex:
    """An index whose texts came in three segments, were changed in part, and of which every tenth went."""
    docs = db.tables["documents"]
    upper = docs.withColumn("text", F.concat(F.lit("the this the this "), F.reverse("text")))
    index = fulltext.TextIndex(db.spark, scratch(db.spark, "index")).build(docs.where("doc_id % 4 < 2").unionByName(upper.where("doc_id % 4 = 2")), "doc_id", "text")
    index.append(docs.where("doc_id % 4 = 2 AND doc_id % 8 < 4"), "doc_id", "text")
    index.append(docs.where("doc_id % 4 = 3 OR (doc_id % 4 = 2 AND doc_id % 8 >= 4)"), "doc_id", "text")
    index.delete(docs.where("doc_id % 10 = 7"), "doc_id")
    return index


@query(_CHANGED)
def q_text_index_segments(db):
    return _changed_index(db).search("the this").select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"SELECT * FROM ({_CHANGED}) ORDER BY score DESC, doc_id LIMIT 10")
def q_text_index_top(db):
    """The ten best of changed segments, where most blocks are ruled out by their bounds."""
    best = _changed_index(db).top("the this", 10)
    return best.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""
    WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents)
    SELECT doc_id, CAST(list_position(t, 'the') - 1 AS INTEGER) AS first, len(list_filter(t, lambda x: x = 'the')) AS times FROM d WHERE list_contains(t, 'the')""")
def q_match_places(db):
    """Where a token stands in each text that has it."""
    index = fulltext.TextIndex(db.spark, scratch(db.spark, "index")).build(db.tables["documents"], "doc_id", "text")
    found = index.search("THE").select(F.col("key").alias("doc_id"), F.col("matches")[0]["places"].alias("p"))
    return found.select("doc_id", F.col("p")[0].alias("first"), F.size("p").cast("long").alias("times"))


@query("SELECT p_partkey, flatten(list_transform(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 2), lambda x: list_transform(range(2, CAST(least(4, length(x)) + 1 AS BIGINT)), lambda n: x[1:n]))) AS grams FROM part")
def q_analyzer_ngram(db):
    own = fulltext.Analyzer(("blank",), ("lowercase", ("edgengram", 2, 4)))
    return db.tables["part"].select("p_partkey", own.tokens(F.col("p_name")).alias("grams"))


@query("SELECT n_nationkey, ['the', 'Nation', n_name, 'sName'] AS tokens FROM nation")
def q_analyzer_camel(db):
    text = F.concat(F.lit("theNation "), F.col("n_name"), F.lit(" sName"))
    own = fulltext.Analyzer(("blank", "camel"), ())
    tokens = F.concat(F.slice(own.tokens(text), 1, 2), F.array("n_name"), F.array(F.array_join(F.slice(own.tokens(F.lit("sName")), 1, 2), "")))
    return db.tables["nation"].select("n_nationkey", tokens.alias("tokens"))


@query("SELECT n_nationkey, ['a', 'b', lower(n_name), 'c'] AS tokens FROM nation WHERE NOT regexp_matches(n_name, '[^A-Za-z]')")
def q_analyzer_punct(db):
    own = fulltext.Analyzer(("punct",), ("lowercase",))
    rows = db.tables["nation"].where("NOT rlike(n_name, '[^A-Za-z]')")
    return rows.select("n_nationkey", own.tokens(F.concat(F.lit("A,b. ("), F.col("n_name"), F.lit(")--C!"))).alias("tokens"))


@query("SELECT p_partkey, flatten(list_transform(range(2, CAST(least(3, length(p_brand)) + 1 AS BIGINT)), lambda n: list_transform(range(1, CAST(length(p_brand) - n + 2 AS BIGINT)), lambda i: substr(lower(p_brand), i, n)))) AS grams FROM part")
def q_analyzer_ngrams(db):
    own = fulltext.Analyzer(("blank",), ("lowercase", ("ngram", 2, 3)))
    return db.tables["part"].select("p_partkey", own.tokens(F.col("p_brand")).alias("grams"))


@query("SELECT * FROM (VALUES ('run'), ('connect'), ('generous'), ('hope'), ('tie'), ('nation'), ('sky'), ('feed')) v(stem)")
def q_analyzer_snowball(db):
    own = fulltext.Analyzer(("blank",), ("lowercase", "snowball"))
    one = db.spark.range(1).select(own.tokens(F.lit("Running connections generously hoping ties nationally skies feed")).alias("t"))
    return one.select(F.explode("t").alias("stem"))


@query("""
    WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part),
    b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part)
    SELECT p_partkey, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def q_rank_fusion_whole(db):
    """Rankings of any length, numbered range by range."""
    rows = db.tables["part"]
    rankings = [rows.select("p_partkey", F.col(c).cast("double").alias("by")) for c in ("p_retailprice", "p_size")]
    return fulltext.fused(rankings, "p_partkey", "by", most=None).select("p_partkey", F.round("score", 9).alias("score"))


@query("""
    WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part QUALIFY r <= 1000),
    b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part QUALIFY r <= 1000)
    SELECT p_partkey, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def q_rank_fusion(db):
    rows = db.tables["part"]
    rankings = [rows.select("p_partkey", F.col(c).cast("double").alias("by")) for c in ("p_retailprice", "p_size")]
    return fulltext.fused(rankings, "p_partkey", "by").select("p_partkey", F.round("score", 9).alias("score"))


# Views and permissions


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY 1")
def q_view_grouped(db):
    db.views["large"] = Query().select("event_type", e.as_(e.count(), "n")).from_table("events").where_(p.gt("value", 10)).group_by("event_type")
    return Query().from_table("large").to_df(db)


@query("SELECT key, count(*) AS n FROM (SELECT o_orderkey AS key FROM orders UNION ALL SELECT l_orderkey FROM lineitem) GROUP BY 1")
def q_multi_source_view(db):
    db.tables["a"] = db.tables["orders"].select(F.col("o_orderkey").alias("key"))
    db.tables["b"] = db.tables["lineitem"].select(F.col("l_orderkey").alias("key"), "l_quantity")
    return Query().select("key", e.as_(e.count(), "n")).from_table("a", "b").group_by("key").to_df(db)


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def q_permissions(db):
    db.permissions["customer"] = p.eq("c_mktsegment", "BUILDING")
    return Query().select("c_custkey").from_table("customer").where_(p.gt("c_acctbal", 0)).to_df(db)


@query("SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 100 GROUP BY n_name")
def q_raw_sql(db):
    return db.sql("SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > :least GROUP BY n_name", {"least": 100})


# Changes


@query("SELECT c_custkey, CASE WHEN c_custkey <= 10 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT 10000000, 'added'")
def q_upsert(db):
    own = db.tables["customer"].select("id", "c_custkey", "c_name")
    rows = own.where("c_custkey <= 10").withColumn("c_name", F.lit("new")).unionByName(own.sparkSession.createDataFrame([("customer:10000000", 10000000, "added")], own.schema))
    return dml.upsert(own, rows).drop("id")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(floor(c_acctbal) AS BIGINT) END AS was FROM customer")
def q_update_expr(db):
    out = dml.update(db.tables["customer"], {"c_acctbal": field("c_acctbal") * 2, "was": e.floor("c_acctbal")}, p.eq("c_mktsegment", "BUILDING"))
    return out.select("c_custkey", "c_acctbal", "was")


@query("SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS c_name FROM customer")
def q_merge(db):
    patch = db.tables["customer"].where("c_custkey % 2 = 0").select("id", F.lit(None).cast("string").alias("c_name"))
    return dml.merge(db.tables["customer"], patch).select("c_custkey", "c_acctbal", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0)")
def q_delete_where(db):
    return dml.delete(db.tables["customer"], p.lt("c_acctbal", 0)).select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (0, 1)")
def q_cascade_delete(db):
    nations = db.tables["nation"].withColumn("region", record_id("region", "n_regionkey"))
    _, others = dml.delete_referenced(db.tables["region"], "r_regionkey < 2", {"nation": (nations, "region", "cascade")})
    return others["nation"].select("n_nationkey")


@query("SELECT 'customer:1' AS \"in\", 'orders:' || o_orderkey AS out FROM orders WHERE o_orderkey <= 3 UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey FROM orders WHERE o_orderkey > 5")
def q_relate(db):
    pairs = db.tables["orders"].where("o_orderkey <= 3").select(F.lit("customer:1").alias("in"), F.col("id").alias("out"))
    edges = db.tables["placed"].where("cast(substring_index(out, ':', -1) as long) > 5")
    return dml.relate(edges, pairs, db.tables["customer"], db.tables["orders"])


@query("SELECT 'customer:' || c_custkey AS id, 'c_acctbal' AS field FROM customer WHERE c_acctbal < 0")
def q_return_diff(db):
    own = db.tables["customer"]
    return dml.returned(own, dml.update(own, {"c_acctbal": 0.0}, p.lt("c_acctbal", 0)), dml.DIFF).select("id", "field")


_FORMS = "SELECT 'customer:' || c_custkey AS id, c_acctbal FROM customer WHERE c_acctbal < 0"


@query(f"""
    SELECT 'before' AS form, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM ({_FORMS})
    UNION ALL SELECT 'after', count(*), 0.0 FROM ({_FORMS}) UNION ALL SELECT 'full', count(*), round(sum(c_acctbal), 2) FROM ({_FORMS})
    UNION ALL SELECT 'none', 0, 0.0""")
def q_return_forms(db):
    own = db.tables["customer"]
    new = dml.update(own, {"c_acctbal": 0.0}, p.lt("c_acctbal", 0))
    out = None
    for form in (dml.BEFORE, dml.AFTER, dml.FULL, dml.NONE):
        rows = dml.returned(own, new, form)
        value = F.col("before.c_acctbal") if form == dml.FULL else F.col("c_acctbal")
        one = rows.agg(F.lit(form).alias("form"), F.count("*").alias("n"), F.coalesce(F.round(F.sum(value), 2), F.lit(0.0)).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (1, 2, 3, 99)")
def q_delete_many(db):
    ids = db.spark.createDataFrame([(f"customer:{k}",) for k in (1, 2, 3, 99, 10**9)], "id string")
    return dml.delete_ids(db.tables["customer"], ids).select("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 'changed' END AS c_name, CASE WHEN c_custkey = 5 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey IN (5, 6)")
def q_replace_record(db):
    own = db.tables["customer"].select("id", "c_custkey", "c_acctbal", F.lit(None).cast("string").alias("c_name"))
    rows = db.spark.createDataFrame([("customer:5", 5, "changed"), ("customer:1000000000", 0, "nobody")], "id string, c_custkey long, c_name string")
    return dml.replace(own, rows).where("c_custkey IN (5, 6) OR c_name = 'nobody'").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_custkey, CAST(NULL AS VARCHAR) AS customer, count(*) AS n FROM orders WHERE o_custkey < 5 GROUP BY 1 UNION ALL SELECT o_custkey, 'customer:' || o_custkey, count(*) FROM orders WHERE o_custkey >= 5 GROUP BY 1")
def q_reference_unset(db):
    orders = db.tables["orders"].withColumn("customer", record_id("customer", "o_custkey"))
    _, others = dml.delete_referenced(db.tables["customer"], "c_custkey < 5", {"orders": (orders, "customer", "unset")})
    return others["orders"].groupBy("o_custkey", "customer").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM orders WHERE o_custkey = 7) > 0 AS rejected")
def q_reference_reject(db):
    orders = db.tables["orders"].withColumn("customer", record_id("customer", "o_custkey"))
    try:
        dml.delete_referenced(db.tables["customer"], "c_custkey = 7", {"orders": (orders, "customer", "reject")})
        rejected = False
    except dml.Rejected:
        rejected = True
    return db.spark.createDataFrame([(rejected,)], "rejected boolean")


@query("SELECT r_regionkey, list_filter(list_transform(k, lambda x: 'nation:' || x), lambda x: x NOT IN ('nation:0', 'nation:1', 'nation:2')) AS nations FROM (SELECT r_regionkey, (SELECT coalesce(list(n_nationkey ORDER BY 'nation:' || n_nationkey), []) FROM nation WHERE n_regionkey = r_regionkey) AS k FROM region)")
def q_reference_arrays(db):
    """Links in arrays are joined link by link."""
    of = db.tables["nation"].groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list("id")).alias("nations"))
    regions = db.tables["region"].join(of, "r_regionkey", "left").withColumn("nations", F.coalesce("nations", F.array().cast("array<string>")))
    _, others = dml.delete_referenced(db.tables["nation"], "n_nationkey < 3", {"region": (regions, "nations", "unset")})
    return others["region"].select("r_regionkey", "nations")


@query("""
    WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c))
    SELECT 'nation' AS name, count(*) AS n FROM n UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'orders', count(*) FROM o""")
def q_cascade_deep(db):
    """What refers to what was deleted goes, too, until nothing more does."""
    link = lambda name, to, key: db.tables[name].withColumn("link", record_id(to, key))
    referrers = {"nation": (link("nation", "region", "n_regionkey"), "link", "cascade"), "customer": (link("customer", "nation", "c_nationkey"), "link", "cascade", "nation"), "orders": (link("orders", "customer", "o_custkey"), "link", "cascade", "customer")}
    _, others = dml.delete_referenced(db.tables["region"], "r_regionkey = 0", referrers)
    out = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in others.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT DISTINCT 'orders:' || o_orderkey AS out FROM orders WHERE o_custkey = 5 AND o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 5)")
def q_remove_relation(db):
    own = db.tables["placed"].where(F.col("in") == "customer:5")
    key = db.tables["orders"].where("o_custkey = 5").agg(F.min("o_orderkey")).first()[0]
    return dml.unrelate(own, "customer:5", f"orders:{key}").select("out")


@query("SELECT 'part:' || (p_partkey + 3) AS node FROM part WHERE p_partkey IN (1, 2, 10)")
def q_traverse_depth(db):
    """Three hops along a chain of parts."""
    chain = db.tables["part"].select(record_id("part", "p_partkey").alias("in"), record_id("part", F.col("p_partkey") + 1).alias("out"))
    at = db.tables["part"].where("p_partkey IN (1, 2, 10)")
    return graph.hop(graph.starts(at), chain, graph.OUT, 3).select("node")


@query("SELECT c_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 7")
def q_graph_incoming(db):
    return graph.GraphQuery("orders:7").in_("placed").to("customer").select("c_custkey", "c_name").to_df(db.tables)


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey = 11")
def q_graph_fetch(db):
    db.tables["orders"] = db.tables["orders"].withColumn("customer", record_id("customer", "o_custkey"))
    found = graph.GraphQuery("customer:11").out("placed").to("orders").fetch("customer", "customer").to_df(db.tables)
    return found.select("o_orderkey", F.col("customer.c_name").alias("c_name"))


@query("SELECT least(3, count(*)) AS n, count(*) AS whole, count(*) > 0 AS some FROM orders WHERE o_custkey = 11")
def q_graph_limit_count(db):
    q = graph.GraphQuery("customer:11").out("placed")
    return db.spark.createDataFrame([(q.limit(3).to_df(db.tables).count(), q.count(db.tables), q.exists(db.tables))], "n long, whole long, some boolean")


@query(f"""
    WITH RECURSIVE e AS (SELECT DISTINCT 'orders:' || l_orderkey AS a, 'part:' || l_partkey AS b FROM lineitem),
    s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r(node, hops) AS (SELECT 'orders:' || o_orderkey, 0 FROM orders WHERE o_custkey = 11 UNION SELECT s.b, hops + 1 FROM r JOIN s ON s.a = r.node WHERE hops < 2)
    SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY node""")
def q_reachable_from_many(db):
    at = [r["id"] for r in db.tables["orders"].where("o_custkey = 11").select("id").collect()]
    return graph.distances(db.tables["contains"], at, 2, graph.BOTH)


@query("""
    WITH e AS (SELECT l_orderkey AS o, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY ALL),
    one AS (SELECT p, n FROM e WHERE o = 1),
    two AS (SELECT e.o, sum(one.n * e.n) AS n FROM one JOIN e USING (p) GROUP BY 1),
    three AS (SELECT e.p, sum(two.n * e.n) AS n FROM two JOIN e USING (o) GROUP BY 1)
    SELECT 'orders:' || e.o AS node, CAST(sum(three.n * e.n) AS BIGINT) AS paths FROM three JOIN e USING (p) GROUP BY 1""")
def q_paths_counted(db):
    """How many paths of four hops lead from an order to each order that shares parts with it: numbers, not rows."""
    at = db.tables["orders"].where("o_orderkey = 1")
    return graph.counted(graph.starts(at), db.tables["contains"], graph.BOTH, 4).select("node", "paths")


@query("""
    WITH e AS (SELECT l_orderkey AS o, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY ALL),
    two AS (SELECT e.o, sum(one.n * e.n) AS n FROM e one JOIN e USING (p) WHERE one.o = 1 GROUP BY 1)
    SELECT 'part:' || e.p AS node, CAST(sum(two.n * e.n) AS BIGINT) AS times FROM two JOIN e USING (o) GROUP BY 1""")
def q_paths_repeated(db):
    """The same by rows: a node is there once for every path of three hops."""
    found = graph.GraphQuery("orders:1").out("contains").in_("contains").out("contains").to_df(db.tables)
    return found.groupBy("node").agg(F.count("*").alias("times"))


@query("""
    WITH RECURSIVE e AS (
      SELECT 'customer:' || o_custkey AS a, 'orders:' || o_orderkey AS b FROM orders
      UNION SELECT 'orders:' || l_orderkey, 'part:' || l_partkey FROM lineitem),
    s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(node, hops) AS (SELECT 'customer:11', 0 UNION SELECT s.b, hops + 1 FROM r JOIN s ON s.a = r.node WHERE hops < 4)
    SELECT node, CAST(min(hops) AS INTEGER) AS hops, true AS along_edges FROM r WHERE node IN ('customer:1', 'customer:2', 'part:7') GROUP BY node""")
def q_shortest_paths_both_ends(db):
    """Least hops along edges in either direction, by frontiers from both ends; each path's edges exist."""
    e = db.tables["placed"].unionByName(db.tables["contains"])
    both = e.unionByName(e.select(F.col("out").alias("in"), F.col("in").alias("out")))
    steps = None
    for end in ("customer:1", "customer:2", "part:7"):
        own = graph.shortest(both, "customer:11", end, 4).select(F.lit(end).alias("node"), "hops", F.explode("edges").alias("edge"))
        steps = own if steps is None else steps.unionByName(own)
    steps = cut(steps)  # a row for each hop
    known = both.select(F.struct("in", "out").alias("edge")).join(F.broadcast(steps.select("edge").distinct()), "edge").distinct()
    return steps.join(known, "edge", "left_semi").groupBy("node", "hops").agg((F.count("*") == F.col("hops")).alias("along_edges"))


@query("""
    WITH a AS (SELECT l_orderkey AS o, list(l_partkey ORDER BY l_linenumber, l_partkey) || [-1] AS keys FROM lineitem GROUP BY 1)
    SELECT o, list(p_name ORDER BY place) AS names
    FROM (SELECT o, unnest(keys) AS k, unnest(range(len(keys))) AS place FROM a) LEFT JOIN part ON p_partkey = k GROUP BY o""")
def q_fetch_array(db):
    """An order's parts in the order of its lines, repeats among them, in place of an array of links; one link has no record."""
    links = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("part:"), x["l_partkey"].cast("string")))
    rows = db.tables["lineitem"].groupBy(F.col("l_orderkey").alias("o")).agg(F.concat(links, F.array(F.lit("part:-1"))).alias("parts"))
    found = graph.fetch(rows, "parts", db.tables["part"].select("id", "p_name"))
    return found.select("o", F.transform("parts", lambda x: x["p_name"]).alias("names"))


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def q_fetch_path(db):
    """A link inside a record that was fetched."""
    customers = db.tables["customer"].select("id", record_id("nation", "c_nationkey").alias("nation"))
    rows = db.tables["orders"].select("o_orderkey", record_id("customer", "o_custkey").alias("customer"))
    both = graph.fetch(graph.fetch(rows, "customer", customers), "customer.nation", db.tables["nation"].select("id", "n_name"))
    return both.select("o_orderkey", F.col("customer.nation.n_name").alias("n_name"))


# Definitions, typed rows, results and helpers


@query("SELECT 'customer:' || c_custkey AS id, c_name AS name, CAST(trunc(c_acctbal) AS BIGINT) AS balance, 'active' AS state, upper(c_name) AS loud FROM customer")
def q_schema_enforce(db):
    kind = schema.table("customer", schema.string_field("name"), schema.int_field("balance"), schema.string_field("state", default=F.lit("active")), schema.computed_field("loud", e.upper("name"), "string"))
    rows = db.tables["customer"].select("id", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("not defined").alias("other"))
    return schema.enforce(rows, kind)


@query("SELECT 'by_nation' AS \"index\", count(*) AS keys, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1)")
def q_schema_violations(db):
    kind = schema.TableDef("customer", indexes=(schema.Index("by_nation", ("c_nationkey",), "unique"), schema.Index("by_key", ("c_custkey",), "unique")))
    return schema.violations(db.tables["customer"], kind).groupBy("index").agg(F.count("*").alias("keys"), F.sum("n").alias("n"))


@query("SELECT * FROM (VALUES ('second key refused', true), ('null keys allowed', true), ('row replaced', true)) v(what, holds)")
def q_unique_enforced(db):
    kind = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])
    table = Table(db.spark, scratch(db.spark, "unique"), kind, unique=(("name",),))
    rows = lambda *x: db.spark.createDataFrame(x, kind)
    table.insert(rows(("n:1", "a"), ("n:2", None), ("n:3", None)))
    try:
        table.insert(rows(("n:4", "a")))
        refused = False
    except ValueError:
        refused = True
    table.upsert(rows(("n:1", "b"), ("n:5", "a")))
    got = {r.id: r.name for r in table.read().collect()}
    facts = [("second key refused", refused), ("null keys allowed", got["n:2"] is None and got["n:3"] is None), ("row replaced", got["n:1"] == "b" and got["n:5"] == "a")]
    return db.spark.createDataFrame(facts, "what string, holds boolean")


@query("SELECT n_nationkey, (SELECT coalesce(list(c_custkey ORDER BY c_custkey), []) FROM customer WHERE c_nationkey = n_nationkey) AS customers, n_nationkey * 2 AS twice FROM nation WHERE n_regionkey = 1")
def q_computed_on_read(db):
    """A reverse reference, a field and a permission, all on reading."""
    kind = schema.table("nation", schema.reverse_reference_field("customers", "customer", "nation", "c_custkey"), schema.Field("twice", "int", computed="n_nationkey * 2"), permission="n_regionkey = 1")
    customers = db.tables["customer"].withColumn("nation", record_id("nation", "c_nationkey"))
    return schema.on_read(db.tables["nation"], kind, {"customer": customers}).select("n_nationkey", "customers", "twice")


@query("SELECT * FROM (VALUES ('add table', 'b', ''), ('drop field', 'a', 'old'), ('modify field', 'a', 'n'), ('add function', '', 'fn::twice'), ('drop sequence', '', 'ids'), ('modify analyzer', '', 'plain')) v(kind, \"table\", name)")
def q_schema_differences(db):
    old, new = schema.Registry(), schema.Registry()
    old.register(schema.table("a", schema.string_field("n"), schema.string_field("old")))
    new.register(schema.table("a", schema.int_field("n")), schema.table("b"))
    old.define("sequence", "ids", {"batch": 10})
    new.define("function", "fn::twice", schema.FunctionDef("fn::twice", (("x", "int"),), "x * 2", "int"))
    old.define("analyzer", "plain", fulltext.STANDARD)
    new.define("analyzer", "plain", fulltext.Analyzer(("blank",)))
    return db.spark.createDataFrame([(c.kind, c.table, c.name) for c in old.changes_to(new)], "kind string, table string, name string")


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 2 + 1 AS BIGINT) AS y FROM lineitem")
def q_defined_function(db):
    name = schema.FunctionDef("fn::odd", (("x", "int"),), "x * 2 + 1", "int").create(db.spark)
    return db.tables["lineitem"].select("l_orderkey", "l_linenumber", F.call_function(name, F.col("l_linenumber").cast("long")).alias("y"))


@query("SELECT n_regionkey, count(*) AS n, CAST(max(n_nationkey) AS BIGINT) AS top FROM nation WHERE n_nationkey > 2 GROUP BY 1 ORDER BY n DESC, n_regionkey LIMIT 3")
def q_aggregate_options(db):
    opts = helpers.AggregateOpts({"n": e.count(), "top": e.cast(e.max_("n_nationkey"), "int")}, ("n_regionkey",), (p.gt("n_nationkey", 2),), (("n", "DESC"), ("n_regionkey", "ASC")), 3)
    return helpers.aggregate_records(db, "nation", opts)


@query(f"SELECT c.vec_id, round({_DISTANCES['manhattan']}, 6) AS distance FROM embeddings q, embeddings c WHERE q.vec_id = 1 ORDER BY {_DISTANCES['manhattan']}, c.vec_id LIMIT 5")
def q_helper_search(db):
    near = db.tables["embeddings"].where("vec_id = 1").first()["embedding"]
    found = helpers.vector_search_query("embeddings", "embedding", near, 5, "manhattan", ("vec_id",), key="vec_id").to_df(db)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 5 OFFSET 2")
def q_helper_functions(db):
    q = helpers.where_(helpers.from_table(helpers.select("o_orderkey"), "orders"), p.gt("o_totalprice", 1000))
    return helpers.offset(helpers.limit(helpers.order_by(q, "o_orderkey"), 5), 2).to_df(db)


@dataclass(frozen=True)
class _Nation:
    n_nationkey: int
    n_name: str
    note: str = "none"


@query("SELECT n_nationkey, n_name, 'none' AS note FROM nation WHERE n_regionkey = 2")
def q_typed_rows(db):
    """Rows read as objects and written again by their schema."""
    found = results.typed(db.tables["nation"].where("n_regionkey = 2"), _Nation)
    return results.rows_of(db.spark, found, T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("note", T.StringType())]))


@query("""
    SELECT 'page 2 of 7' AS what, CAST(least(7, greatest(0, count(*) - 7)) AS BIGINT) AS n FROM nation UNION ALL SELECT 'pages', CAST(ceil(count(*) / 7) AS BIGINT) FROM nation
    UNION ALL SELECT 'counted', count(*) FROM nation UNION ALL SELECT 'more', CAST(count(*) > 4 AS BIGINT) FROM nation UNION ALL SELECT 'exists', count(*) FROM nation WHERE n_nationkey = 3
    UNION ALL SELECT 'scalar', CAST(max(n_nationkey) AS BIGINT) FROM nation UNION ALL SELECT 'related', count(*) FROM orders WHERE o_custkey = 5""")
def q_results(db):
    """Pages, counts, scalars and existence, on the driver."""
    q = Query().from_table("nation").order_by("n_nationkey")
    page = results.paged(q, db, 2, 7)
    top = results.scalar(db.tables["nation"].agg(F.max("n_nationkey").alias("top")), "top")
    rows = [("page 2 of 7", len(page.rows)), ("pages", page.pages), ("counted", results.count_records(db, "nation")), ("more", int(results.listed(q.limit(4), db).has_more)), ("exists", int(results.exists(db, "nation:3"))), ("scalar", int(top)), ("related", graph.count_related(db.tables["placed"], "customer:5"))]
    return db.spark.createDataFrame(rows, "what string, n long")


@query("SELECT * FROM (VALUES ('customer', 'x'), ('a', 'b c'), ('n', '7'), ('t', 'x:y')) v(name, key)")
def q_record_ids(db):
    found = [RecordId.parse(str(RecordId(t, k))) for t, k in (("customer", "x"), ("a", "b c"), ("n", 7), ("t", "x:y"))]
    return db.spark.createDataFrame([(r.table, str(r.key)) for r in found], "name string, key string")


@query("SELECT * FROM (VALUES (1, 'object', true), (2, 'text', true), (3, 'number', true), (4, 'none', false)) v(k, kind, known)")
def q_type_is_variant(db):
    rows = db.spark.createDataFrame([(1, '{"a": 1}'), (2, '"x"'), (3, "1.5"), (4, None)], "k int, j string")
    db.tables["v"] = rows.select("k", F.parse_json("j").alias("x"))
    found = Query().select("k", e.as_(e.type_is("x", "string"), "text"), e.as_(e.type_is("x", "number"), "number")).from_table("v").to_df(db)
    kind = F.when(F.col("k") == 4, "none").when(F.col("text"), "text").when(F.col("number"), "number").otherwise("object")
    return found.select("k", kind.alias("kind"), (F.col("k") < 4).alias("known"))


@query("SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events) ORDER BY value DESC NULLS LAST, event_id DESC LIMIT 1")
def q_last_with_nulls(db):
    db.tables["e"] = db.tables["events"].withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return Query().select("event_id", "value").from_table("e").order_by("value").order_by("event_id").last().to_df(db)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def q_hints(db):
    q = Query().select("o_orderstatus", e.as_(e.count(), "n")).from_table("orders").group_by("o_orderstatus")
    return q.hint(hints.Parallel(8), hints.Index("orders", "by_status")).to_df(db)


@query("SELECT n_regionkey, count(*) AS n, 1 AS hits, 2 AS misses FROM nation GROUP BY 1")
def q_cached(db):
    """The second call takes the kept frame; after the table is invalidated it is made anew."""
    kept = Cache()
    make = lambda: db.tables["nation"].groupBy("n_regionkey").agg(F.count("*").alias("n"))
    for k in range(3):
        out = kept.get_or_set("by_region", make, ["nation"])
        if k == 1:
            kept.invalidate_table("nation")
    return out.withColumns({"hits": F.lit(kept.hits), "misses": F.lit(kept.misses)})


# Files, sequences and transactions


@query("SELECT * FROM (VALUES ('a/one.txt', 3), ('a/two.txt', 3), ('three.txt', 5)) v(key, size)")
def q_files(db):
    """Files written, copied, renamed and deleted; what is left, by a listing."""
    own = Bucket(db.spark, scratch(db.spark, "bucket"))
    own.put("a/one.txt", "one")
    own.copy("a/one.txt", "a/two.txt")
    own.put("b.txt", "three")
    own.rename("b.txt", "three.txt")
    own.put("gone.txt", b"x")
    own.delete("gone.txt")
    rows = own.files("*.txt").select(F.regexp_extract("path", r"bucket-[0-9a-f]+/(.*)$", 1).alias("key"), F.col("length").cast("int").alias("size"))
    return rows


@query("SELECT * FROM (VALUES ('put', false, 'old'), ('copy', false, 'old'), ('rename', false, 'old'), ('new', true, 'new')) v(what, done, text)")
def q_files_if_not_exists(db):
    """What exists is left alone."""
    own = Bucket(db.spark, scratch(db.spark, "bucket"))
    own.put("old", "old")
    own.put("other", "new")
    done = [("put", own.put_if_not_exists("old", "new")), ("copy", own.copy_if_not_exists("other", "old")), ("rename", own.rename_if_not_exists("other", "old")), ("new", own.put_if_not_exists("new", "new"))]
    texts = [own.get_text("old")] * 3 + [own.get_text("new")]
    return db.spark.createDataFrame([(*d, t) for d, t in zip(done, texts, strict=True)], "what string, done boolean, text string")


@query("SELECT count(*) AS n, CAST(1 AS BIGINT) AS low, count(*) AS kinds FROM orders")
def q_sequence(db):
    """A number of its own for every order, from a sequence that another writer draws from, too."""
    numbers = Sequence(Bucket(db.spark, scratch(db.spark, "numbers")), "ids", batch=10)
    found = numbers.number(db.tables["orders"].select("o_orderkey"))
    return found.agg(F.count("*").alias("n"), F.min("number").alias("low"), F.count_distinct("number").alias("kinds"))


# Tables with history, feeds and streams

_EVENTS = T.StructType([T.StructField("id", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def _history(db) -> Table:
    """Events in three commits: all, then errors without a value, then no clicks."""
    out = Table(db.spark, scratch(db.spark, "events"), _EVENTS, originals=True)
    out.insert(db.tables["events"].select(record_id("events", "event_id").alias("id"), "event_type", "value"))
    out.update({"value": F.lit(None)}, p.eq("event_type", "error"))
    out.delete(p.eq("event_type", "click"))
    return out


@query("SELECT 'events:' || event_id AS id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events WHERE event_type <> 'click'")
def q_table_history(db):
    return _history(db).read().select("id", "value")


@query("SELECT 'events:' || event_id AS id, value FROM events")
def q_time_travel(db):
    return _history(db).read(1).select("id", "value")


@query("SELECT 'events:' || event_id AS id, CASE WHEN event_type = 'view' THEN -1.0 WHEN event_type <> 'error' THEN value END AS value FROM events WHERE event_type <> 'click' UNION ALL SELECT 'events:new', 1.0")
def q_transaction(db):
    """Three statements that count together."""
    table = _history(db)
    new = db.spark.createDataFrame([("events:new", "new", 1.0)], _EVENTS)
    one = Transaction(table).run(dml.insert, new).run(dml.update, {"value": -1.0}, p.eq("event_type", "view"))
    one.commit()
    return table.read().select("id", "value")


@query("SELECT 'rolled back' AS what, count(*) AS n FROM events WHERE event_type <> 'click' UNION ALL SELECT 'refused', count(*) FROM events WHERE event_type <> 'click' AND event_type <> 'error'")
def q_transaction_conflict(db):
    """A rolled back transaction leaves nothing; of two at the same version the second is refused."""
    table = _history(db)
    Transaction(table).run(dml.delete).rollback()
    rolled = table.read().count()
    first, second = Transaction(table), Transaction(table)
    first.run(dml.delete, p.eq("event_type", "error")).commit()
    try:
        second.run(dml.delete).commit()
    except Conflict:
        pass
    return db.spark.createDataFrame([("rolled back", rolled), ("refused", table.read().count())], "what string, n long")


@query("SELECT 'events:' || event_id AS id, CASE WHEN event_type = 'view' THEN 0.0 WHEN event_type <> 'error' THEN value END AS value FROM events WHERE event_type <> 'click'")
def q_snapshot_expire(db):
    """Commits before a snapshot go, and reads go on from it."""
    table = _history(db)
    table.update({"value": F.lit(0.0)}, p.eq("event_type", "view"))
    table.expire(1)
    return table.read().select("id", "value")


@query("SELECT 'nation' AS name, count(*) FILTER (n_regionkey <> 0) AS n FROM nation UNION ALL SELECT 'customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0")
def q_table_cascade(db):
    """Tables that refer to each other: a deletion goes on through them."""
    link = T.StructType([T.StructField("id", T.StringType()), T.StructField("link", T.StringType())])
    make = lambda name, **more: Table(db.spark, scratch(db.spark, name), link, originals=True, **more)
    customers = make("customers")
    nations = make("nations", references={"customer": (customers, "link", "cascade")})
    regions = make("regions", references={"nation": (nations, "link", "cascade")})
    customers.insert(db.tables["customer"].select("id", record_id("nation", "c_nationkey").alias("link")))
    nations.insert(db.tables["nation"].select("id", record_id("region", "n_regionkey").alias("link")))
    regions.insert(db.tables["region"].select("id", F.lit(None).cast("string").alias("link")))
    regions.delete(p.eq("id", "region:0"))
    out = [t.read().agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in (("nation", nations), ("customer", customers))]
    return out[0].unionByName(out[1])


_LINK = T.StructType([T.StructField("id", T.StringType()), T.StructField("link", T.StringType())])


def _linked_store(db) -> Store:
    """Regions, nations and customers, each with a link to the one above, that change together."""
    store = Store(db.spark, scratch(db.spark, "store"))
    customers = store.table("customer", _LINK, originals=True)
    nations = store.table("nation", _LINK, originals=True, references={"customer": (customers, "link", "cascade")})
    store.table("region", _LINK, originals=True, references={"nation": (nations, "link", "cascade")})
    above = {"customer": record_id("nation", "c_nationkey"), "nation": record_id("region", "n_regionkey"), "region": F.lit(None).cast("string")}
    one = Work(store)
    for name, link in above.items():
        one.insert(name, db.tables[name].select("id", link.alias("link")))
    one.commit()
    return store


def _rows_of(store: Store):
    out = [t.read().agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in store.tables.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT 'region' AS name, count(*) - 1 AS n FROM region UNION ALL SELECT 'nation', count(*) FILTER (n_regionkey <> 0) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0")
def q_store_cascade(db):
    """A deletion that goes through three tables is one commit."""
    store = _linked_store(db)
    store.tables["region"].delete(p.eq("id", "region:0"))
    if store.version() != 2:
        raise AssertionError("more than one commit")
    return _rows_of(store)


@query("""
    SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) - 1 FROM nation
    UNION ALL SELECT 'customer', count(*) FILTER (c_nationkey <> 1 AND c_custkey % 7 <> 0) FROM customer""")
def q_store_transactions(db):
    """Writers of different rows both succeed, over snapshots; one that has read what another changed is refused, and leaves nothing."""
    store = _linked_store(db)
    store.tables["customer"].snapshot()
    first, second, third = Work(store), Work(store), Work(store)
    first.delete("customer", "cast(substring_index(id, ':', -1) AS int) % 7 = 0 AND link <> 'nation:1'")
    second.delete("customer", p.eq("link", "nation:1"))
    second.delete("nation", p.eq("id", "nation:1"))
    third.update("nation", {"link": "region:9"}, p.eq("id", "nation:1")).delete("region")
    first.commit()
    try:
        second.commit()
    except Conflict:  # its deletion of a nation read every customer, to see which ones go
        Work(store).delete("nation", p.eq("id", "nation:1")).commit()
    try:
        third.commit()
    except Conflict:
        pass
    return _rows_of(store)


@query("""
    SELECT who, count(*) FILTER (NOT (who = 'BUILDING' AND k % 3 = 0)) AS seen, CAST(sum(changed) FILTER (NOT (who = 'BUILDING' AND k % 3 = 0)) AS BIGINT) AS changed, sum(placed) FILTER (NOT (who = 'BUILDING' AND k % 3 = 0)) AS placed
    FROM (SELECT c_custkey AS k, c_mktsegment AS who, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS changed, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS placed FROM customer)
    WHERE who IN ('BUILDING', 'MACHINERY') GROUP BY who""")
def q_caller_session(db):
    """Two callers see, change and follow different rows of the same tables; neither may write the other's."""
    kind = T.StructType([T.StructField("id", T.StringType()), T.StructField("segment", T.StringType()), T.StructField("k", T.LongType()), T.StructField("changed", T.LongType())])
    table = Table(db.spark, scratch(db.spark, "customers"), kind, originals=True)
    table.insert(db.tables["customer"].select("id", F.col("c_mktsegment").alias("segment"), F.col("c_custkey").cast("long").alias("k"), F.lit(0).cast("long").alias("changed")))
    own = lambda caller: p.eq("segment", caller["segment"])
    rules = {"customer": {"select": own, "create": own, "update": own, "delete": own}}
    one, two = (Session(db, {"segment": s}, rules, {"customer": table}) for s in ("BUILDING", "MACHINERY"))
    one.delete("customer", "k % 3 = 0")
    two.update("customer", {"changed": F.lit(1).cast("long")})
    for s in (one, two):
        try:
            s.insert("customer", db.spark.createDataFrame([("customer:-1", "FURNITURE", -1, 5)], kind))
        except Forbidden:
            continue
        raise AssertionError("a row of nobody's")
    out = None
    for s in (one, two):
        shown = s.read("customer").agg(F.count("*").alias("seen"), F.sum("changed").alias("changed"))
        placed = s.run(Query().from_table("customer").traverse("->placed->orders")).agg(F.count("*").alias("placed"))
        row = shown.join(F.broadcast(placed), F.lit(True)).select(F.lit(s.caller["segment"]).alias("who"), "seen", "changed", "placed")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS v FROM events WHERE event_type <> 'click' AND event_type <> 'error' GROUP BY 1")
def q_cached_by_plan(db):
    """The same plan twice is computed once; after a commit to its table it is another plan."""
    table, cache = _history(db), Cache()
    make = lambda: table.read().groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    first = cache.plan(make())
    if cache.plan(make()) is not first or (cache.hits, cache.misses) != (1, 1):
        raise AssertionError("an equal plan wasn't found")
    table.delete(p.eq("event_type", "error"))
    out = cache.plan(make())
    if cache.misses != 2:
        raise AssertionError("a commit wasn't seen")
    return out


@query("""
    SELECT 'before' AS at, count(*) AS n, count(value) AS v FROM events
    UNION ALL SELECT 'between', count(*), count(value) FILTER (event_type <> 'error') FROM events
    UNION ALL SELECT 'since', count(*), count(CASE WHEN event_type <> 'error' THEN value END) FROM events WHERE event_type = 'click' OR event_type = 'error'""")
def q_as_of_time(db):
    """Reads as of the times of commits, and the feed since one."""
    table = _history(db)
    when = table.times()
    out = [table.read(when[k]).agg(F.lit(n).alias("at"), F.count("*").alias("n"), F.count("value").alias("v")) for k, n in ((1, "before"), (2, "between"))]
    feed = table.changes(when[1])
    return out[0].unionByName(out[1]).unionByName(feed.agg(F.lit("since").alias("at"), F.count("*").alias("n"), F.expr("count(if(row IS NOT NULL, row.value, original.value))").alias("v")))


@query("SELECT 'events:' || event_id AS id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events WHERE event_type <> 'click' AND event_id % 500 = 3")
def q_snapshot_lookup(db):
    """Some rows, by a condition on their ids, which goes below what puts a snapshot and later changes together."""
    table = _history(db)
    table.snapshot(2)
    out = table.read().where("cast(substring_index(id, ':', -1) AS long) % 500 = 3")
    return out.select("id", "value")


@query("""
    SELECT CAST(1 AS BIGINT) AS version, 'create' AS action, count(*) AS n FROM events
    UNION ALL SELECT 2, 'update', count(*) FILTER (event_type = 'error') FROM events
    UNION ALL SELECT 3, 'delete', count(*) FILTER (event_type = 'click') FROM events""")
def q_changefeed(db):
    return _history(db).changes(1).groupBy("version", "action").agg(F.count("*").alias("n"))


@query("SELECT action, count(*) AS n FROM events, (SELECT unnest(['create', 'delete']) AS action) WHERE event_type = 'click' AND value > 20 GROUP BY action")
def q_live_query(db):
    table, name = _history(db), f"live_{abs(hash(scratch(db.spark, 'x')))}"
    stream = feeds.live(table, p.and_(p.eq("event_type", "click"), p.gt("value", 20))).select("action")
    running = stream.groupBy("action").agg(F.count("*").alias("n")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    return db.spark.table(name)


@query("""
    WITH e AS (SELECT event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events WHERE event_type <> 'click'
               AND NOT (event_type = 'view' AND value >= (SELECT max(value) FROM events WHERE event_type = 'view')))
    SELECT event_type, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, count(DISTINCT round(value)) AS kinds FROM e GROUP BY 1""")
def q_view_extremes(db):
    """Least, largest, mean and distinct values follow updates and the deletion of the extremes; groups that end go."""
    table = Table(db.spark, scratch(db.spark, "events"), _EVENTS, originals=True)
    table.insert(db.tables["events"].select(record_id("events", "event_id").alias("id"), "event_type", "value"))
    values = {"least": F.min("value"), "most": F.max("value"), "mean": F.round(F.avg("value"), 6), "kinds": F.count_distinct(F.round("value"))}
    view = feeds.QueryView({"e": table}, scratch(db.spark, "view"), lambda t: t["e"], ("event_type",), values)
    view.refresh()
    table.update({"value": F.lit(None)}, p.eq("event_type", "error"))
    top = table.read().where("event_type = 'view'").agg(F.max("value")).first()[0]
    table.delete(p.and_(p.eq("event_type", "view"), p.gte("value", top)))
    view.refresh()
    table.delete(p.eq("event_type", "click"))
    view.refresh()
    return view.read()


@query("SELECT c_mktsegment AS segment, count(*) AS n, max(o_totalprice) AS most, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 10 <> 3 AND o_orderkey % 7 <> 0 GROUP BY 1")
def q_view_of_join(db):
    """A view of a join, both of whose sides change before it follows."""
    kind = lambda *more: T.StructType([T.StructField("id", T.StringType()), *(T.StructField(n, t) for n, t in more)])
    customers = Table(db.spark, scratch(db.spark, "customers"), kind(("segment", T.StringType()), ("k", T.LongType())), originals=True)
    orders = Table(db.spark, scratch(db.spark, "orders"), kind(("customer", T.StringType()), ("price", T.DoubleType()), ("k", T.LongType())), originals=True)
    customers.insert(db.tables["customer"].select("id", F.when(F.col("c_custkey") % 5 == 0, "none").otherwise(F.col("c_mktsegment")).alias("segment"), F.col("c_custkey").alias("k")))
    orders.insert(db.tables["orders"].select("id", record_id("customer", "o_custkey").alias("customer"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderkey").alias("k")))
    joined = lambda t: t["o"].join(t["c"].select(F.col("id").alias("customer"), "segment"), "customer")
    view = feeds.QueryView({"o": orders, "c": customers}, scratch(db.spark, "view"), joined, ("segment",), {"n": F.count("*"), "most": F.max("price"), "customers": F.count_distinct("customer")})
    view.refresh()
    customers.merge(db.tables["customer"].where("c_custkey % 5 = 0").select("id", F.col("c_mktsegment").alias("segment")))
    customers.delete("k % 10 = 3")
    orders.delete("k % 7 = 0")
    view.refresh()
    return view.read()


@query("SELECT event_type, count(*) AS total, round(sum(value), 4) AS value FROM events WHERE event_type NOT IN ('click', 'error') GROUP BY 1 UNION ALL SELECT 'error', count(*), 0.0 FROM events WHERE event_type = 'error'")
def q_maintained_view(db):
    kept = T.StructType([T.StructField("id", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("total", T.LongType()), T.StructField("seen", T.LongType()), T.StructField("value", T.DoubleType())])
    view = feeds.CountedView(_history(db), Table(db.spark, scratch(db.spark, "view"), kept), ("event_type",), ("value",))
    feeds.Subscriptions(scratch(db.spark, "cp")).spawn("view", feeds.live(view.source), view.refresh, once=True).awaitTermination()
    return view.read().select("event_type", "total", F.abs(F.round("value", 4)).alias("value"))
