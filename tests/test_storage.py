"""Tables with history, buckets, streams, schemas and migrations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import schema as s
from sparkloom.functions import field
from sparkloom.functions import predicates as p
from sparkloom.migrations import Migrator, discover, statements
from sparkloom.operators import dml
from sparkloom.sources import Bucket, Conflict, File, Table, Transaction
from sparkloom.streaming import feeds

NOTES = T.StructType([T.StructField("id", T.StringType()), T.StructField("tenant", T.StringType()), T.StructField("n", T.LongType())])


def notes(spark, *rows):
    return spark.createDataFrame(rows, NOTES)


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}/notes", NOTES, originals=True)


def test_history(spark, table):
    assert table.read().isEmpty() and table.insert(notes(spark, ("n:1", "acme", 1), ("n:2", "acme", 2))) == 1
    with pytest.raises(ValueError, match="exists"):
        table.insert(notes(spark, ("n:1", "x", 1)))
    assert table.update({"n": field("n") + 10}, p.eq("id", "n:1")) == 2 and table.delete("n = 2") == 3
    assert table.upsert(notes(spark, ("n:1", "globex", 5), ("n:3", None, None))) == 4
    assert {tuple(r) for r in table.read().collect()} == {("n:1", "globex", 5), ("n:3", None, None)}
    assert {tuple(r) for r in table.read(1).collect()} == {("n:1", "acme", 1), ("n:2", "acme", 2)}
    assert [(r.version, r.id, r.action) for r in table.changes(2).collect()] == [(2, "n:1", "update"), (3, "n:2", "delete"), (4, "n:1", "update"), (4, "n:3", "create")]
    assert table.changes(2, limit=1).first().original.n == 1 and table.changes(5).isEmpty()
    assert [tuple(r) for r in table.returned(3, dml.BEFORE).collect()] == [("n:2", "acme", 2)]
    with pytest.raises(ValueError):
        table.changes(1, limit=0)
    assert table.expire(1) == 3 and table.versions() == [3, 4] and table.read().count() == 2


def test_transactions(spark, table):
    table.insert(notes(spark, ("n:1", "acme", 1)))
    one, two = Transaction(table), Transaction(table)
    one.run(dml.insert, notes(spark, ("n:2", "b", 2))).run(dml.delete, "id = 'n:1'")
    assert table.read().count() == 1
    assert one.commit() == 2 and [r.id for r in table.read().collect()] == ["n:2"]
    with pytest.raises(Conflict):
        two.run(dml.delete).commit()
    three = Transaction(table).run(dml.delete)
    three.rollback()
    with pytest.raises(RuntimeError):
        three.run(dml.delete)
    assert table.version() == 2


def test_references_between_tables(spark, tmp_path):
    links = T.StructType([T.StructField("id", T.StringType()), T.StructField("note", T.StringType())])
    other = Table(spark, f"file://{tmp_path}/links", links)
    own = Table(spark, f"file://{tmp_path}/own", NOTES, references={"links": (other, "note", "cascade")})
    own.insert(notes(spark, ("n:1", "a", 1), ("n:2", "a", 2)))
    other.insert(spark.createDataFrame([("l:1", "n:1"), ("l:2", "n:2")], links))
    own.delete("id = 'n:1'")
    assert [r.id for r in other.read().collect()] == ["l:2"]
    third = Table(spark, f"file://{tmp_path}/third", links)
    third.insert(spark.createDataFrame([("t:1", "n:2"), ("t:2", None)], links))
    own.references = {"third": (third, "note", "reject")}
    with pytest.raises(dml.Rejected):
        own.delete()
    own.references = {"third": (third, "note", "unset")}
    own.delete()
    assert {tuple(r) for r in third.read().collect()} == {("t:1", None), ("t:2", None)} and own.read().isEmpty()
    assert third.merge(spark.createDataFrame([("t:1", "x"), ("t:9", "y")], links)) == 3
    assert {tuple(r) for r in third.read().collect()} == {("t:1", "x"), ("t:2", None)} and third.changes(3).count() == 1


def test_live_queries(spark, table, tmp_path):
    got, hits = [], []
    subscriptions = feeds.Subscriptions(f"file://{tmp_path}/cp")
    stream = feeds.live(table, p.eq("tenant", "acme"))
    run = lambda: subscriptions.spawn("acme", stream, lambda b, _: got.extend((r.id, r.action) for r in b.orderBy("version", "id").collect()), once=True).awaitTermination()
    table.insert(notes(spark, ("n:1", "acme", 1), ("n:2", "globex", 2)))
    run()
    table.delete()
    run()
    run()
    assert got == [("n:1", "create"), ("n:1", "delete")]
    large = feeds.trigger(table, "action = 'create' AND row.n > 1", lambda b: hits.extend(r.id for r in b.collect()))
    subscriptions.spawn("large", feeds.live(table), large, once=True).awaitTermination()
    assert hits == ["n:2"]
    subscriptions.spawn("on", feeds.live(table), lambda b, _: None)
    assert subscriptions.names() == ["on"] and subscriptions.kill("on") and not subscriptions.kill("on")
    subscriptions.drain()
    assert subscriptions.count() == 0


def test_maintained_view(spark, table, tmp_path):
    kept = T.StructType([T.StructField("id", T.StringType()), T.StructField("tenant", T.StringType()), T.StructField("total", T.LongType()), T.StructField("seen", T.LongType()), T.StructField("n", T.LongType())])
    view = feeds.CountedView(table, Table(spark, f"file://{tmp_path}/view", kept), ("tenant",), ("n",))
    subscriptions = feeds.Subscriptions(f"file://{tmp_path}/cp")
    refresh = lambda: subscriptions.spawn("view", feeds.live(table), view.refresh, once=True).awaitTermination()
    table.insert(notes(spark, ("n:1", "mat", 1), ("n:2", "mat", 2), ("n:3", "nyn", 3)))
    refresh()
    assert {tuple(r) for r in view.read().select("tenant", "total", "n").collect()} == {("mat", 2, 3), ("nyn", 1, 3)}
    table.update({"n": 10}, "id = 'n:1'")
    table.delete("tenant = 'nyn'")
    refresh()
    assert {tuple(r) for r in view.read().select("tenant", "total", "n").collect()} == {("mat", 2, 12)}
    view.refresh(table.log().where("version = 1"), 0)
    assert view.read().first().total == 2


def test_windows(spark, tmp_path):
    rows = spark.sql("SELECT timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, id % 2 AS k FROM range(0, 60, 10)")
    rows.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/events")
    for name, df in (("tumbling", feeds.windowed(stream, "ts", "1 hour", "10 minutes", n=F.count("*"))), ("sessions", feeds.sessions(stream, "ts", "20 minutes", "10 minutes", "k", n=F.count("*")))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).agg(F.sum("n")).first()[0] == 6


def test_buckets(spark, tmp_path):
    b = Bucket(spark, f"file://{tmp_path}/bucket")
    assert b.put("a/x.txt", "héllo") and not b.put_if_not_exists("a/x.txt", "no") and b.get_text("a/x.txt") == "héllo" and b.get("a/x.txt") == "héllo".encode()
    assert b.copy("a/x.txt", "y.bin") and not b.copy_if_not_exists("a/x.txt", "y.bin") and b.head("y.bin")["size"] == 6 and b.head("none") is None
    assert b.rename("y.bin", "z.bin") and not b.rename_if_not_exists("a/x.txt", "z.bin") and not b.exists("y.bin")
    assert b.files().count() == 2 and b.contents("*.bin").count() == 1 and b.delete("z.bin") and not b.exists("z.bin")
    for f, error in ((lambda: b.get("none"), FileNotFoundError), (lambda: b.put("../x", ""), ValueError), (lambda: Bucket(spark, b.root, readonly=True).put("q", ""), PermissionError), (lambda: File.parse("x"), ValueError)):
        with pytest.raises(error):
            f()
    assert str(File.parse("b:/k/1")) == "b:/k/1"


def test_definitions(spark):
    user = s.table("user", s.string_field("name", nullable=False), s.int_field("age", check="age >= 0"), s.string_field("plan", default="free"), s.computed_field("made", "x", "string"), s.Field("adult", "bool", computed="age >= 18"), s.array_field("tags", "string"), indexes=(s.Index("by_name", ("name",), "unique"),), permission="plan = 'free'")
    rows = spark.createDataFrame([("user:1", "A", "30", "gone"), ("user:2", "A", None, "gone")], "id string, name string, age string, extra string")
    out = s.enforce(rows, user)
    assert out.schema.names == ["id", "name", "age", "plan", "made", "tags"] and out.first().age == 30 and out.first().plan == "free" and out.first().made == "x"
    assert s.on_read(out, user).first().adult is True and s.violations(out, user).first().n == 2
    changed = s.enforce(rows.withColumn("made", F.lit("new")), user, before=out)
    assert {r.made for r in changed.collect()} == {"x"}
    for bad in (rows.withColumn("name", F.lit(None)), rows.withColumn("age", F.lit(-1))):
        with pytest.raises(Exception, match=r"user\.(name|age)"):
            s.enforce(bad, user).collect()
    assert [f.severity for f in s.findings(user, out.schema)] == [] or {f.severity for f in s.findings(user, out.schema)} <= {"info"}
    assert {(f.severity, f.name) for f in s.findings(user, rows.schema)} >= {("error", "age"), ("error", "tags"), ("warning", "extra")} and s.findings(user, None)[0].severity == "error"
    loose = s.enforce(rows, s.table("loose", s.string_field("name"), mode=s.SCHEMALESS))
    assert loose.selectExpr("variant_get(rest, '$.age', 'string')").first()[0] == "30" and s.enforce(rows, s.table("d", mode=s.DROP)).isEmpty()


def test_definitions_refuse():
    for bad in (lambda: s.Field("a", "nope"), lambda: s.Field("1a"), lambda: s.Field("a", computed="x", default=1), lambda: s.Field("a.b", "record", target="t", reference="cascade"), lambda: s.TableDef("e", mode=s.RELATION), lambda: s.table("t", s.int_field("a"), s.int_field("a")), lambda: s.Index("v", ("v",), "mtree", dimension=3, element="F16"), lambda: s.Index("v", ("v",), "hnsw"), lambda: s.Index("v", ("v",), "diskann", "pearson", "F32", 3)):
        with pytest.raises(s.SchemaError):
            bad()
    assert s.edge("likes", "user", "post").struct().names == ["id", "in", "out"]


def test_differences(spark):
    a = [s.table("t", s.int_field("x"), s.string_field("gone")), s.table("old")]
    b = [s.table("t", s.string_field("x"), s.int_field("new", default=7)), s.edge("e", "t", "t")]
    steps = s.differences(a, b)
    assert [(c.kind, c.table, c.name) for c in steps] == [("add table", "e", ""), ("drop table", "old", ""), ("add field", "t", "new"), ("drop field", "t", "gone"), ("modify field", "t", "x")]
    rows = spark.createDataFrame([("t:1", 5, "y")], "id string, x long, gone string")
    for c in steps:
        rows = c.apply(rows) if c.table == "t" else rows
    assert rows.first().asDict() == {"id": "t:1", "x": "5", "new": 7}
    assert [c.severity for c in steps] == ["info", "critical", "info", "critical", "warning"] and steps[2].reversed().kind == "drop field"
    registry = s.Registry()
    registry.register(*b)
    assert "t }o--o{ t : e" in registry.mermaid() and len(registry.edges()) == 1


def test_migrations(spark, tmp_path):
    where = tmp_path / "m"
    where.mkdir()
    (where / "20240101_000000_one.sql").write_text("-- @up\nCREATE OR REPLACE TEMP VIEW mig AS SELECT ';' AS x;\n-- note\nCREATE OR REPLACE TEMP VIEW mig2 AS SELECT 2 AS y;\n-- @down\nDROP VIEW mig; DROP VIEW mig2;\n")
    (where / "20240102_000000_two.sql").write_text("-- @up\nSELECT 1;\n")
    (where / "_skip.sql").write_text("")
    m = Migrator(spark, where, f"file://{tmp_path}/history")
    assert len(discover(where)) == 2 and discover(tmp_path / "none") == [] and len(statements("a; 'b;c'; ")) == 2
    assert m.up(1) == ["20240101_000000"] and spark.table("mig").first().x == ";" and m.up() == ["20240102_000000"] and m.pending() == []
    with pytest.raises(ValueError, match="taken back"):
        m.down()
    (where / "20240102_000000_two.sql").write_text("-- @up\nSELECT 1;\n-- @down\nSELECT 2;\n")
    assert m.changed() == ["20240102_000000"] and m.down(2) == ["20240102_000000", "20240101_000000"] and m.applied() == [] and not spark.catalog.tableExists("mig")


def test_sequences_and_params(spark, tmp_path):
    from sparkloom.functions import expressions as e
    from sparkloom.plans import Database
    from sparkloom.sources import Sequence

    b = Bucket(spark, f"file://{tmp_path}/bucket")
    one, two = Sequence(b, "invoice", 500, 3), Sequence(b, "invoice", 500, 3)
    assert [one.next(), two.next(), one.next(), one.next(), one.next(), two.next()] == [500, 503, 501, 502, 506, 504]
    rows = one.number(spark.range(10, numPartitions=3)).collect()
    assert sorted(r.number for r in rows) == list(range(509, 519)) and two.number(spark.range(0)).count() == 0
    db = Database(spark)
    db.param("app_name", "loom")
    assert db.sql("SELECT app_name AS x").first().x == "loom"
    times = spark.createDataFrame([("2024-01-01T10:00:00Z",), ("2024-01-01T12:00:00+02:00",), ("2024-01-01 10:00:00",), ("no",), (None,)], "t string")
    assert [str(r[0]) for r in times.select(e.to_datetime("t").column(times).cast("string")).collect()] == ["2024-01-01 10:00:00"] * 3 + ["None"] * 2
