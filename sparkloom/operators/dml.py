"""Changes to rows, as functions from a table to its next state.

Rows have an id. Assignments read the old row. A condition that is null doesn't
hold. What a statement returns comes from the rows it touched.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import operand, resolve
from ..shared import cut

NONE, DIFF, FULL, BEFORE, AFTER = "none", "diff", "full", "before", "after"
# What deleting a record does to the rows that link to it.
ACTIONS = ("ignore", "unset", "cascade", "reject")


class Rejected(ValueError):
    """A record that others refer to can't be deleted."""


def holds(condition: Any, df: DataFrame) -> Column:
    return F.lit(True) if condition is None else F.coalesce(resolve(condition, df), F.lit(False))


def single(rows: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """rows, whose plan raises if a key comes twice, as it isn't said which of its rows is meant."""
    n, own = F.count("*").over(Window.partitionBy(*keys)), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    kept = rows.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(own, F.lit(" comes twice"))).cast("boolean")).otherwise(F.lit(True)))
    return kept.drop("_n")


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with rows; columns that either lacks are null."""
    return table.unionByName(rows, allowMissingColumns=True)


def _assigned(table: DataFrame, values: Mapping[str, Any]) -> dict[str, Column]:
    """New columns by name; a dotted name changes a field inside a struct."""
    out: dict[str, Column] = {}
    for name, x in values.items():
        root, _, rest = name.partition(".")
        out[root] = out.get(root, F.col(root)).withField(rest, operand(x, table)) if rest else operand(x, table)
    return out


def update(table: DataFrame, values: Mapping[str, Any], condition: Any = None) -> DataFrame:
    where = holds(condition, table)
    new = _assigned(table, values)
    kept = [F.when(where, new[c].cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns]
    return table.select(*kept, *[F.when(where, x).alias(c) for c, x in new.items() if c not in table.columns])


def merge(table: DataFrame, patch: DataFrame) -> DataFrame:
    """Rows with the fields of patch, by id; fields that patch lacks stay, and a null in patch is a value. An id that comes twice in patch raises."""
    patch = single(patch)
    own = [c for c in patch.columns if c != "id"]
    new = patch.select("id", F.struct(*own).alias("_new"))
    out = table.join(new, "id", "left")
    return out.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in table.columns], *[F.col(f"_new.{c}").alias(c) for c in own if c not in table.columns])


def upsert(table: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows take the place of those with the same keys; the others are added. Keys that come twice in rows raise."""
    rows = single(rows, keys)
    return insert(table.join(rows.select(*keys), list(keys), "left_anti"), rows)


def replace(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Whole rows by id, only where the id exists; what rows lack becomes null."""
    return upsert(table, rows.join(table.select("id"), "id", "left_semi"))


def delete(table: DataFrame, condition: Any = None) -> DataFrame:
    return table.where(~holds(condition, table))


def delete_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti")


def relate(edges: DataFrame, pairs: DataFrame, nodes_in: DataFrame | None = None, nodes_out: DataFrame | None = None) -> DataFrame:
    """edges with pairs (in, out and whatever they carry); with node tables, only pairs whose ends exist."""
    for side, nodes in (("in", nodes_in), ("out", nodes_out)):
        if nodes is not None:
            pairs = pairs.join(nodes.select(F.col("id").alias(side)), side, "left_semi")
    if "id" not in pairs.columns and "id" in edges.columns:
        pairs = pairs.withColumn("id", F.concat(F.lit("edge:"), F.sha2(F.to_json(F.array("in", "out")), 256)))
    return insert(edges, pairs)


def unrelate(edges: DataFrame, in_: str, out: str) -> DataFrame:
    return edges.where(~((F.col("in") == in_) & (F.col("out") == out)))


def returned(before: DataFrame, after: DataFrame, form: str = AFTER) -> DataFrame:
    """What a change returns: the rows it touched as they were, are, both (full), or field by field (diff)."""
    if form == NONE:
        return after.limit(0)
    hashed = lambda df, n: df.select("id", F.struct(*[c for c in df.columns if c != "id"]).alias(n), F.lit(True).alias(f"_{n}"))
    both = hashed(before, "before").join(hashed(after, "after"), "id", "full").where(~F.coalesce(F.col("before"), F.lit(None)).eqNullSafe(F.col("after")) if before.columns == after.columns else F.lit(True))
    if form == FULL:
        return both.select("id", "before", "after")
    if form in (BEFORE, AFTER):
        return both.where(F.col(f"_{form}")).select("id", f"{form}.*")
    if form != DIFF:
        raise ValueError(f"no such form: {form}")
    names = [c for c in dict.fromkeys([*before.columns, *after.columns]) if c != "id"]
    text = lambda side, df, c: F.to_json(F.struct(F.col(f"{side}.{c}").alias("v"))) if c in df.columns else F.lit("{}")
    changes = F.array(*(F.struct(F.lit(c).alias("field"), text("before", before, c).alias("old"), text("after", after, c).alias("new")) for c in names))
    return both.select("id", F.explode(F.filter(changes, lambda x: x["old"] != x["new"])).alias("x")).select("id", "x.*")


def linked(rows: DataFrame, link: str) -> DataFrame:
    """(id, _link): each row's links, of a column with an id or an array of ids."""
    many = rows.schema[link].dataType.typeName() == "array"
    return rows.select("id", (F.explode(link) if many else F.col(link)).alias("_link"))


def referring(rows: DataFrame, link: str, gone: DataFrame) -> DataFrame:
    """The rows with a link to one of gone's ids (_gone); arrays of links are joined link by link."""
    if rows.schema[link].dataType.typeName() != "array":
        return rows.join(gone, F.col(link) == F.col("_gone"), "left_semi")
    hit = linked(rows, link).join(gone, F.col("_link") == F.col("_gone"), "left_semi").select("id").distinct()
    return rows.join(hit, "id", "left_semi")


def unset(rows: DataFrame, link: str, gone: DataFrame) -> DataFrame:
    """rows without their links to gone's ids (_gone): null, or arrays without them, in order of the ids."""
    gone = gone.select("_gone").distinct()
    if rows.schema[link].dataType.typeName() != "array":
        return rows.join(gone, F.col(link) == F.col("_gone"), "left").withColumn(link, F.when(F.col("_gone").isNull(), F.col(link))).drop("_gone")
    parts = linked(rows, link).join(gone, F.col("_link") == F.col("_gone"), "left_anti").groupBy("id").agg(F.sort_array(F.collect_list("_link")).alias("_left"))
    return rows.join(parts, "id", "left").withColumn(link, F.when(F.col(link).isNotNull(), F.coalesce("_left", F.slice(F.col(link), 1, 0)))).drop("_left")


def delete_referenced(table: DataFrame, condition: Any, referrers: Mapping[str, tuple[DataFrame, str, str] | tuple[DataFrame, str, str, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Deletes from table, and lets each referrer (rows, link, action) follow; returns the new table and referrers.

    A link may be an id or an array of ids.  A referrer may name another one as what it refers to: (rows, link, action, name);
    then deletions go on from there, until nothing more is deleted.
    """
    for _, _, action, *_ in referrers.values():
        if action not in ACTIONS:
            raise ValueError(f"no such action: {action}")
    gone: dict[str, DataFrame] = {"": cut(table.where(holds(condition, table)).select(F.col("id").alias("_gone")))}
    new = dict(gone)
    while new:
        found: dict[str, DataFrame] = {}
        for name, (rows, link, action, *of) in referrers.items():
            at = of[0] if of else ""
            if action == "cascade" and at in new:
                more = referring(rows, link, new[at]).select(F.col("id").alias("_gone"))
                more = cut(more.join(gone[name], "_gone", "left_anti") if name in gone else more)
                if not more.isEmpty():
                    found[name] = more
        for name, more in found.items():
            gone[name] = gone[name].unionByName(more) if name in gone else more
        new = found
    out: dict[str, DataFrame] = {}
    for name, (rows, link, action, *of) in referrers.items():
        left = rows.join(gone[name], F.col("id") == F.col("_gone"), "left_anti") if name in gone else rows
        at = of[0] if of else ""
        if at in gone and action == "reject" and not referring(left, link, gone[at]).isEmpty():
            raise Rejected(f"{name}.{link} refers to what is to be deleted")
        out[name] = unset(left, link, gone[at]) if at in gone and action == "unset" else left
    return delete(table, condition), out
