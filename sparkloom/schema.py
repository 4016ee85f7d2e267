"""Tables, edges and fields as code, and what Spark makes of them.

A definition gives a StructType; `enforce` brings rows into its form before they
are written, `on_read` adds what is computed on reading, `findings` compares it
with a DataFrame, and `differences` with an older definition.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field as default
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.core import operand, resolve
from .operators.graph import reverse_references

SCHEMAFULL, SCHEMALESS, DROP, RELATION = "schemafull", "schemaless", "drop", "relation"
# Field types, and Spark's type for each.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.TimestampType(),
    "duration": T.DayTimeIntervalType(), "decimal": T.DecimalType(38, 10), "number": T.DoubleType(), "object": T.VariantType(), "record": T.StringType(),
    "geometry": T.StringType(), "bytes": T.BinaryType(), "any": T.VariantType(), "file": T.StructType([T.StructField("bucket", T.StringType()), T.StructField("key", T.StringType())]),
}
# Vector indexes, the metrics and the element types that each takes.
VECTOR_INDEXES = {
    "mtree": ({"euclidean", "cosine", "manhattan", "minkowski"}, {"F64", "F32", "I64", "I32", "I16"}),
    "hnsw": ({"cosine", "euclidean", "manhattan", "minkowski", "chebyshev", "hamming", "jaccard", "pearson"}, {"F64", "F32", "F16", "I64", "I32", "I16", "I8"}),
    "diskann": ({"euclidean", "cosine", "manhattan", "hamming"}, {"F32", "F16", "I8", "U8"}),
}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")


class SchemaError(ValueError):
    """A definition that contradicts itself."""


@dataclass(frozen=True)
class Field:
    """A field; a dotted name is a field of an object.

    value is stored on every write, default where there is none, computed is added on reading.
    """

    name: str
    type: str = "any"
    nullable: bool = True
    default: Any = None
    value: Any = None
    computed: Any = None
    check: Any = None
    readonly: bool = False
    target: str | None = None
    of: str | None = None
    reference: str | None = None
    reverse: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if not _NAME.fullmatch(self.name):
            raise SchemaError(f"not a field name: {self.name!r}")
        if self.type not in TYPES and self.type != "array":
            raise SchemaError(f"no such type: {self.type}")
        if self.computed is not None and (self.readonly or self.value is not None or self.default is not None):
            raise SchemaError("what is computed on reading has no value, default or readonly")
        if self.reference and ("." in self.name or not self.target):
            raise SchemaError("only a top-level link has a reference action")

    def spark_type(self) -> T.DataType:
        return T.ArrayType(TYPES[self.of or ("record" if self.target else "any")]) if self.type == "array" else TYPES[self.type]


@dataclass(frozen=True)
class Index:
    """unique is checked on writing; the other kinds describe searches, and only their settings are checked."""

    name: str
    columns: tuple[str, ...]
    kind: str = "standard"
    metric: str = "euclidean"
    element: str = "F32"
    dimension: int | None = None

    def __post_init__(self) -> None:
        if self.kind in VECTOR_INDEXES:
            metrics, elements = VECTOR_INDEXES[self.kind]
            if not self.dimension or self.dimension < 1:
                raise SchemaError("a vector index needs a dimension")
            if self.metric not in metrics or self.element not in elements:
                raise SchemaError(f"{self.kind} has no {self.metric} of {self.element}")
        elif self.kind not in ("standard", "unique", "fulltext"):
            raise SchemaError(f"no such index: {self.kind}")


@dataclass(frozen=True)
class TableDef:
    name: str
    fields: tuple[Field, ...] = ()
    mode: str = SCHEMAFULL
    indexes: tuple[Index, ...] = ()
    source: str | None = None
    to: str | None = None
    permission: Any = None
    changefeed: bool = False

    def __post_init__(self) -> None:
        if not _NAME.fullmatch(self.name) or "." in self.name:
            raise SchemaError(f"not a table name: {self.name!r}")
        if self.mode not in (SCHEMAFULL, SCHEMALESS, DROP, RELATION):
            raise SchemaError(f"no such mode: {self.mode}")
        if self.mode == RELATION and not (self.source and self.to):
            raise SchemaError("a relation needs both of its ends")
        if len({f.name for f in self.fields}) < len(self.fields):
            raise SchemaError("a field is defined twice")

    def stored(self) -> list[Field]:
        return [f for f in self.fields if f.computed is None and f.reverse is None]

    def unique(self) -> tuple[tuple[str, ...], ...]:
        """The keys that a table of these rows must enforce."""
        return tuple(i.columns for i in self.indexes if i.kind == "unique")

    def struct(self) -> T.StructType:
        """The columns that are stored: id, an edge's in and out, the fields, and a variant for what a schemaless table has besides."""
        out = T.StructType([T.StructField("id", T.StringType(), False)])
        if self.source or self.mode == RELATION:
            out = out.add("in", T.StringType()).add("out", T.StringType())
        for f in self.stored():
            if "." not in f.name:
                nested = [g for g in self.stored() if g.name.startswith(f"{f.name}.")]
                kind = T.StructType([T.StructField(g.name.split(".", 1)[1], g.spark_type(), g.nullable) for g in nested]) if nested else f.spark_type()
                out = out.add(f.name, kind, f.nullable)
        return out.add("rest", T.VariantType()) if self.mode == SCHEMALESS else out


# Fields by type


def _of(kind: str) -> Callable[..., Field]:
    return lambda name, **more: Field(name, kind, **more)


string_field, int_field, float_field, bool_field, datetime_field = (_of(k) for k in ("string", "int", "float", "bool", "datetime"))
object_field, file_field, bytes_field = (_of(k) for k in ("object", "file", "bytes"))


def array_field(name: str, of: str = "any", **more: Any) -> Field:
    return Field(name, "array", of=of, **more)


def record_field(name: str, target: str | None = None, **more: Any) -> Field:
    return Field(name, "record", target=target, **more)


def computed_field(name: str, value: Any, kind: str = "any") -> Field:
    """Stored when the row is written, and never changed."""
    return Field(name, kind, value=value, readonly=True)


def reverse_reference_field(name: str, source: str, link: str, *fields: str) -> Field:
    """On reading, the rows of source (or some of their fields) whose link points here."""
    return Field(name, "array", reverse=(source, link, *fields))


def table(name: str, *fields: Field, **more: Any) -> TableDef:
    return TableDef(name, fields, **more)


def edge(name: str, source: str, to: str, *fields: Field, **more: Any) -> TableDef:
    return TableDef(name, fields, mode=RELATION, source=source, to=to, **more)


def bidirectional_edge(name: str, both: str, *fields: Field) -> TableDef:
    return edge(name, both, both, *fields)


# Writing and reading


def enforce(rows: DataFrame, definition: TableDef, before: DataFrame | None = None) -> DataFrame:
    """rows in the definition's form: defaults and values filled in, types cast, columns that aren't defined left out.

    A value that doesn't fit, a missing one that may not be null, or a failed check is an error when the rows are
    computed. With the rows before, a readonly field keeps its old value.
    """
    if definition.mode == DROP:
        return rows.limit(0)
    struct = definition.struct()
    if before is not None and (fixed := [f.name for f in definition.stored() if f.readonly]):
        old = before.select(F.col("id").alias("_id"), F.struct(*fixed).alias("_old"))
        joined = rows.join(old, F.col("id") == F.col("_id"), "left")
        kept = [F.when(F.col("_id").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(c) if c in rows.columns else F.lit(None)).alias(c) for c in fixed]
        rows = joined.select(*[c for c in rows.columns if c not in fixed], *kept)
    by_name = {f.name: f for f in definition.stored()}
    columns: list[Column] = []
    for s in struct.fields:
        f = by_name.get(s.name)
        if s.name == "rest":
            others = [c for c in rows.columns if c not in struct.names]
            columns.append((F.to_variant_object(F.struct(*others)) if others else F.lit(None).cast("variant")).alias("rest"))
            continue
        own = F.col(s.name) if s.name in rows.columns else F.lit(None)
        if f is not None and f.value is not None and not (f.readonly and before is not None):
            own = F.coalesce(own, operand(f.value, rows)) if f.readonly else operand(f.value, rows)
        elif f is not None and f.default is not None:
            own = F.coalesce(own, operand(f.default, rows))
        if not (isinstance(s.dataType, T.VariantType) and s.name in rows.columns and not isinstance(rows.schema[s.name].dataType, T.VariantType)):
            own = own.cast(s.dataType)
        elif isinstance(rows.schema[s.name].dataType, (T.StructType, T.ArrayType, T.MapType)):
            own = F.to_variant_object(own)
        else:
            own = own.cast("variant")
        if not s.nullable:
            own = F.coalesce(own, F.raise_error(F.lit(f"{definition.name}.{s.name} may not be null")).cast(s.dataType))
        columns.append(own.alias(s.name))
    out = rows.select(*columns)
    for f in definition.stored():
        if f.check is not None:
            ok = F.coalesce(resolve(f.check, out), F.lit(False))
            out = out.withColumn(f.name, F.when(F.col(f.name).isNull() | ok, F.col(f.name)).otherwise(F.raise_error(F.lit(f"{definition.name}.{f.name} fails its check")).cast(struct[f.name].dataType)))
    return out


def violations(rows: DataFrame, definition: TableDef) -> DataFrame:
    """(index, values, n) for what unique indexes hold more than once: one aggregate for each index."""
    out = rows.sparkSession.createDataFrame([], "index string, values string, n long")
    for i in (x for x in definition.indexes if x.kind == "unique"):
        found = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in i.columns)).groupBy(*i.columns).count().where("count > 1")
        out = out.unionByName(found.select(F.lit(i.name).alias("index"), F.to_json(F.struct(*i.columns)).alias("values"), F.col("count").alias("n")))
    return out


def on_read(rows: DataFrame, definition: TableDef, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """rows with the fields that are computed on reading, and only those that the permission lets through.

    Reverse references are found in tables.
    """
    for f in definition.fields:
        if f.reverse is not None:
            source, link, *kept = f.reverse
            rows = reverse_references(rows, (tables or {})[source], link, f.name, *kept)
        if f.computed is not None:
            rows = rows.withColumn(f.name, resolve(f.computed, rows))
    return rows if definition.permission is None else rows.where(F.coalesce(resolve(definition.permission, rows), F.lit(False)))


# Comparing


@dataclass(frozen=True)
class Finding:
    severity: str
    table: str
    name: str
    what: str


def findings(definition: TableDef, actual: T.StructType | None) -> list[Finding]:
    """How a table's real columns differ: errors for what is missing or of another type, warnings for extras, notes on nullability."""
    if actual is None:
        return [Finding("error", definition.name, "", "the table is missing")]
    out = []
    want = {f.name: f for f in definition.struct().fields}
    have = {f.name: f for f in actual.fields}
    for name, f in want.items():
        if name not in have:
            out.append(Finding("error", definition.name, name, "the field is missing"))
        elif have[name].dataType != f.dataType:
            out.append(Finding("error", definition.name, name, f"is {have[name].dataType.simpleString()}, not {f.dataType.simpleString()}"))
        elif have[name].nullable and not f.nullable:
            out.append(Finding("info", definition.name, name, "may be null"))
    return out + [Finding("warning", definition.name, n, "the field isn't defined") for n in have if n not in want]


@dataclass(frozen=True)
class Change:
    """One step from a definition to another; apply() does it to a table's rows."""

    kind: str
    table: str
    name: str = ""
    old: Any = None
    new: Any = None

    @property
    def severity(self) -> str:
        """How much a rollback or a drift of this kind matters."""
        return "info" if self.kind.startswith("add") else "critical" if self.kind.startswith("drop") else "warning"

    def reversed(self) -> Change:
        swap = {"add": "drop", "drop": "add"}
        verb, _, what = self.kind.partition(" ")
        return Change(f"{swap.get(verb, verb)} {what}", self.table, self.name, self.new, self.old)

    def apply(self, rows: DataFrame) -> DataFrame:
        if self.kind == "add field" and self.name not in rows.columns:
            value = self.new.default if self.new.default is not None else self.new.value
            return rows.withColumn(self.name, (F.lit(None) if value is None else operand(value, rows)).cast(self.new.spark_type()))
        if self.kind == "drop field":
            return rows.drop(self.name)
        if self.kind == "modify field" and self.old.type != self.new.type:
            return rows.withColumn(self.name, F.col(self.name).cast(self.new.spark_type()))
        return rows


def differences(old: Iterable[TableDef], new: Iterable[TableDef]) -> list[Change]:
    """The steps from old definitions to new ones, sorted by table: added, dropped, then modified."""
    a, b = {t.name: t for t in old}, {t.name: t for t in new}
    out = [Change("add table", n, new=b[n]) for n in sorted(b.keys() - a.keys())] + [Change("drop table", n, old=a[n]) for n in sorted(a.keys() - b.keys())]
    for n in sorted(a.keys() & b.keys()):
        for what, get in (("field", lambda t: {f.name: f for f in t.fields}), ("index", lambda t: {i.name: i for i in t.indexes})):
            x, y = get(a[n]), get(b[n])
            out += [Change(f"add {what}", n, k, new=y[k]) for k in sorted(y.keys() - x.keys())]
            out += [Change(f"drop {what}", n, k, old=x[k]) for k in sorted(x.keys() - y.keys())]
            out += [Change(f"modify {what}", n, k, x[k], y[k]) for k in sorted(x.keys() & y.keys()) if repr(x[k]) != repr(y[k])]
        if (a[n].mode, repr(a[n].permission), a[n].changefeed) != (b[n].mode, repr(b[n].permission), b[n].changefeed):
            out.append(Change("modify table", n, old=a[n], new=b[n]))
    return out


@dataclass(frozen=True)
class FunctionDef:
    """A stored function: named and typed parameters, the type it returns, and SQL text over the parameters."""

    name: str
    params: tuple[tuple[str, str], ...]
    body: str
    returns: str = "any"

    def __post_init__(self) -> None:
        if not all(_NAME.fullmatch(x) for x in (*self.name.split("::"), *(n for n, _ in self.params))):
            raise SchemaError(f"not a name in {self.name!r}")
        if len({n for n, _ in self.params}) < len(self.params):
            raise SchemaError("a parameter is defined twice")
        if unknown := [t for t in (self.returns, *(t for _, t in self.params)) if t not in TYPES]:
            raise SchemaError(f"no such type: {unknown[0]}")
        if not self.body.strip():
            raise SchemaError("a function needs a body")

    def create(self, spark: SparkSession) -> str:
        """Makes it a function of the session's SQL; returns its name there."""
        name = self.name.replace("::", "_")
        params = ", ".join(f"{n} {TYPES[t].simpleString()}" for n, t in self.params)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {TYPES[self.returns].simpleString()} RETURN {self.body}")
        return name


#: Kinds of definitions besides tables.
KINDS = ("function", "param", "sequence", "bucket", "analyzer", "event")


def object_differences(old: Mapping[str, Mapping[str, Any]], new: Mapping[str, Mapping[str, Any]]) -> list[Change]:
    """The steps between definitions other than tables', by kind and name: added, dropped, then modified."""
    out = []
    for kind in KINDS:
        a, b = old.get(kind, {}), new.get(kind, {})
        out += [Change(f"add {kind}", "", n, new=b[n]) for n in sorted(b.keys() - a.keys())]
        out += [Change(f"drop {kind}", "", n, old=a[n]) for n in sorted(a.keys() - b.keys())]
        out += [Change(f"modify {kind}", "", n, a[n], b[n]) for n in sorted(a.keys() & b.keys()) if repr(a[n]) != repr(b[n])]
    return out


def index_problems(definition: TableDef) -> list[Finding]:
    """Indexes over fields that aren't defined, or of a kind that the field's type has no use for."""
    by_name, out = {f.name: f for f in definition.fields}, []
    for i in definition.indexes:
        for c in i.columns:
            if c not in by_name and definition.mode != SCHEMALESS and c not in ("id", "in", "out"):
                out.append(Finding("error", definition.name, i.name, f"{c} isn't defined"))
            elif i.kind in VECTOR_INDEXES and c in by_name and by_name[c].type != "array":
                out.append(Finding("error", definition.name, i.name, f"{c} is no array"))
            elif i.kind == "fulltext" and c in by_name and by_name[c].type != "string":
                out.append(Finding("error", definition.name, i.name, f"{c} is no text"))
    return out


def edge_problems(definition: TableDef, registry: Registry) -> list[Finding]:
    """Edges whose ends aren't defined, or are edges themselves."""
    out = []
    for end in (definition.source, definition.to) if definition.mode == RELATION else ():
        if end not in registry.tables:
            out.append(Finding("error", definition.name, end or "", "the end isn't defined"))
        elif registry.tables[end].mode == RELATION:
            out.append(Finding("warning", definition.name, end, "the end is an edge"))
    return out


@dataclass
class Registry:
    """Definitions by name."""

    tables: dict[str, TableDef] = default(default_factory=dict)
    objects: dict[str, dict[str, Any]] = default(default_factory=dict)

    def define(self, kind: str, name: str, definition: Any) -> None:
        """A definition other than a table's."""
        if kind not in KINDS:
            raise SchemaError(f"no such kind: {kind}")
        self.objects.setdefault(kind, {})[name] = definition

    def changes_to(self, other: Registry) -> list[Change]:
        return differences(self.tables.values(), other.tables.values()) + object_differences(self.objects, other.objects)

    def problems(self) -> list[Finding]:
        """What contradicts itself among the definitions."""
        return [x for t in self.tables.values() for x in (*index_problems(t), *edge_problems(t, self))]

    def snapshot(self) -> str:
        """The definitions as text, to be kept with a version; equal for equal definitions."""
        return json.dumps({"tables": {n: repr(t) for n, t in sorted(self.tables.items())}, **{k: {n: repr(x) for n, x in sorted(v.items())} for k, v in sorted(self.objects.items())}}, sort_keys=True)

    @staticmethod
    def compared(old: str, new: str) -> list[tuple[str, str, str]]:
        """(what happened, kind, name) between two snapshots, in order."""
        a, b = json.loads(old), json.loads(new)
        out = []
        for kind in sorted(a.keys() | b.keys()):
            x, y = a.get(kind, {}), b.get(kind, {})
            out += [("added" if n not in x else "dropped" if n not in y else "modified", kind, n) for n in sorted(x.keys() | y.keys()) if x.get(n) != y.get(n)]
        return out

    def register(self, *definitions: TableDef) -> None:
        for d in definitions:
            self.tables[d.name] = d

    def edges(self) -> list[TableDef]:
        return [t for t in self.tables.values() if t.mode == RELATION]

    def mermaid(self) -> str:
        """An entity diagram: tables with their fields, and edges and links between them."""
        lines = ["erDiagram"]
        for t in self.tables.values():
            if t.mode != RELATION:
                lines += [f"    {t.name} {{", *(f"        {f.type} {f.name.replace('.', '_')}" for f in t.fields), "    }"]
            else:
                lines.append(f"    {t.source} }}o--o{{ {t.to} : {t.name}")
            lines += [f"    {t.name} }}o--|| {f.target} : {f.name}" for f in t.fields if f.target]
        return "\n".join(lines)
