"""N-gram Jaccard join with Bayesian candidate pruning.

Two documents are linked if the Jaccard similarity of their sets of five-word
shingles is THRESHOLD or more.  Copies (the same words in the same order) form a
class and are handled once.

1. Candidates are complete: linked sets of n shingles share one of their first
   n - ceil(t n) + 1 in any order of all shingles.  The order is by the number of
   classes that have a shingle, so most documents have nothing but shingles of
   their own there and drop out.  Shingles of very many documents come last; at
   most 2 / HEAVY of them exist, whatever the input's size.
2. Documents tied by such shingles form candidate groups.  A group is compared in
   pairs of blocks of bounded size; only lengths that can be similar meet.
3. In a pair of blocks, MinHash values are compared some at a time, and a pair is
   dropped once the posterior probability of reaching the threshold is below
   TOLERANCE; what is left is verified exactly.  Links are counted in place, and
   only a spanning forest leaves the task, so no pairs are written.

Null texts count as empty.  Texts without a word are linked to equal texts only.
Rows that repeat a doc_id, or have none, count as documents of their own.  An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_slices, cut
from .components import components
from .shingles import each, mix, word_hashes

THRESHOLD = 0.8
#: A shingle is heavy if it makes up about this share of all; such are ordered last.
HEAVY = 1 / 32768
#: Shingle entries of a counting bucket, documents of a block, shingles of a comparing bucket.
BUCKET, BLOCK, LOAD = 2_000_000, 256, 2_000_000
#: MinHash values, how many are compared at a time, and the posterior probability below which a pair is dropped.
HASHES, STEP, TOLERANCE = 64, 16, 1e-9
#: Candidates whose ids are broadcast at most (16 bytes each); above, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
_LEVELS, _RANGES = 32767, 8
#: Copies of a text count as hot if they are more than one in so many documents.
HOT = 1000
#: Shingles gathered at a time when pairs are verified.
GATHERED = 250_000


def _name(text: str, words: np.ndarray) -> int:
    """A 64-bit name of the sequence of words, or of the text where it has none."""
    if not len(words):
        words = np.frombuffer(text.encode("utf-8", "surrogatepass").ljust(1, b"\0"), np.uint8).astype(np.uint64) + np.uint64(1 << 40)
    places = mix(np.arange(1, len(words) + 1, dtype=np.uint64))
    return int(mix(np.array([mix(words ^ places).sum()], np.uint64)).view(np.int64)[0])


def _named(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    for text, (words, own) in zip(texts, each(texts), strict=True):
        yield _name(text or "", words), own


def names(texts: list[str | None]) -> list[int]:
    """The names of whole texts: equal for texts of the same words in the same order."""
    out: list[int] = []
    for at in range(0, len(texts), 64):
        own = [t or "" for t in texts[at : at + 64]]
        words, counts = word_hashes(own)
        out += [_name(t, w) for t, w in zip(own, np.split(words, np.cumsum(counts)[:-1]), strict=True)]
    return out


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(",")]
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def classes(docs: DataFrame) -> DataFrame:
    """Rows (doc 1, doc_id, class, shingles) of all documents, and (doc 0, shingle, count) of shingles that are heavy in a batch."""
    schema = "doc int, a long, b long, n long"

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, sizes, own = [], [], {}
        for name, x in _named(batch.column("text").to_pylist()):
            names.append(name)
            sizes.append(len(x))
            own[name] = x
        flat = np.concatenate([*own.values(), np.empty(0, np.int64)])
        values, counts = np.unique(flat, return_counts=True)
        many = counts >= max(8, HEAVY * len(flat))
        values, counts = values[many], counts[many]
        n = len(names)
        return _batch(schema, [[1] * n + [0] * len(values), batch.column("doc_id").to_pylist() + values.tolist(), names + counts.tolist(), sizes + [0] * len(values)])

    return docs.select("doc_id", "text").mapInArrow(by_slices(step, 2048), schema)


def prefix_size(n: int, t: float = THRESHOLD) -> int:
    return n - math.ceil(t * n - 1e-9) + 1 if n else 0


def _entries(docs: DataFrame, heavy: np.ndarray, buckets: int, width: int, t: float) -> DataFrame:
    """Packed shingles by bucket of their hash: `width` bytes each, the owner's number, whether forced, and the owners' classes.

    An owner's number of plain shingles goes with its class in the first of its buckets, elsewhere -1.
    """
    schema = "bucket int, hashes binary, owners binary, forced binary, table binary"

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, owners, forced, table, seen = [], [], [], [], set()
        for name, x in _named(batch.column("text").to_pylist()):
            if name in seen or not len(x):
                continue
            seen.add(name)
            at = np.searchsorted(heavy, x)
            common = heavy[np.minimum(at, len(heavy) - 1)] == x if len(heavy) else np.zeros(len(x), bool)
            plain = x[~common]
            extra = x[common][: max(0, prefix_size(len(x), t) - len(plain))]
            hashes.append(np.concatenate((plain, extra)) >> (63 - 8 * width))
            owners.append(np.full(len(hashes[-1]), len(table), np.uint16))
            forced.append(np.arange(len(hashes[-1])) >= len(plain))
            table.append((name, len(plain)))
        columns: list[list] = [[], [], [], [], []]
        if table:
            h, o, f = np.concatenate(hashes), np.concatenate(owners), np.concatenate(forced)
            bucket = ((h >> (8 * width - 32)) * buckets) >> 32
            order = np.lexsort((o, bucket))
            h, o, f, bucket = h[order], o[order], f[order], bucket[order]
            ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
            rows, told = np.array(table, np.int64), np.zeros(len(table), bool)
            for start, end in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
                own, number = np.unique(o[start:end], return_inverse=True)
                named = rows[own]
                named[told[own], 1] = -1
                told[own] = True
                short = h[start:end].astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]
                for c, v in zip(columns, (int(bucket[start]), short.tobytes(), number.astype(np.uint16).tobytes(), np.packbits(f[start:end]).tobytes(), named.tobytes()), strict=True):
                    c.append(v)
        return _batch(schema, columns)

    return docs.select("text").mapInArrow(by_slices(step, 2048), schema)


def _repeated(width: int):
    """A function for applyInArrow over a bucket: (class, code) of the shingles that several classes have, and of forced ones.

    A code orders shingles: the number of classes, up to _LEVELS, or _LEVELS if forced, then the hash. Codes below
    1 << 48 are a class's number of plain shingles.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        n = 0
        for batch in group.to_batches():
            for row in zip(*(batch.column(c) for c in ("hashes", "owners", "forced", "table")), strict=True):
                short, owners, forced, table = (x.as_buffer() for x in row)
                eight = np.zeros((len(short) // width, 8), np.uint8)
                eight[:, :width] = np.frombuffer(short, np.uint8).reshape(-1, width)
                table = np.frombuffer(table, np.int64).reshape(-1, 2)
                for c, v in zip(parts, (eight.view("<i8").ravel(), np.frombuffer(owners, np.uint16).astype(np.int32) + n, np.unpackbits(np.frombuffer(forced, np.uint8), count=len(eight)).astype(bool), table), strict=True):
                    c.append(v)
                n += len(table)
        hashes, owners, flags, table = (np.concatenate(c) for c in parts)
        del parts
        names, number = np.unique(table[:, 0], return_inverse=True)
        owners = number.astype(np.int32)[owners]
        told = table[:, 1] >= 0
        classes, codes = [table[told, 0]], [table[told, 1]]
        low, high = int(hashes.min()), int(hashes.max()) + 1
        for k in range(_RANGES):  # a range of hashes at a time, to bound memory
            some = np.flatnonzero((hashes >= low + (high - low) * k // _RANGES) & (hashes < low + (high - low) * (k + 1) // _RANGES))
            some = some[np.lexsort((owners[some], hashes[some]))]
            h, own, f = hashes[some], owners[some], flags[some]
            if not len(h):
                continue
            once = np.concatenate(([True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])))
            h, own, f = h[once], own[once], f[once]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            held = np.repeat(np.diff(starts, append=len(h)), np.diff(starts, append=len(h)))
            keep = (held > 1) | f
            level = np.where(f[keep], _LEVELS, np.minimum(held[keep], _LEVELS - 1))
            classes.append(names[own[keep]])
            codes.append(level << 48 | h[keep])
        return pa.table({"class": np.concatenate(classes), "code": np.concatenate(codes)})

    return run


def candidate_keys(docs: DataFrame, kinds: DataFrame, heavy: np.ndarray, entries: int, t: float = THRESHOLD) -> DataFrame:
    """(key, class) for the shared shingles among each class's first ones in the order of all shingles."""
    buckets = max(1, math.ceil(entries / BUCKET))
    width = 5 if entries < 1 << 31 else 6  # enough bits that few different shingles share them; those only add candidates
    packed = _entries(docs, heavy, buckets, width, t)
    coded = packed.groupBy("bucket").applyInArrow(_repeated(width), "class long, code long")
    codes = coded.groupBy("class").agg(F.collect_list("code").alias("codes"))  # about a document's shingles
    level = F.lit(1 << 48)
    shared, forced = F.array_sort(F.filter("codes", lambda x: x >= level)), F.lit(_LEVELS << 48)
    both = codes.where(F.exists("codes", lambda x: x >= level)).withColumn("of", shared).withColumn("plain", F.array_max(F.filter("codes", lambda x: x < level)))
    alone = F.col("plain") - F.size(F.filter("of", lambda x: x < forced))
    first = F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9) + 1
    room = (first - alone).cast("int")
    found = both.join(kinds.select("class", "n"), "class").where(room > 0)
    return found.select("class", F.explode(F.slice(F.col("of"), 1, room)).alias("key"))


@functools.cache
def _least_matches(t: float, hashes: int = HASHES, tolerance: float = TOLERANCE) -> np.ndarray:
    """For each number of compared values, the fewest matches with P(similarity >= t) >= tolerance, from a uniform prior."""
    out = np.zeros(hashes + 1, np.int64)
    for n in range(1, hashes + 1):
        below = 0.0
        for m in range(n + 1):  # P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= tolerance:
                out[n] = m
                break
    return out


def minhashes(shingles: np.ndarray, n: int = HASHES) -> np.ndarray:
    """n MinHash values of a set of shingles, as the upper halves of mixed hashes."""
    keys = mix(np.arange(1, n + 1, dtype=np.uint64))
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for some in np.array_split(shingles.view(np.uint64), len(shingles) // 65_536 + 1):
        for at in range(0, n, 8):
            values = (some[None, :] ^ keys[at : at + 8, None]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
            out[at : at + 8] = np.minimum(out[at : at + 8], values.min(axis=1))
    return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def link_block(copies: np.ndarray, sides: np.ndarray | None, shingles: list[np.ndarray], hashes: np.ndarray, t: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The documents linked to each, weighted by copies, and a label of each one's component.

    With sides, only pairs of a 0 and a 1 meet; without, all pairs.
    """
    m = len(copies)
    n = np.array([len(x) for x in shingles])
    _, flat = np.unique(np.concatenate(shingles), return_inverse=True)
    ends = np.cumsum(n)
    starts = ends - n
    marker = np.zeros(int(flat.max(initial=0)) + 1, np.int64)
    least, ratio = _least_matches(t), Fraction(t).limit_denominator(1000)
    links, label = np.zeros(m, np.int64), np.arange(m)
    others = np.arange(m) if sides is None else np.flatnonzero(sides == 1)
    for i in range(m - 1) if sides is None else np.flatnonzero(sides == 0):
        pick = others[i + 1 :] if sides is None else others
        pick = pick[(np.minimum(n[pick], n[i]) >= t * np.maximum(n[pick], n[i]) - 1e-9)]
        same = np.zeros(len(pick), np.int64)
        for at in range(0, HASHES, STEP):
            same += (hashes[pick, at : at + STEP] == hashes[i, at : at + STEP]).sum(axis=1)
            stay = same >= least[at + STEP]
            pick, same = pick[stay], same[stay]
        if not len(pick):
            continue
        marker[flat[starts[i] : ends[i]]] = 1
        sizes = n[pick]
        shared = np.empty(len(pick), np.int64)
        for some in np.split(np.arange(len(pick)), np.flatnonzero(np.diff(np.cumsum(sizes) // GATHERED)) + 1):
            stops = np.cumsum(sizes[some])
            places = np.arange(stops[-1]) + np.repeat(starts[pick[some]] - (stops - sizes[some]), sizes[some])
            shared[some] = np.add.reduceat(marker[flat[places]], stops - sizes[some])
        marker[flat[starts[i] : ends[i]]] = 0
        pick = pick[shared * (ratio.numerator + ratio.denominator) >= ratio.numerator * (sizes + n[i])]
        links[i] += copies[pick].sum()
        links[pick] += copies[i]
        found = np.unique(label[np.append(pick, i)])
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]
    return links, label


def _compare(t: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keys = np.column_stack([group.column(c).to_numpy() for c in ("component", "size", "kind", "i", "j")])
        _, task = np.unique(keys, axis=0, return_inverse=True)
        task = task.ravel()
        order = np.argsort(task, kind="stable")
        names, copies, sides = (group.column(c).to_numpy() for c in ("class", "copies", "side"))
        raw, sig = group.column("shingles"), group.column("hashes")
        rows: list[list[np.ndarray]] = [[], [], []]
        for own in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
            if len(own) < 2:
                continue
            shingles = [np.frombuffer(raw[int(k)].as_buffer(), np.int64) for k in own]
            hashes = np.array([np.frombuffer(sig[int(k)].as_buffer(), np.uint32) for k in own])
            kind, i, j = keys[own[0], 2:]
            links, label = link_block(copies[own], sides[own] if kind or i != j else None, shingles, hashes, t)
            for some, kind, b in ((links > 0, 0, links), (label != np.arange(len(own)), 1, names[own][label])):
                for c, v in zip(rows, (np.full(some.sum(), kind, np.int32), names[own][some], b[some]), strict=True):
                    c.append(v)
        whole = [np.concatenate([np.empty(0, np.int64), *c]) for c in rows]
        return pa.table({"edge": whole[0].astype(np.int32), "a": whole[1].astype(np.int64), "b": whole[2].astype(np.int64)})

    return run


def _tasks(groups: DataFrame) -> DataFrame:
    """Each member's block and all pairs of blocks it takes part in; lengths of one step or of neighbouring steps meet.

    Pairs are dealt to buckets of about LOAD shingles, each member counted once for every pair it is in.
    """
    counted = groups.groupBy("component", "size").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    near = [counted.select("component", (F.col("size") + d).alias("size"), F.col("blocks").alias(n)) for d, n in ((0, "own"), (1, "below"), (-1, "above"))]
    wide = near[0].join(near[1], ["component", "size"], "left").join(near[2], ["component", "size"], "left").na.fill(0, ["below", "above"])
    placed = groups.join(wide, ["component", "size"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("own")).cast("int"))
    load = placed.agg(F.sum(F.col("n") * (F.col("own") + F.col("below") + F.col("above")))).first()[0] or 0
    one = lambda size, kind, i, j, side: F.struct(size.alias("size"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    upto = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)).otherwise(F.expr("array()"))
    b, s, zero = F.col("block"), F.col("size"), F.lit(0)
    pairs = F.concat(
        upto("own", lambda x: one(s, 0, F.least(b, x), F.greatest(b, x), F.when((b > x), 1).otherwise(0))),
        upto("above", lambda x: one(s, 1, b, x, zero)),
        upto("below", lambda x: one(s - 1, 1, x, b, zero + 1)),
    )
    bucket = F.pmod(F.xxhash64("component", "size", "kind", "i", "j"), F.lit(max(1, math.ceil(load / LOAD)))).alias("bucket")
    return placed.select("class", "component", F.explode(pairs).alias("p")).select("class", "component", "p.*").select("*", bucket)


def _classed(docs: DataFrame) -> DataFrame:
    """docs with the class of each row as _class; in each slice one row of a doc_id and class."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        first: dict[tuple, int] = {}
        for k, own in enumerate(zip(batch.column("doc_id").to_pylist(), names(batch.column("text").to_pylist()), strict=True)):
            first.setdefault(own, k)
        some = batch.take(pa.array(list(first.values()), pa.int64()))
        return pa.record_batch([*some.columns, pa.array([name for _, name in first], pa.int64())], [*some.schema.names, "_class"])

    return docs.mapInArrow(by_slices(step, 2048), T.StructType([*docs.schema.fields, T.StructField("_class", T.LongType())]))


def near_duplicates(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, class_id (the least doc_id of all that links tie together),
    copy_id (the least doc_id of its copies) and n_links (the other documents it is linked to, copies too).

    Ids are null where none of these documents has one.
    """
    return _grouped(docs, t).select("doc_id", "class_id", "copy_id", "n_links")


def _grouped(docs: DataFrame, t: float) -> DataFrame:
    """near_duplicates with each document's class and its group's least class (group)."""
    spark = docs.sparkSession
    first = cut(classes(docs))
    found = first.where("doc = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("class"), "n")
    kinds = cut(found.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n")))
    entries = kinds.agg(F.sum("n")).first()[0] or 0
    marks = first.where("doc = 0").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= HEAVY * entries / 2)
    heavy = np.sort(marks.select("a").toPandas()["a"].to_numpy(np.int64))  # at most 2 / HEAVY, as their counts sum to no more than the entries
    keyed = cut(candidate_keys(docs, kinds, heavy, entries, t))
    root = keyed.groupBy("key").agg(F.min("class").alias("b"), F.count("*").alias("m")).where("m > 1")
    tied = components(keyed.join(root, "key").select(F.col("class").alias("a"), "b"))
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / t) + 1e-6).cast("int")
    groups = cut(tied.select(F.col("node").alias("class"), "component").join(kinds, "class").withColumn("size", step))
    totals = groups.agg(F.count("*").alias("m"), F.count("rep").alias("named")).first()
    near = F.broadcast if totals["m"] <= BROADCAST_ROWS else lambda x: x
    ids = groups.where("rep is not null").select(F.col("rep").alias("doc_id"), "class")
    texts = docs.select("doc_id", "text").join(near(ids), "doc_id").select("class", "text")
    if totals["named"] < totals["m"]:  # classes without an id are found by the names of their texts
        unnamed = groups.where("rep is null").select(F.col("class").alias("_class"))
        texts = texts.unionByName(_classed(docs.where("doc_id is null").select("doc_id", "text")).join(near(unnamed), "_class").select(F.col("_class").alias("class"), "text"))

    def shingled(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, x.tobytes(), minhashes(x).tobytes()) for k, (name, x) in zip(batch.column("class").to_pylist(), _named(batch.column("text").to_pylist()), strict=True) if k == name and len(x)]
        return _batch("class long, shingles binary, hashes binary", list(zip(*rows, strict=True)) or [[], [], []])

    sets = texts.mapInArrow(by_slices(shingled), "class long, shingles binary, hashes binary").dropDuplicates(["class"])
    tasks = _tasks(groups.select("class", "component", "size", "n"))
    full = tasks.join(groups.select("class", "copies"), "class").join(sets, "class")
    compared = cut(full.groupBy("bucket").applyInArrow(_compare(t), "edge int, a long, b long"))
    links = compared.where("edge = 0").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("links"))
    named = components(compared.where("edge = 1").select("a", "b"))
    least = named.join(kinds, named["node"] == kinds["class"]).groupBy("component").agg(F.min("rep").alias("class_id"))
    of = named.join(least, "component").select(F.col("node").alias("class"), F.col("component").alias("group"), "class_id")
    by_class = kinds.join(links, "class", "left").join(of, "class", "left")
    group = F.coalesce("group", "class").alias("group")
    per_class = cut(by_class.select("class", "copies", group, F.coalesce("class_id", "rep").alias("class_id"), F.col("rep").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    # Classes with more than one in HOT of all documents, HOT at most, are broadcast; the others' rows are dealt by class.
    hot = F.broadcast(per_class.where(F.col("copies") * HOT > (kinds.agg(F.sum("copies")).first()[0] or 0)))
    many = found.select("doc_id", "class").join(hot, "class")
    few = found.select("doc_id", "class").join(hot.select("class"), "class", "left_anti").join(per_class, "class")
    return many.unionByName(few).drop("copies")


def one_of_each(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """One row of docs for each group: of those with the least doc_id (null only if none has one) one of the least class.

    All columns stay.  Of equal rows, and of copies under one doc_id, any one stays.
    """
    of = _grouped(docs, t).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("class").alias("_class"))).alias("x"))
    keys = ["_none", "_id", "_class"]
    rows = _classed(docs).withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0))})
    return rows.join(of.select("x.*"), keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
