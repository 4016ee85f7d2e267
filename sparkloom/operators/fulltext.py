"""Full-text search: analyzers as column expressions, matches and BM25 scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import porter
from ..generations import Generations
from ..shared import cut

# What the tokenizers split at.
TOKENIZERS = {"blank": r"\s+", "punct": r"\p{Punct}+|\s+", "class": r"[^\p{L}\p{N}]+", "camel": r"\s+|(?<=\p{Ll})(?=\p{Lu})"}
# Letters with marks, and the letters they become.
MARKED, PLAIN = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÑÇ", "aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC"
#: BM25's saturation of term frequencies and weight of lengths.
K1, B = 1.2, 0.75
#: Texts of a block of postings, as a power of two; blocks that a top-k search scores first.
BLOCK_BITS, FIRST_BLOCKS = 12, 8
#: Keys with several texts that are broadcast at most, to pick their rows; if there are more, all rows are dealt by key.
AGAIN = 100_000
#: Filters that change letters, but not where the tokenizers other than camel split.
WHOLE = {"lowercase": F.lower, "uppercase": F.upper, "ascii": lambda x: F.translate(x, MARKED, PLAIN)}


@dataclass(frozen=True)
class Analyzer:
    """A tokenizer, then filters in order: ascii, lowercase, uppercase, (edgengram, least, most), (ngram, least, most), snowball."""

    tokenizers: tuple[str, ...] = ("class",)
    filters: tuple[str | tuple[str, int, int], ...] = ("lowercase", "ascii")

    def __post_init__(self) -> None:
        for t in self.tokenizers:
            if t not in TOKENIZERS:
                raise ValueError(f"no such tokenizer: {t}")

    def with_filter(self, *filters: str | tuple[str, int, int]) -> Analyzer:
        return replace(self, filters=self.filters + filters)

    def tokens(self, text: Column) -> Column:
        """The tokens of a text; null for null."""
        filters, own = list(self.filters), text
        while filters and filters[0] in WHOLE and "camel" not in self.tokenizers:  # the same on a whole text, and faster
            f = filters.pop(0)
            changed = WHOLE[f](own)
            own = F.when(F.octet_length(text) == F.length(text), own).otherwise(changed) if f == "ascii" else changed  # plain texts stay
        out = F.split(own, TOKENIZERS[self.tokenizers[0]]) if self.tokenizers else F.array(own)
        for t in self.tokenizers[1:]:
            out = F.flatten(F.transform(out, _splitter(t)))
        out = F.array_remove(out, "")
        for f in filters:
            out = _filtered(out, f)
        return F.when(text.isNotNull(), out)


def _splitter(name: str):
    return lambda x: F.split(x, TOKENIZERS[name])


def _filtered(tokens: Column, f: str | tuple[str, int, int]) -> Column:
    if f in WHOLE:
        return F.transform(tokens, WHOLE[f])
    if f == "snowball":
        return stems(tokens)
    kind, least, most = f
    if kind == "edgengram":
        some = lambda x: F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(x))), lambda n: F.substring(x, F.lit(1), n))
    elif kind == "ngram":
        at = lambda x, n: F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, n))
        some = lambda x: F.flatten(F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(x))), lambda n: at(x, n)))
    else:
        raise ValueError(f"no such filter: {f}")
    return F.flatten(F.transform(F.filter(tokens, lambda x: F.length(x) >= least), some))


def stems(tokens: Column) -> Column:
    """Each token's English stem (Porter2), a batch of token lists at a time."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda own: None if own is None else [porter.stem(x) for x in own])

    return run(tokens)


STANDARD = Analyzer()


def query_tokens(rows: DataFrame, query: str, analyzer: Analyzer = STANDARD) -> list[str]:
    """The distinct tokens of a query, by the same expressions as the texts'."""
    if not query:
        raise ValueError("empty query")
    one = rows.sparkSession.range(1).select(F.array_distinct(analyzer.tokens(F.lit(query))).alias("t")).first()
    return list(one["t"])


def matches(text: Column, tokens: Sequence[str], analyzer: Analyzer = STANDARD, any_: bool = False) -> Column:
    """Whether a text has all tokens, or any; with no token, nothing matches."""
    if not tokens:
        return F.lit(False)
    own = analyzer.tokens(text)
    wanted = F.array(*(F.lit(t) for t in tokens))
    return F.arrays_overlap(own, wanted) if any_ else F.size(F.array_except(wanted, own)) == 0


def search(rows: DataFrame, column: str, query: str, analyzer: Analyzer = STANDARD, any_: bool = False) -> DataFrame:
    """The rows whose text matches."""
    return rows.where(matches(F.col(column), query_tokens(rows, query, analyzer), analyzer, any_))


def _counted(rows: DataFrame, column: str, tokens: Sequence[str], analyzer: Analyzer) -> DataFrame:
    """rows with a text, and _count: the number of its tokens, and of those asked for. The text is split once, whatever is done with the counts."""
    start = F.struct(F.lit(0).alias("n"), *[F.lit(0).alias(f"t{i}") for i in range(len(tokens))])
    step = lambda a, t: F.struct((a["n"] + 1).alias("n"), *[(a[f"t{i}"] + (t == own).cast("int")).alias(f"t{i}") for i, own in enumerate(tokens)])
    counts = F.aggregate(analyzer.tokens(F.col(column)), start, step)
    return rows.where(F.col(column).isNotNull()).select(*rows.columns, F.explode(F.array(counts)).alias("_count"))  # no filter goes below an explode


def bm25(rows: DataFrame, column: str, query: str, analyzer: Analyzer = STANDARD, any_: bool = False, name: str = "score") -> DataFrame:
    """Matching rows with their BM25 score.

    Document frequencies and the mean length come from one aggregate of the texts alone, which runs now; the plan that is
    returned splits each text once more, to filter and to score.
    """
    tokens = query_tokens(rows, query, analyzer)
    found = [F.col(f"_count.t{i}") for i in range(len(tokens))]
    totals = _counted(rows.select(column), column, tokens, analyzer).agg(F.count("*").alias("docs"), F.avg("_count.n").alias("mean"), *[F.count_if(x > 0).alias(f"df{i}") for i, x in enumerate(found)]).first()
    score, hit = F.lit(0.0), F.lit(bool(tokens) and not any_)
    for i, x in enumerate(found):
        score = score + _part(F.lit(float(totals["docs"])), F.lit(float(totals[f"df{i}"])), x.cast("double"), F.col("_count.n"), F.lit(totals["mean"]))
        hit = (hit | (x > 0)) if any_ else (hit & (x > 0))
    return _counted(rows, column, tokens, analyzer).where(hit).withColumn(name, score).drop("_count")


def _part(docs: Column, df: Column, tf: Column, n: Column, mean: Column) -> Column:
    """A token's part of a BM25 score."""
    return F.log(1 + (docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A function for mapInArrow from texts (key, n, t) to rows of postings, a block of texts at a time."""
    block = TaskContext.get().partitionId() << 33
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << BLOCK_BITS):
            part = batch.slice(at, 1 << BLOCK_BITS)
            lists, sizes = part.column("t"), part.column("n").to_numpy()
            if not sizes.sum():
                continue
            tokens = lists.flatten().dictionary_encode()
            text, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            token = tokens.indices.to_numpy()
            order = np.argsort(token, kind="stable")  # by token, and there by text and place
            token, text = token[order], text[order]
            new = np.diff(token, prepend=-1) != 0
            first = np.flatnonzero(new | (np.diff(text, prepend=-1) != 0))  # where a text's places begin
            rows = np.flatnonzero(new[first])  # where a token's texts begin
            tf, n = np.diff(first, append=len(token)), sizes[text[first]]
            bounds, begins = np.append(rows, len(first)), np.append(first[rows], len(token))
            listed = lambda x, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)
            ints = lambda x, ends: listed(pa.array(x, pa.int32()), ends)
            columns = [tokens.dictionary.take(pa.array(token[first[rows]])), pa.array(np.full(len(rows), block), pa.int64()), pa.array(np.maximum.reduceat(tf, rows), pa.int32()), pa.array(np.minimum.reduceat(n, rows), pa.int32())]
            last = first + tf - np.repeat(first[rows], np.diff(bounds))  # where a text's places end in the row's
            yield pa.record_batch([*columns, listed(part.column("key").take(pa.array(text[first])), bounds), ints(n, bounds), ints(last, bounds), ints(place[order], begins)], ["token", "block", "most", "least", "keys", "ns", "ends", "places"])
            block += 1


@dataclass
class TextIndex:
    """An inverted index under a folder, of segments that are never changed.

    A segment has its texts in blocks of at most 2 to the power of BLOCK_BITS, those of a task. A row has a token's postings in a block as arrays: keys,
    ns (lengths), places, and ends, where each text's places end. It has the largest count and
    the least length among them, which bound every score there whatever the mean length is. Rows lie in the order of
    their tokens, so a search reads the row groups of its tokens alone, and of most blocks only the bounds. Later segments
    name the keys that they replace or delete. Segments merge when the next older one is no more than twice as large.
    """

    spark: SparkSession
    root: str
    analyzer: Analyzer = STANDARD

    def __post_init__(self) -> None:
        self.segments = Generations(self.spark, self.root)

    def build(self, rows: DataFrame, key: str, column: str) -> TextIndex:
        """Indexes rows with a text, in place of what the index has."""
        self._write(self._texts(rows, key, column), None, self.segments.numbers(), self.segments.latest())
        return self

    def append(self, rows: DataFrame, key: str, column: str) -> int:
        """Adds texts as a segment; a key that the index has is replaced, by no text if its text is null now."""
        base = self.segments.latest()
        known = self.segments.read("texts").select("key").join(rows.select(F.col(key).alias("key")), "key", "left_semi").distinct()
        self._write(self._texts(rows, key, column), cut(known), (), base)
        return self.merge()

    def delete(self, keys: DataFrame, key: str) -> int:
        base = self.segments.latest()
        known = self.segments.read("texts").select("key").join(keys.select(F.col(key).alias("key")), "key", "left_semi").distinct()
        return self._write(None, cut(known), (), base)

    def merge(self, whole: bool = False) -> int:
        """Joins the newest segments whose sizes are alike, or all: texts that count no more go. Returns the newest segment."""
        sizes = {r["gen"]: r["docs"] for r in self._totals().select("gen", "docs").collect()}  # a row for each segment
        numbers = self.segments.numbers()
        some: list[int] = []
        held = 0
        for n in reversed(numbers):
            if some and not whole and sizes.get(n, 0) > 2 * held:
                break
            some, held = [n, *some], held + sizes.get(n, 0)
        if len(some) < 2 and not whole:
            return numbers[-1]
        base = self.segments.latest()
        texts = self.segments.read("texts").where(F.col("gen").isin(some))
        kept = self.segments.alive(texts).where("NOT dead").select("key", "n", "t")
        dead = self.segments.read("dead")
        older = None if dead is None or len(some) == len(numbers) else dead.where(F.col("gen").isin(some)).select("key").distinct()
        return self._write(kept, older, some, base)

    def _texts(self, rows: DataFrame, key: str, column: str) -> DataFrame:
        """key, n and t (the tokens, by which a merge needs no text) of rows with a text; of equal keys the one with the largest text.

        Keys are read first: only rows of a key that comes again are dealt by it.
        """
        own = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(column).alias("_text"))
        again = cut(own.groupBy("key").count().where("count > 1").select("key"))
        n = again.count()
        largest = lambda some: some.groupBy("key").agg(F.max("_text").alias("_text"))
        if n > AGAIN:
            own = largest(own)
        elif n:
            own = own.join(F.broadcast(again), "key", "left_anti").unionByName(largest(own.join(F.broadcast(again), "key", "left_semi")))
        return own.where("_text IS NOT NULL").select("key", self.analyzer.tokens(F.col("_text")).alias("t")).select("key", F.size("t").alias("n"), "t")

    def _write(self, texts: DataFrame | None, dead: DataFrame | None, replaces: Sequence[int], base: int) -> int:
        def write(to: str) -> None:
            if texts is not None:
                texts.write.option("compression", "zstd").parquet(f"{to}/texts")
                own = self.spark.read.schema(texts.schema).parquet(f"{to}/texts")
                ints = T.ArrayType(T.IntegerType())
                kinds = {"token": T.StringType(), "block": T.LongType(), "most": T.IntegerType(), "least": T.IntegerType(), "keys": T.ArrayType(texts.schema["key"].dataType), "ns": ints, "ends": ints, "places": ints}
                blocks = own.mapInArrow(_inverted, T.StructType([T.StructField(*x) for x in kinds.items()]))
                blocks.repartitionByRange("token", "block").sortWithinPartitions("token", "block").write.option("compression", "zstd").parquet(f"{to}/postings")
                own.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).write.parquet(f"{to}/totals")
            if dead is not None:
                dead.write.parquet(f"{to}/dead")

        return self.segments.commit(write, replaces, base)

    def _totals(self) -> DataFrame:
        return self.segments.read("totals")

    def _counts(self) -> tuple[int, float]:
        """The number of texts that count, and their mean length."""
        if self.segments.read("dead") is None:
            r = self._totals().agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).first()
        else:
            r = self.segments.alive(self.segments.read("texts").select("key", "n", "gen")).where("NOT dead").agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
        return r["docs"], (r["length"] or 0) / max(1, r["docs"])

    def _frequencies(self, tokens: Sequence[str]) -> dict[str, int]:
        """In how many texts that count each token is."""
        hit = self.segments.read("postings").where(F.col("token").isin(list(tokens)))
        if self.segments.read("dead") is None:
            found = hit.groupBy("token").agg(F.sum(F.size("keys")).alias("df"))
        else:
            found = self.segments.alive(hit.select("token", "gen", F.explode("keys").alias("key"))).where("NOT dead").groupBy("token").agg(F.count("*").alias("df"))
        return {r["token"]: r["df"] for r in found.collect() if r["df"]}  # a row for each token of the query

    def _scored(self, hit: DataFrame, df: dict[str, int], docs: int, mean: float, tokens: Sequence[str], any_: bool, name: str) -> DataFrame:
        """key, score and matches of the texts in some rows of postings."""
        before = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(0))
        one = lambda i: F.struct(F.get("keys", i).alias("key"), F.get("ns", i).alias("n"), F.slice("places", before(i) + 1, F.get("ends", i) - before(i)).alias("places"))
        texts = F.transform(F.sequence(F.lit(0), F.size("keys") - 1), one)
        each = self.segments.alive(hit.select("gen", "token", F.explode(texts).alias("x")).select("gen", "token", "x.*")).where("NOT dead")
        part = _part(F.lit(float(docs)), _lookup(df), F.size("places").cast("double"), F.col("n"), F.lit(mean))
        # Sums in the order of tokens, so that equal texts have equal scores.
        found = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("token", part.alias("part"), "places"))).alias("_parts"))
        found = found if any_ else found.where(F.size("_parts") == len(tokens))
        score = F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x["part"])
        return found.select("key", score.alias(name), F.transform("_parts", lambda x: F.struct(x["token"].alias("token"), x["places"].alias("places"))).alias("matches"))

    def search(self, query: str, any_: bool = False, name: str = "score") -> DataFrame:
        """key, the BM25 score and the matches (token and its places, from 0) of the texts that have all tokens, or any."""
        tokens, df, (docs, mean) = self._asked(query)
        hit = self.segments.read("postings").where(F.col("token").isin(tokens))
        if not df or (not any_ and len(df) < len(tokens)):
            hit, df = hit.limit(0), df or {"": 1}
        return self._scored(hit, df, docs, mean, tokens, any_, name)

    def _asked(self, query: str) -> tuple[list[str], dict[str, int], tuple[int, float]]:
        tokens = query_tokens(self.segments.read("postings"), query, self.analyzer)
        return tokens, self._frequencies(tokens), self._counts()

    def _bounds(self, tokens: Sequence[str], df: dict[str, int], docs: int, mean: float, any_: bool) -> DataFrame:
        """gen, block and a bound on the scores of its texts; postings' texts aren't read."""
        own = _part(F.lit(float(docs)), _lookup(df), F.col("most").cast("double"), F.col("least"), F.lit(mean))
        found = self.segments.read("postings").where(F.col("token").isin(list(tokens))).select("gen", "block", "token", own.alias("_own")).groupBy("gen", "block").agg((F.sum("_own") * (1 + 1e-9)).alias("bound"), F.count("*").alias("_n"))
        return (found if any_ else found.where(F.col("_n") == len(tokens))).drop("_n")

    def top(self, query: str, k: int, any_: bool = False, name: str = "score") -> DataFrame:
        """The k rows of search() with the largest scores, ties by key.

        The blocks with the largest bounds are scored first; then only blocks whose bound isn't below the k-th score found.
        """
        if k < 1:
            raise ValueError("k must be 1 or more")
        tokens, df, (docs, mean) = self._asked(query)
        if not df or (not any_ and len(df) < len(tokens)):
            return self.search(query, any_, name).limit(0)
        bounds = cut(self._bounds(tokens, df, docs, mean, any_))
        postings = self.segments.read("postings").where(F.col("token").isin(tokens))
        # As many blocks as may hold k texts, and a few more.
        lead = bounds.orderBy(F.desc("bound"), "gen", "block").limit(FIRST_BLOCKS + k // (1 << BLOCK_BITS))
        best = self._scored(self._within(postings, lead), df, docs, mean, tokens, any_, name).orderBy(F.desc(name), "key").limit(k).select(name).collect()  # k numbers
        least = best[-1][0] if len(best) == k else 0.0
        left = bounds.where(F.col("bound") >= least)
        return self._scored(self._within(postings, left), df, docs, mean, tokens, any_, name).orderBy(F.desc(name), "key").limit(k)

    @staticmethod
    def _within(postings: DataFrame, blocks: DataFrame) -> DataFrame:
        return postings.join(blocks.select("gen", "block"), ["gen", "block"], "left_semi")

    def blocks_scored(self, query: str, k: int, any_: bool = False) -> tuple[int, int]:
        """How many blocks top() scores, and how many hold the query's tokens."""
        tokens, df, (docs, mean) = self._asked(query)
        bounds = self._bounds(tokens, df, docs, mean, any_)
        best = self.top(query, k, any_).collect()
        least = best[-1]["score"] if len(best) == k else 0.0
        return bounds.where(F.col("bound") >= least).count(), bounds.count()


def _lookup(numbers: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for t, n in numbers.items() for x in (t, float(n))]), F.col("token"))


def fused(rankings: Sequence[DataFrame], key: str, order: str, k: int = 60, name: str = "score", most: int | None = 1000) -> DataFrame:
    """Reciprocal rank fusion of rankings, ordered by a column, larger first.

    The first `most` rows of each count, as one task numbers them; with most=None all do, and are numbered in ranges of the
    order: a row's number is its place in its range and the rows of the ranges before.
    """
    ranked = []
    for r in rankings:
        own = r.select(key, order)
        if most is None:
            ranked.append(_numbered(own, key, order))
        else:
            first = own.orderBy(F.desc(order), key).limit(most)  # so what is numbered is short
            ranked.append(first.select(key, F.row_number().over(Window.orderBy(F.desc(order), key)).alias("_rank")))
    all_ = ranked[0]
    for r in ranked[1:]:
        all_ = all_.unionByName(r)
    return all_.groupBy(key).agg(F.sum(1.0 / (k + F.col("_rank"))).alias(name))


def _numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key and _rank of rows in order, whatever their number: sorted by ranges, each numbered by its task."""
    dealt = cut(rows.repartitionByRange(F.desc(order), F.col(key)).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc(order), key))
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").select(key, (F.col("_before") + F.col("_place")).alias("_rank"))
