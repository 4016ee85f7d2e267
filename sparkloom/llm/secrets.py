"""Secret scans by an incremental blob ledger, in DataFrame functions only.

Every version of a document is addressed by the SHA-256 of its text.  The ledger
holds the (blob, rule version) pairs that were scanned, what was found in them,
and which documents have had which blobs.  A rule's version is a digest of the
rule itself, so a rule that is new or has changed scans every blob once, and the
others none again.  A scan looks only at pairs that are not there yet, one text
for each blob, and joins the findings back to all rows, or to all versions ever
seen, that carry the blob.  What a run adds is published by one rename.

Spans with one start come in the order of their rules, then by their ends.  Null texts count as empty.  Offsets are code points, end exclusive.  Repeated
rows stay repeated.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..generations import Generations, Taken
from .common import whole


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches count if `group` has `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        """A digest of all that decides what the rule finds."""
        return hashlib.sha256(json.dumps([self.kind, self.pattern, self.group, self.least]).encode()).hexdigest()[:16]


# The kinds of secrets, in the order of reports.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)


def blobs_of(docs: DataFrame) -> DataFrame:
    """The rows' ids, texts and content addresses."""
    return docs.select("doc_id", whole().alias("text")).withColumn("blob", F.sha2("text", 256))


def _matches(rule: Rule, order: int, asked: Column) -> Column:
    """If the rule is asked for, for each match its number and the lengths of the gap before it, of itself and of the group."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
    )
    one = lambda x, i: F.struct(
        F.lit(order).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["all"]).alias("len"), F.length(x["part"]).alias("part")
    )
    found = F.filter(F.transform(zipped, one), lambda x: x["len"].isNotNull())
    return F.when(asked & text.rlike(rule.pattern), found).otherwise(F.slice(found, 1, 0))


def _located(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, kind number, start, end, counts) of all matches in distinct blobs, by the rules of their column rules if they have one; one row without a kind for a blob that has none."""
    asked = lambda r: F.array_contains("rules", r.version) if "rules" in blobs.columns else F.lit(True)
    own = [c for c in ("blob", "rules") if c in blobs.columns]
    found = blobs.select(*own, F.explode_outer(F.flatten(F.array(*(_matches(r, k, asked(r)) for k, r in enumerate(rules))))).alias("m")).select(*own, "m.*")
    before = Window.partitionBy("blob", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("kind") + 1)
    counts = F.coalesce(F.col("part") >= least, F.lit(False))
    return found.select(*own, "kind", "len", end.alias("end"), counts.alias("counts")).select(*own, "kind", (F.col("end") - F.col("len")).alias("start"), "end", "counts")


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind number, start, end) of what the rules find in the texts of distinct blobs."""
    return _located(blobs, rules).where("counts").select("blob", "kind", "start", "end")


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, text and rules: one text for each blob, and the versions of the rules that the ledger doesn't have for it."""
    texts, versions = blobs.select("blob", "text").dropDuplicates(["blob"]), F.array(*(F.lit(r.version) for r in rules))
    if ledger is None:
        return texts.withColumn("rules", versions)
    had = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("_had"))
    left = F.when(F.col("_had").isNull(), versions).otherwise(F.array_except(versions, "_had"))
    return texts.join(had, "blob", "left").select("blob", "text", left.alias("rules")).where(F.size("rules") > 0)


def ledger_rows(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: blob, the versions of its rules and all their findings in order, for what unseen() gives, with findings or without."""
    version = F.element_at(F.array(*(F.lit(r.version) for r in rules)), F.col("kind") + 1)
    one = F.when(F.col("counts"), F.struct("start", "end", version.alias("rule")))
    return _located(texts, rules).groupBy("blob").agg(F.first("rules").alias("rules"), F.sort_array(F.collect_list(one)).alias("findings"))


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what is new in docs, adds it to the ledger at path and returns all that was scanned: blob, rules and findings.

    What a run adds is staged first and counts once it is renamed, so a run that fails adds nothing, and the next one scans the same pairs.
    """
    held = Generations(docs.sparkSession, path)
    while True:
        known, paths, base = held.read("scans"), held.read("paths"), held.latest()
        blobs = blobs_of(docs)
        seen = blobs.select("doc_id", "blob").distinct()
        if paths is not None:
            own = paths.select(F.col("doc_id").alias("_id"), F.col("blob").alias("_blob"))
            seen = seen.join(own, (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")

        def write(to: str, known=known, blobs=blobs, seen=seen) -> None:
            ledger_rows(unseen(blobs, known, rules), rules).write.parquet(f"{to}/scans")
            seen.write.parquet(f"{to}/paths")

        try:
            held.commit(write, (), base)
        except Taken:  # another run's was first: what it has scanned needs no second scan
            continue
        return held.read("scans").drop("gen")


def history(spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob and findings (null for none) of every version of every document that the ledger at path has seen."""
    held = Generations(spark, path)
    return held.read("paths").select("doc_id", "blob").distinct().join(_found(held.read("scans"), rules), "blob", "left").select("doc_id", "blob", "findings")


def _found(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob and its findings by the rules, as (start, kind number, end) in order, of blobs that have some."""
    number = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.version, k)))
    all_ = ledger.where(F.size("findings") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("all"))
    own = F.transform(F.filter("all", lambda x: F.element_at(number, x["rule"]).isNotNull()), lambda x: F.struct(x["start"].alias("start"), F.element_at(number, x["rule"]).alias("kind"), x["end"].alias("end")))
    return all_.select("blob", F.sort_array(own).alias("findings")).where(F.size("findings") > 0)


def known(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row's doc_id and blob with its findings (null for none), all from a ledger that has docs' blobs."""
    return blobs_of(docs).select("doc_id", "blob").join(_found(ledger, rules), "blob", "left")


def findings(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row's doc_id and blob with its findings, from the ledger where it has them.

    Without a ledger, only blobs with findings go through the join, as rows without have none.
    """
    blobs = blobs_of(docs)
    if ledger is None:
        found = scan(unseen(blobs, None, rules).drop("rules"), rules).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("findings"))
    else:
        new = ledger_rows(unseen(blobs, ledger, rules), rules)
        found = _found(ledger.select("blob", "rules", "findings").unionByName(new), rules)
    return blobs.select("doc_id", "blob").join(found, "blob", "left")


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count for each kind, the spans as text and their SHA-256."""
    spans = F.coalesce(F.array_join(F.transform("findings", lambda x: F.concat_ws(":", F.element_at(F.array(*(F.lit(r.kind) for r in rules)), x["kind"] + 1), x["start"], x["end"])), ","), F.lit(""))
    counts = [F.coalesce(F.array_size(F.filter("findings", _of_kind(k))), F.lit(0)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(rules)]
    return found.withColumn("spans", spans).select("doc_id", *counts, F.sha2("spans", 256).alias("base_sha256"), "spans")


def _of_kind(k: int):
    return lambda x: x["kind"] == k


def redact(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret span replaced by its kind in brackets; other columns stay.

    A ledger must have docs' blobs (update_ledger); without one the texts are scanned now.
    Overlapping spans become one, named by the first.  A null text stays null.
    """
    own = docs.select("doc_id", "text")
    found = (findings(own, None, rules) if ledger is None else known(own, ledger, rules)).where(F.size("findings") > 0).select(F.col("blob").alias("_blob"), F.col("findings").alias("_found")).dropDuplicates(["_blob"])
    kinds, text = F.array(*(F.lit(f"[{r.kind}]") for r in rules)), F.col("text")
    piece = lambda a, x: F.concat(a["out"], F.substring(text, a["pos"] + 1, x["start"].cast("int") - a["pos"]), F.element_at(kinds, x["kind"] + 1))
    step = lambda a, x: F.struct(F.greatest(a["pos"], x["end"].cast("int")).alias("pos"), F.when(x["start"] >= a["pos"], piece(a, x)).otherwise(a["out"]).alias("out"))
    clean = F.aggregate("_found", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))
    joined = docs.withColumn("_blob", F.sha2(whole(), 256)).join(found, "_blob", "left")
    return joined.withColumn("text", F.when(F.col("_found").isNull(), text).otherwise(clean)).select(*docs.columns)
