"""The operators' queries: name -> function of (session, data folder), and DuckDB SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filteraudit, htmltext, langid, media, mtree, neardup, packing, quality, secrets, sharding, tokencount, vectorcodes
from .common import checkpoint_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, each document ended by token 0."""
    parts = packing.pieces(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(parts)


def op2_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for each row whose id is divisible by 50, by the inner product of quantised vectors."""
    rows = mtree.quantised(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return mtree.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules find in every document, by a ledger of their blobs that begins empty."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    ledger = secrets.update_ledger(docs, f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}")
    return secrets.report(secrets.known(docs, ledger))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = langid.held_out()
    found = langid.identify(docs, langid.learn(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return htmltext.extract(pages, htmltext.train(pages))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade, its probability of the top grade, and whether it stays."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.rate(docs, quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an 8-bit image and read back."""
    return media.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard after documents came in two arrivals."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wave = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    shards = sharding.ShardSet(spark, f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}")
    rows = sharding.ingest([docs.where(wave == 0), docs.where(wave == 1)], shards).read()
    return rows.select("doc_id", F.col(rows.columns[-1]).alias("shard"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near duplicates and its number of links."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector's code of 8 parts, its error, its label's, and the codebooks' digest."""
    return vectorcodes.compressed(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "vec_id", "embedding", "label")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep, remove and lose in every language, order and step."""
    return filteraudit.audit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens, and whether it has more than 512."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), 512)


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_mtree_top_k": op2_mtree_top_k,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_html_text": op5_html_text,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_media_columns": op8_media_columns,
    "op9_sharding": op9_sharding,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_counts": op13_token_counts,
}


def _spans_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
      SELECT doc_id, '{kind}' AS kind, {order} AS kind_order, part,
             gaps + lens AS stop, gaps + lens - len AS start
      FROM (
        SELECT doc_id, length(part) AS part, length(whole) AS len,
               list_sum(list_transform(pieces[1:i], lambda x: length(x))) AS gaps,
               list_sum(list_transform(wholes[1:i], lambda x: length(x))) AS lens
        FROM (
          SELECT doc_id, pieces, wholes, unnest(wholes) AS whole, unnest(parts) AS part, unnest(range(1, len(wholes) + 1)) AS i
          FROM (
            SELECT doc_id, string_split_regex(text, '{quoted}') AS pieces,
                   regexp_extract_all(text, '{quoted}') AS wholes,
                   regexp_extract_all(text, '{quoted}', {group}) AS parts
            FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
            WHERE regexp_matches(text, '{quoted}')
          )
        )
      )
      WHERE part >= {least}"""


def secrets_sql() -> str:
    spans = " UNION ALL ".join(_spans_sql(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(secrets.RULES))
    return f"""
    WITH spans AS ({spans}),
    found AS (
      SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind_order, stop) AS spans
      FROM spans GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN found USING (doc_id)"""


TOP_K_SQL = """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    ),
    ranked AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
      FROM scored
    )
    SELECT * FROM ranked WHERE rank <= 5"""

def codes_sql(parts: int = vectorcodes.PARTS, entries: int = vectorcodes.ENTRIES, rounds: int = vectorcodes.ROUNDS) -> str:
    """A step of the common table expressions for each round."""
    steps = f"""
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER () AS id, vec_id, label, len(embedding) // {parts} AS w,
             list_transform(embedding, lambda x: floor({vectorcodes.SCALE} * CAST(x AS DOUBLE))) AS v
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    parts AS MATERIALIZED (SELECT id, vec_id, w, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, range({parts}) t(p)),
    c0 AS MATERIALIZED (
      SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts WHERE vec_id IS NOT NULL)
      WHERE e < {entries}
    )"""
    for k in range(rounds + 1):
        steps += f""",
    a{k} AS MATERIALIZED (
      SELECT id, p, any_value(w) AS w, any_value(a.x) AS x,
             min((list_inner_product(a.x, a.x) - 2 * list_inner_product(a.x, c.x) + list_inner_product(c.x, c.x)) * {entries} + e) AS m
      FROM parts a JOIN c{k} c USING (p) GROUP BY id, p
    )"""
        if k < rounds:
            steps += f""",
    s{k} AS MATERIALIZED (
      SELECT p, e, list(floor(s / n) ORDER BY j) AS x
      FROM (SELECT p, CAST(m % {entries} AS BIGINT) AS e, j, sum(x[j]) AS s, count(*) AS n FROM (SELECT p, m, x, unnest(range(1, w + 1)) AS j FROM a{k}) GROUP BY ALL)
      GROUP BY p, e
    ),
    c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(s.x, c.x) AS x FROM c{k} c LEFT JOIN s{k} s USING (p, e))"""
    return f"""{steps},
    coded AS (
      SELECT id, string_agg(printf('%02x', CAST(m % {entries} AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(floor(m / {entries})) AS BIGINT) AS error
      FROM a{rounds} GROUP BY id
    ),
    books AS (
      SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256
      FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS j FROM c{rounds})
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (id), books"""


AUDIT_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    words AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
    leasts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
    told AS (
      SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
    ),
    masks AS (
      SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             CAST(len(words) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT)
             + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INT)
             + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS mask
      FROM words JOIN leasts USING (text) LEFT JOIN told USING (doc_id)
    ),
    counted AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (
      SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
    ),
    steps AS (
      SELECT o, step, 1 << (ascii(o[step]) - 65) AS own, coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(o[k]) - 65))), 0) AS before
      FROM orders, range(1, 6) t(step)
    )
    SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step,
           CAST(coalesce(sum(n) FILTER (mask & own = 0 AND mask & before = 0), 0) AS BIGINT) AS kept,
           CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
           CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
           CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
           CAST(coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
           CAST(coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
           CAST(coalesce(sum(n * (120 // greatest(1, bit_count(mask)))) FILTER (mask & own <> 0), 0) AS BIGINT) AS shapley
    FROM counted, steps GROUP BY part, o, step"""

ORACLE_SQL: dict[str, str] = {
    "op2_mtree_top_k": TOP_K_SQL,
    "op3_secret_scan": secrets_sql(),
    "op11_vector_codes": codes_sql(),
    "op12_filter_audit": AUDIT_SQL,
}
