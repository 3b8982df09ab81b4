"""Registered queries of this subpackage: each applies one operator, with its
production parameters, to its whole table. ``ORACLES`` holds DuckDB SQL for
those that SQL can express; the others are tested against brute force."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (ann, bitslice, bpe, conv_repair, conv_sql, conv_trie, layout_text, mixing, pii, reshard, secrets,
               simhash, toxicity, url_rules)
from .common import table
from .span_sql import PII, SECRETS
from .url_sql import URLS


def tokenizer_path() -> str:
    """The tokenizer file: a parameter, by default the public one installed here."""
    given = os.environ.get("TESSERA_WORD_BPE")
    if given:
        return given
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraps weigh a quarter and short documents half of what others weigh."""
    size = mixing.word_count(F.col("text"))
    weight = F.when(size < 20, 0.25).when(size < 100, 0.5).otherwise(1.0)
    return mixing.mix(table(spark, sf_dir, "documents"), weight=weight)


def op2_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_text.extract(table(spark, sf_dir, "pages"))


def op5_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: op6: the old layout keeps each source's documents in one of eight shards.
SHARDS = 8


def op6_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.pmod(F.xxhash64("source"), F.lit(SHARDS))
    out = scratch_path(spark, f"reshard-{uuid.uuid4().hex}")
    return reshard.resharded(table(spark, sf_dir, "documents"), old, SHARDS, SHARDS, out).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names no repositories: a source is an owner, its documents of
    one language are a repository."""
    docs = table(spark, sf_dir, "documents")
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return secrets.summary(secrets.find_secrets(docs, F.col("source"), repository))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find_pii(table(spark, sf_dir, "documents")))


#: op11: the curated rules, as verdict, host and path.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/"))


def url_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with a label: the verdict of the curated rule that fits; elsewhere bad
    where the document that the page shows (the number in its path) is labelled toxic or
    of no quality."""
    url = F.col("url")
    verdict = url_rules.curated(url_rules.host(url), url_rules.path(url), URL_RULES)[1]
    number = F.nullif(F.regexp_extract(url_rules.path(url), r"^/[^/]+/([0-9]+)", 1), F.lit(""))
    pages = table(spark, sf_dir, "pages").select(
        "url", verdict.alias("verdict"), number.try_cast("long").alias("doc_id"))
    marks = (table(spark, sf_dir, "labels").where("doc_id is not null")
             .groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("marked")))
    return pages.join(marks, "doc_id", "left").select(
        "url", F.coalesce(F.col("verdict") == "block", "marked").alias("bad"))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = url_rules.mine(url_labels(spark, sf_dir))
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES, mined)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conv_repair.report(conversations, conv_repair.damage(conversations), copies=F.col("copies"))


QUERIES = {f.__name__: f for f in (
    op1_mixing, op2_balanced_posting_lists, op3_toxicity, op4_html_text, op5_bit_sliced_topk,
    op6_min_cost_resharding, op7_simhash_near_dedup, op8_secret_ownership, op9_bpe, op10_pii,
    op11_url_rules, op12_conversation_trie, op13_conversation_repair)}

ORACLES = {
    "op1_mixing": r"""
WITH d AS (
  SELECT *, CASE WHEN size < 20 THEN 0.25 WHEN size < 100 THEN 0.5 ELSE 1 END::DOUBLE AS w
  FROM (SELECT doc_id, source,
               CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
        FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END
              ::BIGINT AS w,
         2 * source_size AS most, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM s),
l AS (
  SELECT *, row_number() OVER o AS pos,
         (total - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
           / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY most::DOUBLE / w::DOUBLE, source IS NULL, source)),
f AS (SELECT min(pos) AS pos, arg_min(level, pos) AS level FROM l WHERE level * w <= most),
t AS (
  SELECT source, source_size,
         CASE WHEN f.pos IS NULL OR l.pos < f.pos THEN most::DOUBLE
              ELSE least(f.level * w, most::DOUBLE) END AS target
  FROM l, f),
k AS (
  SELECT t.source, t.source_size, t.target, d.w, sum(d.size)::BIGINT AS words
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
v AS (
  SELECT *, coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM k WINDOW o AS (PARTITION BY source ORDER BY w DESC)),
x AS (SELECT *, CASE WHEN rest > 0 THEN (target - 2 * before) / rest END AS tried FROM v),
y AS (SELECT *, max(CASE WHEN tried * w <= 2 THEN w END) OVER (PARTITION BY source) AS top FROM x),
z AS (SELECT *, max(CASE WHEN w = top THEN tried END) OVER (PARTITION BY source) AS level FROM y),
e AS (SELECT *, coalesce(least(level * w, 2::DOUBLE), 2::DOUBLE) AS expected FROM z),
p AS (
  SELECT *, floor(expected)::BIGINT AS certain, expected - floor(expected) AS chance,
         round(target)::BIGINT - (sum(floor(expected)::BIGINT * words) OVER (PARTITION BY source))::BIGINT AS missing
  FROM e),
u AS (
  SELECT d.doc_id, d.source, d.size, d.w, p.source_size, p.target, p.expected, p.certain, p.chance, p.missing,
         (('0x' || substr(md5('pareto:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE)
           / 281474976710656::DOUBLE AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.w = p.w),
q AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) * ((1 - chance) / chance) END AS q FROM u),
c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM q)
SELECT doc_id, source, size, source_size, target, expected,
       (certain * size + CASE WHEN chance > 0 THEN greatest(0, least(size, missing - before)) ELSE 0 END)::BIGINT AS taken
FROM c
""",
    "op5_bit_sliced_topk": """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op8_secret_ownership": SECRETS,
    "op10_pii": PII,
    "op11_url_rules": URLS,
    "op12_conversation_trie": conv_sql.TRIE,
    "op13_conversation_repair": conv_sql.REPAIR,
}
