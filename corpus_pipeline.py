"""A corpus pipeline: five stages over ``documents``, each written as Parquet to
the shared folder and read again by the next.

Toxic documents go, one document of each group of near copies stays, personal
data are replaced by their kind, the sources are mixed to their target weights
and the mix is tokenised.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, pii, simhash, toxicity
from tessera.llm.common import modest_batches, table
from tessera.llm.queries import tokenizer_path
from tessera.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, shingle=3, max_distance=2)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.materialise(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy of the mix with its token ids (packed), their number, and the
    digest of the text that they decode to."""
    modest_batches(spark)
    coded = docs.select("doc_id", "lang", "source",
                        bpe.encoded_and_decoded(F.col("text"), tokenizer_path()).alias("coded"))
    return coded.select("doc_id", "lang", "source", "coded.ids",
                        (F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2(F.col("coded.decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: A trained classifier, XXH64 and BPE are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = scratch_path(spark, f"corpus-pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        out = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
