from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import bpe, mixing, queries, simhash, toxicity

from . import brute
from .conftest import SMALL, TEXTS


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SMALL)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted(
        (tuple(r[c] for c in cols) for r in rows), key=repr)


def test_stages_by_hand(spark):
    """Each stage on what its predecessor kept, against plain versions."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, SMALL).checkpoint()
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - toxic
    assert kept.dtypes == docs.dtypes

    once = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, kept, SMALL).checkpoint()
    rows = kept.collect()
    groups = brute.components([r.doc_id for r in rows], [brute.fingerprint(r.text) for r in rows])
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(groups)) and once.dtypes == docs.dtypes

    clean = dict(corpus_pipeline.STAGES)["pii"](spark, once, SMALL).checkpoint()
    assert clean.count() == once.count() and clean.dtypes == docs.dtypes
    assert not any(brute.pii_spans(r.text.replace("<", " ").replace(">", " ")) for r in clean.collect())

    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, clean, SMALL).checkpoint()
    assert mixed.dtypes == docs.dtypes
    assert sum(brute.words(r.text) for r in mixed.collect()) == sum(r.taken for r in mixing.mix(clean).collect())

    coded = dict(corpus_pipeline.STAGES)["bpe"](spark, mixed, SMALL).collect()
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for r in mixed.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), brute.sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in coded) == sorted(want)


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "bpe"]
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256"]


def test_stages_on_odd_rows_and_nothing(spark, odd, none):
    for given in (odd, none):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name != "bpe":
                assert out.columns == docs.columns
            out = out.checkpoint()
            assert (out.count() > 0) == (given is odd)
            docs = out if name != "bpe" else docs
    assert len(TEXTS) == 23


def test_shared_parameters():
    assert simhash.near_duplicates.__defaults__[:2] == (3, 2) and bpe.CHUNK > 0
