"""The stages against plain versions, and every query on the smallest tables."""

import hashlib

import brute
import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from check_oracle import TABLES, rows_of
from dietlens.llm import oracle, queries, quality


def test_stages_equal_brute_force(spark, docs, sf_dir):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    step = {}
    now = docs
    for name in names:
        now = corpus_pipeline.materialize(stage[name](spark, now, sf_dir))
        step[name] = now
        if name != names[-1]:
            assert now.columns == docs.columns
    ids = {k: sorted(r.doc_id for r in v.select("doc_id").collect()) for k, v in step.items()}
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = sorted(r.doc_id for r in quality.judge(docs).filter("kept").collect())
    assert ids[names[0]] == kept
    exact = brute.exact([(k, text[k]) for k in kept])
    kept = [k for i, k in enumerate(kept) if exact[i][2]]
    assert ids[names[1]] == kept
    near = brute.components([(k, brute.simhash(text[k])) for k in kept])
    kept = [k for k in kept if near[k] == k]
    assert ids[names[2]] == kept
    mixed = ids[names[3]]
    assert set(mixed) <= set(kept) and max(mixed.count(k) for k in set(mixed)) <= 3
    assert sum(len(brute.tokens(text[k])) for k in mixed) == pytest.approx(sum(len(brute.tokens(text[k])) for k in kept), rel=0.03)
    assert ids[names[4]] == mixed
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in step[names[4]].collect():
        found = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs):
    for table in (odd_docs, no_docs):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.materialize(stage(spark, now, ""), name.replace(" ", "-"))
            assert now.columns == odd_docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, "").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries()) and set(oracle.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = connection.execute(oracle.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
