import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from dietlens.llm import dedup, mixing, quality, simhash
from dietlens.llm.common import identified


def test_measures_equal_brute_force(odd_docs, docs):
    for table in (odd_docs, docs):
        judged = quality.judge(table.withColumn("whole", F.col("text")), keep=["doc_id", "whole"]).collect()
        assert len(judged) == table.count()
        for r in judged:
            assert tuple(r[c] for c in quality.BASE) == brute.quality(r.whole)
            failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert r.base_failed == failed and (not failed or not r.kept)


def test_verdicts(odd_docs):
    judged = {r.doc_id: r for r in quality.judge(odd_docs.filter("doc_id IS NOT NULL")).collect()}
    assert judged[1].kept and judged[15].kept
    assert not any(judged[k].kept for k in (3, 4, 5, 12, 16, 18, 19))
    assert set(judged[19].failed) >= {"symbols"}


def test_labelled_documents(docs, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.judge(docs).join(labels, "doc_id")
    assert judged.filter("quality = 0 AND kept").count() == 0
    clean = judged.filter("quality = 1 AND NOT base_failed")
    assert clean.filter("kept").count() >= 0.97 * clean.count()


def test_no_user_function_and_no_shuffle(docs):
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_of_no_rows(no_docs):
    assert quality.judge(no_docs).count() == 0
    assert quality.kept_rows(no_docs).columns == no_docs.columns


def test_rows_keep_their_columns(odd_docs):
    kept = quality.kept_rows(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.filter("doc_id = 9").count() == 3 and kept.filter("size <> 'size'").count() == 0


@pytest.mark.parametrize("bits", [64, 6, 1])
def test_dedup_equals_brute_force(odd_docs, bits):
    whole, row = identified(odd_docs)
    rows = whole.select("doc_id", "text", *row).orderBy(*row).collect()
    got = {tuple(r[c] for c in row): r for r in dedup.dedupe(whole, keep=row, hash_bits=bits).collect()}
    want = brute.exact([(r.doc_id, r.text) for r in rows])
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        g = got[tuple(r[c] for c in row)]
        assert (g.keep_id, g.group_size, g.kept) == want[k]
        assert g.text_sha256 == hashlib.sha256(brute.squeezed(r.text).encode()).hexdigest()


def test_dedup_leaves_one_row_of_each_group(odd_docs, no_docs):
    kept = dedup.kept_rows(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [brute.squeezed(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({brute.squeezed(r.text) for r in odd_docs.collect()})
    assert dedup.dedupe(no_docs).count() == 0 and dedup.kept_rows(no_docs).count() == 0


def test_chunks_cover_texts_and_follow_content():
    text = random.Random(1).randbytes(60_000)
    ends = dedup.chunk_ends(text)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(text) and max(sizes) <= dedup.MOST and min(sizes[:-1]) >= dedup.LEAST
    chunks = {text[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    moved = b"a few more bytes in front" + text
    ends = dedup.chunk_ends(moved)
    again = {moved[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    assert len(chunks & again) > 0.5 * len(chunks)
    assert dedup.chunk_ends(b"") == [] and dedup.chunk_ends(b"x") == [1]
    assert dedup.chunk_ends(b"x" * 100_000)[-1] == 100_000


def test_frames_without_files_are_identified(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "ab"), (None, None)]
    kept = dedup.kept_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [(1, "a b")]


def test_hot_group(spark, monkeypatch):
    from dietlens.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 20)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = dedup.dedupe(rows)
    assert got.filter("kept").count() == 2001 and got.filter("keep_id = 0 AND group_size = 1000").count() == 1000


def test_columns_of_any_name(spark):
    rows = [(1, "a b", "x", "y"), (2, "ab", "x", "y"), (3, "c d e f", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, `q``q` string")
    for kept in (dedup.kept_rows(docs), simhash.kept_rows(docs), quality.kept_rows(docs, min_words=0), mixing.mixed_rows(docs.withColumn("source", F.lit("s")))):
        assert kept.columns[:4] == ["doc_id", "text", "a.b", "q`q"]
        assert kept.count() <= 3
