"""One query per operator over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dietlens.llm import (
    bpe, chosen_path, dedup, hard_negatives, html_text, mixing, pii, quality, secrets, signature_search, simhash, spans, url_filter, warc,
)
from dietlens.llm.common import table


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Number and digest of the ids of each document, and the digest of the text decoded from them."""
    vocabulary = bpe.load(path or public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.encode(docs, vocabulary, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encoded(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through the capture index."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def _of(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def _base(found: str, kinds: list[str]) -> Column:
    return F.sha2(spans.listed(F.filter(found, lambda s: s["kind"].isin(kinds))).cast("binary"), 256)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, through a fresh ledger."""
    found, _ = secrets.scan(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secrets.BASE]
    return found.select(
        "doc_id", *[_of("found", k).alias(f"n_{k}") for k in kinds],
        _base("found", kinds).alias("base_sha256"), spans.listed(F.col("found")).alias("spans"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, base verdict and the verdict of the threshold table of every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept", F.concat_ws(",", "failed").alias("failed_rules"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, representative and verdict of every document."""
    return dedup.dedupe(table(spark, sf_dir, "documents"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    found = html_text.extract(pages, html_text.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans, and those that the trained classifier adds."""
    found, _ = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[_of("base", k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(spans.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans.listed(F.concat("base", "added")).alias("spans"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every item of the benchmark."""
    return signature_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every fiftieth vector; every seventh has the label behind its own."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_minhash": op11_minhash,
    "op12_search": op12_search,
    "op13_hard_negatives": op13_hard_negatives,
}
