"""Answering tables of (drug, food, question) queries against a prepared corpus."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dietlens.constants import FOOD_SIMILARITY_THRESHOLD, IRRELEVANT_WORDS
from dietlens.functions.text import embedding_text, is_not_blank, strip
from dietlens.operators.encode import Encoder
from dietlens.operators.extract import vocabulary
from dietlens.operators.injectables import injectable_drugs
from dietlens.operators.knn import attach_rows, nearest, neighbor_lists
from dietlens.operators.models import classify
from dietlens.operators.reasoning import add_reasoning, add_safety_notes, explanation
from dietlens.operators.relevance import REJECTION_NOTE, check_relevance, drug_vocabulary
from dietlens.operators.sparse import nearest_sparse, sparse
from dietlens.operators.vote import neighbor_vote, severity_info
from dietlens.session import lookup_join, materialize

K_NEIGHBORS = 10


@dataclass
class Corpus:
    """What queries are answered from."""

    rows: DataFrame  # row_id, drug_name, food, severity, interaction_text[, cluster_kmeans]
    vectors: DataFrame  # row_id, embedding[, terms: its values that are not zero]
    encoder: Encoder
    classifier: PipelineModel
    drugs: DataFrame  # drug_key
    injectables: DataFrame  # drug_key
    foods: DataFrame  # food_name and terms or embedding, see `known_foods`


def build_corpus(rows: DataFrame, vectors: DataFrame, encoder: Encoder, classifier: PipelineModel, **rules) -> Corpus:
    """Derives the vocabularies; `rules` go to `injectable_drugs`."""
    if "cluster_kmeans" not in rows.columns:
        rows = rows.withColumn("cluster_kmeans", F.lit(None).cast("int"))
    return Corpus(
        rows=rows,
        vectors=vectors,
        encoder=encoder,
        classifier=classifier,
        drugs=materialize(drug_vocabulary(rows), "drugs"),
        injectables=materialize(injectable_drugs(rows, **rules), "injectables"),
        foods=materialize(known_foods(rows, encoder), "foods"),
    )


def _sparse(texts: DataFrame, text: str, encoder: Encoder, name: str) -> DataFrame:
    if hasattr(encoder, "terms"):
        return encoder.terms(texts, text, "terms").select(name, "terms")
    return encoder(texts, text, "embedding").select(name, sparse("embedding").alias("terms"))


def known_foods(rows: DataFrame, encoder: Encoder) -> DataFrame:
    """(food_name, terms) of the distinct foods for an encoder of sparse vectors, (food_name, embedding) for any other."""
    foods = vocabulary(rows, "food", "food_name")
    return _sparse(foods, "food_name", encoder, "food_name") if hasattr(encoder, "sparse_width") else encoder(foods, "food_name", "embedding")


def resolve_foods(
    queries: DataFrame,
    foods: DataFrame,
    encoder: Encoder,
    query_id: str = "query_id",
    threshold: float = FOOD_SIMILARITY_THRESHOLD,
) -> DataFrame:
    """Adds `resolved_food` and `food_similarity_score`.

    The known food of highest cosine similarity, the first in sort order among equals, replaces the
    typed one if it reaches the threshold. Each distinct typed food is looked up once, by the inverted index
    if `foods` holds sparse vectors (`terms`), see `known_foods`.
    """
    typed = queries.filter(is_not_blank("food")).select("food").distinct()
    typed = typed.withColumn("_food_text", strip("food"))
    if "terms" in foods.columns:
        encoded = materialize(_sparse(typed, "_food_text", encoder, "food"), "typed-foods")
        found = materialize(nearest_sparse(encoded, foods, encoder.sparse_width, "food", "food_name"), "foods")
    else:
        encoded = materialize(encoder(typed, "_food_text", "embedding"), "typed-foods")
        found = materialize(nearest(encoded, foods, 1, query_id="food", row_id="food_name"), "foods")
    best = found.select("food", "food_name", (F.lit(1.0) - F.col("distance")).alias("_similarity"))
    joined = lookup_join(queries, best, "food", [query_id])
    resolved = (
        F.when(F.col("food").isNull(), F.lit(None).cast("string"))
        .when(~is_not_blank("food"), "")
        .when(F.col("_similarity") >= threshold, F.col("food_name"))
        .otherwise(F.col("food"))
    )
    return joined.select(
        *queries.columns,
        resolved.alias("resolved_food"),
        F.coalesce("_similarity", F.lit(0.0)).alias("food_similarity_score"),
    )


def encode_queries(queries: DataFrame, encoder: Encoder, food: str = "food") -> DataFrame:
    """(query_id, query_text, embedding), written once: retrieval and classifier both read it."""
    texts = queries.select("query_id", embedding_text("drug_name", food, "interaction_text").alias("query_text"))
    return materialize(encoder(texts, "query_text", "embedding"), "queries")


def retrieve(encoded: DataFrame, corpus: Corpus, k: int = K_NEIGHBORS) -> DataFrame:
    """(query_id, rank, distance, similarity, corpus columns) of the k nearest rows."""
    stored = "terms" if "terms" in corpus.vectors.columns else "embedding"
    return attach_rows(materialize(nearest(encoded, corpus.vectors, k, row_vector=stored), "nearest"), corpus.rows)


def _with_lists(queries: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Adds `neighbors`; a query that met none keeps an empty list."""
    lists = neighbor_lists(neighbors)
    none = F.array().cast(lists.schema["neighbors"].dataType)
    return queries.join(lists, "query_id", "left").withColumn("neighbors", F.coalesce("neighbors", none))


def zero_shot_severity(queries: DataFrame, corpus: Corpus, k: int = K_NEIGHBORS) -> DataFrame:
    """(query_id, query_text, neighbor_pred, neighbor_confidence, neighbor_distribution, neighbors)."""
    encoded = encode_queries(queries, corpus.encoder)
    neighbors = materialize(retrieve(encoded, corpus, k), "neighbors")
    votes = neighbor_vote(neighbors)
    asked = encoded.select("query_id", "query_text").join(votes, "query_id", "left")
    return _with_lists(asked, neighbors)


def classifier_severity(queries: DataFrame, corpus: Corpus) -> DataFrame:
    """(query_id, classifier_pred, classifier_probs)."""
    return classify(corpus.classifier, encode_queries(queries, corpus.encoder))


def compare_predictions(queries: DataFrame, corpus: Corpus, k: int = K_NEIGHBORS) -> DataFrame:
    """The neighbours' answer beside the classifier's."""
    encoded = encode_queries(queries, corpus.encoder)
    votes = neighbor_vote(retrieve(encoded, corpus, k))
    return encoded.select("query_id").join(votes, "query_id", "left").join(classify(corpus.classifier, encoded), "query_id", "left")


def explain(
    queries: DataFrame,
    corpus: Corpus,
    k: int = K_NEIGHBORS,
    threshold: float = FOOD_SIMILARITY_THRESHOLD,
    irrelevant_words: Iterable[str] = IRRELEVANT_WORDS,
    generated: DataFrame | None = None,
) -> DataFrame:
    """One result per query (query_id, drug_name, food, interaction_text).

    Rejected queries stop after the relevance check: their nested parts are null and their neighbour
    list is empty. Accepted ones have the reason `ok`; one that meets no corpus row has an empty list and no final severity. `generated` optionally holds texts made
    offline from `explanation_prompt`, as (query_id, first_text, second_text).
    """
    checked = materialize(check_relevance(queries, corpus.drugs, irrelevant_words=irrelevant_words), "checked")
    rejected, accepted = checked.filter(~F.col("relevant")), checked.filter("relevant")

    resolved = materialize(
        resolve_foods(
            accepted.select("query_id", "drug_name", "food", "interaction_text"),
            corpus.foods, corpus.encoder, threshold=threshold,
        ),
        "resolved",
    )
    encoded = encode_queries(resolved, corpus.encoder, "resolved_food")
    neighbors = materialize(retrieve(encoded, corpus, k), "neighbors")
    severity = severity_info(neighbor_vote(neighbors), classify(corpus.classifier, encoded))
    answered = _with_lists(resolved, neighbors).join(severity, "query_id", "left")
    reasoned = add_reasoning(answered, corpus.injectables)
    texts = []
    if generated is not None:
        reasoned = reasoned.join(generated, "query_id", "left")
        texts = ["first_text", "second_text"]
    info = F.col("severity_info")
    explained = reasoned.withColumn("_core", explanation(generated=texts)).select(
        *answered.columns,
        F.lit(True).alias("relevant"),
        F.lit("ok").alias("relevance_reason"),
        "reasoning_bundle",
        add_safety_notes("_core", info["final_severity"], info["confidence_level"]).alias("explanation"),
    )
    refused = rejected.select(
        "query_id", "drug_name", "food", "interaction_text", "relevant", "relevance_reason",
        F.array().cast(explained.schema["neighbors"].dataType).alias("neighbors"),
        F.concat("relevance_message", F.lit("\n\n" + REJECTION_NOTE)).alias("explanation"),
    )
    return explained.unionByName(refused, allowMissingColumns=True)


def explanation_records(results: DataFrame) -> DataFrame:
    """The flat columns of results, fit for CSV."""
    return results.select(
        "query_id", "drug_name", "food", "resolved_food", "interaction_text", "relevant", "relevance_reason",
        F.col("severity_info.final_severity").alias("severity"),
        F.col("severity_info.confidence_level").alias("confidence_level"),
        "explanation",
    )
