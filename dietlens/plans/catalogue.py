"""The operators on the driver's tables, one query per name.

The tables hold invented words, so the rules below are made of words that occur in them. Lines of
`documents` are advice texts and `source` is the drug; `conversations` are questions; `embeddings`
is a vector store whose `label` is the severity; `labels` gives the fallback answers. Every query
reads its tables whole. Floats are rounded and lists joined to text, so that results compare.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dietlens.constants import SEVERITY_ORDER
from dietlens.functions import severity as S
from dietlens.functions import text as T
from dietlens.functions import vectors as V
from dietlens.operators import cluster, encode, extract, injectables, keys, knn, metrics, models, reasoning, relevance, split, vote
from dietlens.operators.sparse import sparse
from dietlens.plans import answer, prepare
from dietlens.session import materialize, new_path, release, spread
from dietlens.sources import records, store

LEXICON = ["the", "of the", "to be", "der", "die", "nicht die", "la", "les", "de la", "que", "être", "worth"]
GENERIC = ["the", "der", "die", "la", "les", "que"]
MARKERS = ["with", "for", "from"]
PATTERNS = {
    "severe": ["worth", "which", "were"],
    "moderate": ["from", "with(s|out)?"],
    "minor": ["that", "this"],
    "info": ["the", "les"],
}
IV_WORDS = ["license", "zz", "th the"]
ORAL_WORDS = ["worth", "hshs", "oil the", "quee"]
OFF_TOPIC = ["zz", "server", "shhe"]
MECHANISMS = {
    "bleeding": ["license", "server"],
    "cyp3a4": ["hshs"],
    "vitamin_k": ["zz"],
    "absorption": ["worth"],
    "alcohol": ["erhath"],
}
THINNING = ["es"]
CURATED = ["src0-de", "src1-fr"]
K = 5
BIN = 0.05
EPS, MIN_POINTS, MIN_SIZE = 0.02, 4, 6
DIMENSIONS = 64
AXES = tuple([math.sqrt(2 / DIMENSIONS) * f(2 * math.pi * (k + 0.5) / DIMENSIONS) for k in range(DIMENSIONS)] for f in (math.cos, math.sin))
TFIDF_SIZE = encode.EMBEDDING_SIZE

_KEY = ["doc_id", "text_pos"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def lines(spark, sf_dir) -> DataFrame:
    return records.split_lines(table(spark, sf_dir, "documents"), "doc_id", "source", "text").drop("reference")


# Texts and rules

def severity_counts(spark, sf_dir):
    """Advice lines per severity level: the flagship."""
    return (
        lines(spark, sf_dir)
        .select(S.classify_severity(T.normalize_text("interaction_text"), PATTERNS).alias("severity"))
        .groupBy("severity").agg(F.count("*").alias("n"))
    )


def explode_lines(spark, sf_dir):
    return lines(spark, sf_dir).withColumn("text_pos", F.col("text_pos").cast("long"))


def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.normalize_text("text").alias("normalized"), T.word_count("text").cast("long").alias("n_words")
    )


def lexicon_match(spark, sf_dir):
    hits = T.sorted_distinct(T.lexicon_hits(T.normalize_text("text"), LEXICON))
    return table(spark, sf_dir, "documents").select("doc_id", T.join_terms(hits).alias("terms"))


def lexicon_match_join(spark, sf_dir):
    """The large-lexicon form, with every word of `benchmark` as the lexicon."""
    word = F.explode(F.regexp_extract_all(T.normalize_text("text"), F.lit(f"({T.WORD}+)"), F.lit(1)))
    lexicon = table(spark, sf_dir, "benchmark").select(word.alias("term")).distinct()
    found = extract.match_terms_by_join(table(spark, sf_dir, "documents"), "doc_id", "text", lexicon)
    return found.select("doc_id", "term")


def lexicon_file(spark, sf_dir):
    """A lexicon file with the words of `benchmark` added to built-in terms."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("value"))
    path = new_path(spark, "lexicon")
    words.write.text(path)
    return records.load_lexicon(spark, path, LEXICON)


def extract_terms_join(spark, sf_dir):
    """Terms and listed items with a lexicon table too large for one expression."""
    word = F.explode(F.regexp_extract_all(T.normalize_text("text"), F.lit(f"({T.WORD}+)"), F.lit(1)))
    lexicon = table(spark, sf_dir, "benchmark").select(word.alias("term")).distinct()
    found = extract.extract_with_lexicon_table(table(spark, sf_dir, "documents"), "doc_id", "text", lexicon, MARKERS)
    return found.select("doc_id", F.md5(T.join_terms("food_entities")).alias("terms"))


def enumeration_extract(spark, sf_dir):
    items = T.enumeration_items(T.normalize_text("text"), MARKERS)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(items, "|").alias("items"))


def _extracted(spark, sf_dir, answers=None):
    return prepare.extracted_rows(lines(spark, sf_dir), _KEY, answers, LEXICON, MARKERS, GENERIC)


def extract_terms(spark, sf_dir):
    return _extracted(spark, sf_dir).select("doc_id", F.col("text_pos").cast("long").alias("text_pos"), "food_entities_str")


def low_information(spark, sf_dir):
    found = T.extract_terms("text", LEXICON, MARKERS)
    lexical = T.lexicon_hits(T.normalize_text("text"), LEXICON)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.is_low_information(found, GENERIC).alias("low_all"),
        T.is_low_information(lexical, GENERIC).alias("low_lexicon"),
    )


def flatten_terms(spark, sf_dir):
    flat = extract.flatten_terms(_extracted(spark, sf_dir).drop("food_entities_str", "interaction_text"), "food_entities")
    return flat.select("doc_id", F.col("text_pos").cast("long").alias("text_pos"), "drug_name", "food")


def severity_label(spark, sf_dir):
    return lines(spark, sf_dir).select(
        "doc_id", F.col("text_pos").cast("long").alias("text_pos"),
        S.classify_severity("interaction_text", PATTERNS).alias("rule_label"),
    )


def _answers(spark, sf_dir, raw_response):
    """Answers for every line of the labelled documents; those for quality 0 with toxic 1 have failed."""
    status = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "quota").otherwise("ok")
    return lines(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select(
        *_KEY, raw_response.alias("raw_response"), status.alias("status")
    )


def final_label(spark, sf_dir):
    response = F.when(F.col("toxic") == 1, " SEVERE, certainly").when(F.col("quality") == 1, "Moderate.").otherwise("minor")
    labelled = extract.label_with_answers(
        lines(spark, sf_dir), "interaction_text", _KEY, _KEY, _answers(spark, sf_dir, response), PATTERNS
    )
    return labelled.select("doc_id", F.col("text_pos").cast("long").alias("text_pos"), "rule_label", "severity")


def extract_with_answers(spark, sf_dir):
    response = F.concat(F.lit('Found: ["zucchini", "'), F.col("doc_id").cast("string"), F.lit('", null, '), F.col("quality").cast("string"), F.lit(', {"a": 1}] end'))
    rows = _extracted(spark, sf_dir, _answers(spark, sf_dir, response))
    return rows.select("doc_id", F.col("text_pos").cast("long").alias("text_pos"), "food_entities_str")


def unresolved_prompts(spark, sf_dir):
    unresolved = lines(spark, sf_dir).filter(S.classify_severity("interaction_text", PATTERNS) == "unknown")
    return unresolved.select(
        "doc_id", F.col("text_pos").cast("long").alias("text_pos"),
        F.md5(T.labelling_prompt("interaction_text")).alias("label_prompt"),
        F.md5(T.extraction_prompt("interaction_text")).alias("extract_prompt"),
    )


def parse_food_list(spark, sf_dir):
    raw = F.concat(
        F.lit("Answer:\n[\" "), F.col("event_type"), F.lit(" \", "), F.col("value").cast("string"), F.lit(", "),
        F.col("user_id").cast("string"), F.lit(", null, [3], "), F.col("props"), F.lit("] - done"),
    )
    return table(spark, sf_dir, "events").select("event_id", F.array_join(T.parse_food_list(raw), "|").alias("foods"))


def embedding_text(spark, sf_dir):
    flat = extract.flatten_terms(_extracted(spark, sf_dir).drop("food_entities_str"), "food_entities")
    return flat.select(
        "doc_id", F.col("text_pos").cast("long").alias("text_pos"), "food",
        F.md5(T.embedding_text("drug_name", "food", "interaction_text")).alias("embedding_text"),
    )


def head_rows(spark, sf_dir):
    return explode_lines(spark, sf_dir).orderBy(*_KEY).limit(10)


# Keys

def row_key(spark, sf_dir):
    return keys.add_row_id(explode_lines(spark, sf_dir).select("doc_id", "text_pos", "drug_name"), _KEY)


def alignment(spark, sf_dir):
    return keys.unaligned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def id_range_check(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    return keys.unknown_ids(ids, table(spark, sf_dir, "embeddings"), "vec_id")


def category_codes(spark, sf_dir):
    coded = keys.add_category_code(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"])
    return coded.select("doc_id", "source", "code")


def vocabulary(spark, sf_dir):
    return extract.sorted_vocabulary(table(spark, sf_dir, "documents"), "source")


def vocabulary_counts(spark, sf_dir):
    return lines(spark, sf_dir).agg(
        F.count("*").alias("num_rows"),
        F.countDistinct(F.lower("drug_name")).alias("num_drugs"),
        F.countDistinct("doc_id").alias("num_documents"),
    )


# Vectors and neighbours

def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", "label")


def _neighbors(spark, sf_dir, k=K):
    """All vectors as queries against all vectors, each neighbour with its label."""
    vectors = _vectors(spark, sf_dir)
    found = materialize(knn.nearest(vectors.withColumnRenamed("row_id", "query_id"), vectors, k), "nearest")
    return knn.attach_rows(found, vectors.select("row_id", F.col("label").alias("severity")))


def l2_normalize(spark, sf_dir):
    """Unit length for vectors scaled by their label; label 0 makes zero vectors."""
    scaled = table(spark, sf_dir, "embeddings").withColumn("scaled", F.transform("embedding", lambda x: x * F.col("label")))
    unit = scaled.select("vec_id", V.l2_normalize("scaled").alias("unit"))
    return unit.select("vec_id", F.round(V.dot("unit", "unit"), 6).alias("sq_norm"), F.round(F.col("unit")[0], 6).alias("first_value"))


def cosine_pairs(spark, sf_dir):
    """Each vector against the one before it."""
    vectors = _vectors(spark, sf_dir)
    before = vectors.select((F.col("row_id") + 1).alias("row_id"), F.col("embedding").alias("other"))
    return vectors.join(before, "row_id").select("row_id", F.round(V.cosine_distance("embedding", "other"), 6).alias("distance"))


def _ranked(neighbors):
    return neighbors.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "row_id",
        F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"),
    )


def knn_exact(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return _ranked(knn.nearest(vectors.withColumnRenamed("row_id", "query_id"), vectors, 10))


def knn_blocked(spark, sf_dir):
    """The same neighbours by the form for queries and corpus too large to broadcast: slices that all queries meet."""
    vectors = _vectors(spark, sf_dir)
    found = knn.nearest(vectors.withColumnRenamed("row_id", "query_id"), vectors, 10, broadcast_bytes=1 << 14, slice_bytes=1 << 15)
    return _ranked(found)


def knn_by_id(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id")).join(vectors, "row_id", "left_semi")
    found = materialize(knn.nearest_by_row_id(ids, vectors, K), "nearest")
    return knn.attach_rows(_ranked(found), vectors.select("row_id", "label")).select(
        "query_id", "rank", "row_id", "label", "distance"
    )


def neighbor_lists(spark, sf_dir):
    lists = knn.neighbor_lists(_neighbors(spark, sf_dir))
    return lists.select("query_id", F.array_join(
        F.transform("neighbors", lambda n: F.concat_ws(":", n["rank"].cast("string"), n["row_id"].cast("string"), n["severity"].cast("string"))), "|"
    ).alias("neighbors"))


def neighbor_vote(spark, sf_dir):
    return vote.neighbor_vote(_neighbors(spark, sf_dir)).select(
        "query_id", F.col("neighbor_pred").cast("long").alias("neighbor_pred"),
        F.round("neighbor_confidence", 6).alias("neighbor_confidence"),
    )


def vote_distribution(spark, sf_dir):
    votes = vote.neighbor_vote(_neighbors(spark, sf_dir))
    return votes.select("query_id", F.explode("neighbor_distribution").alias("label", "share")).select(
        "query_id", F.col("label").cast("long").alias("label"), F.round("share", 6).alias("share")
    )


def nearest_food(spark, sf_dir):
    """Food resolution on stored vectors: every vector is a food. Every twentieth, without half of its values, is a typed one."""
    vectors = _vectors(spark, sf_dir)
    foods = vectors.select(F.format_string("food-%09d", "row_id").alias("food_name"), "embedding")
    typed = vectors.filter(F.col("row_id") % 20 == 0).select(
        F.col("row_id").alias("query_id"),
        F.transform("embedding", lambda x, i: F.when(i % 2 == 0, x).otherwise(F.lit(0.0).cast("float"))).alias("embedding"),
    )
    best = knn.nearest(typed, foods, 1, row_id="food_name")
    similarity = F.lit(1.0) - F.col("distance")
    return best.select(
        "query_id", F.when(similarity >= 0.7, F.col("food_name")).otherwise("typed").alias("resolved_food"),
        F.round(similarity, 6).alias("food_similarity_score"),
    )


def vector_metadata(spark, sf_dir):
    meta = store.vector_metadata(_vectors(spark, sf_dir), metric="cosine")
    return meta.select("num_rows", F.col("embedding_dim").cast("long").alias("embedding_dim"), "metric")


# Combination, metrics, split

def _severity_name(label):
    names = F.array(*[F.lit(x) for x in SEVERITY_ORDER])
    return F.element_at(names, (F.col(label) % 4 + 1).cast("int"))


def severity_combine(spark, sf_dir):
    """The neighbours' vote beside the stored label as the classifier's answer."""
    neighbors = _neighbors(spark, sf_dir, 10).withColumn("severity", _severity_name("severity"))
    predictions = _vectors(spark, sf_dir).select(
        F.col("row_id").alias("query_id"),
        F.element_at(F.array(F.lit("info"), F.lit("severe"), F.lit("minor"), F.lit("odd")), (F.col("label") % 4 + 1).cast("int")).alias("classifier_pred"),
        F.lit(None).cast("map<string,double>").alias("classifier_probs"),
    )
    info = vote.severity_info(vote.neighbor_vote(neighbors), predictions).select("query_id", "severity_info.*")
    return info.select(
        "query_id", "neighbor_pred", "classifier_pred", "agreement", "final_severity", "confidence_level",
        S.severity_rank("final_severity").cast("long").alias("final_rank"), S.severity_marker("final_severity").alias("marker"),
    )


def _predictions(spark, sf_dir):
    """Predictions of three models: votes of the 1, 3 and 9 nearest other vectors."""
    others = _neighbors(spark, sf_dir, 10).filter(F.col("row_id") != F.col("query_id"))
    sized = others.withColumn("model_k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(9)))).filter(
        F.col("rank") <= F.col("model_k") + 1
    )
    voted = vote.neighbor_vote(
        sized.withColumn("query_id", F.struct("query_id", "model_k"))
    ).select("query_id.*", "neighbor_pred")
    actual = _vectors(spark, sf_dir).select(F.col("row_id").alias("query_id"), F.col("label").alias("actual"))
    return voted.join(actual, "query_id").select(
        F.concat(F.lit("vote"), F.col("model_k").cast("string")).alias("model"),
        F.col("model_k").alias("ordinal"), "query_id",
        F.col("actual").cast("long").alias("actual"), F.col("neighbor_pred").cast("long").alias("predicted"),
    )


def confusion(spark, sf_dir):
    return metrics.confusion(_predictions(spark, sf_dir), ["model"])


def confusion_matrix(spark, sf_dir):
    counts = metrics.confusion(_predictions(spark, sf_dir).filter(F.col("model") == "vote3"))
    wide = metrics.confusion_matrix(counts, list(range(10)))
    return wide.select("actual", *[F.col(str(i)).alias(f"p{i}") for i in range(10)])


def model_scores(spark, sf_dir):
    scores = metrics.summary_scores(metrics.confusion(_predictions(spark, sf_dir), ["model"]), ["model"])
    return scores.select("model", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def class_report(spark, sf_dir):
    report = metrics.classification_report(metrics.confusion(_predictions(spark, sf_dir), ["model"]), ["model"])
    rounded = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return report.select("model", "label", *rounded, F.col("support").cast("long").alias("support"))


def best_model(spark, sf_dir):
    predictions = _predictions(spark, sf_dir)
    scores = metrics.summary_scores(metrics.confusion(predictions, ["model", "ordinal"]), ["model", "ordinal"])
    best = metrics.best_model(scores)
    return best.select("model", F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"))


def model_summary(spark, sf_dir):
    """Scores and confusion counts of all models with the best one marked; written and read back."""
    counts = metrics.confusion(_predictions(spark, sf_dir), ["model", "ordinal"])
    summary = metrics.model_summary(counts.drop("ordinal"), metrics.summary_scores(counts, ["model", "ordinal"]))
    path = new_path(spark, "model-summary")
    store.write_summary(summary, path)
    back = store.read_summary(
        spark, path, "model STRING, accuracy DOUBLE, macro_f1 DOUBLE, best BOOLEAN, actual LONG, predicted LONG, n LONG"
    )
    return back.withColumns({c: F.round(c, 6) for c in ("accuracy", "macro_f1")})


def class_weights(spark, sf_dir):
    weights = split.class_weights(table(spark, sf_dir, "labels"), "quality")
    return weights.select("quality", "n", F.round("weight", 6).alias("weight"))


def stratified_split(spark, sf_dir):
    return split.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


# Vocabularies, relevance, reasoning

def _drug_lines(spark, sf_dir):
    named = lines(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return named.withColumn("drug_name", F.concat_ws("-", "drug_name", "lang"))


def _injectables(spark, sf_dir):
    rows = keys.add_row_id(_drug_lines(spark, sf_dir), _KEY)
    return injectables.injectable_drugs(rows, curated=CURATED, iv_tokens=IV_WORDS, oral_tokens=ORAL_WORDS)


def injectable_set(spark, sf_dir):
    return _injectables(spark, sf_dir)


def _first_word(text):
    return F.regexp_extract(T.normalize_text(text), f"({T.WORD}+)", 1)


def _word_vocabulary(spark, sf_dir):
    """Every word of the documents."""
    words = F.explode(F.regexp_extract_all(T.normalize_text("text"), F.lit(f"({T.WORD}+)"), F.lit(1)))
    return relevance.drug_vocabulary(table(spark, sf_dir, "documents").select(words.alias("drug_name")))


def _questions(spark, sf_dir):
    """Turns as queries: the first word is the drug, the role the food.

    Turns that open with "the" name no drug, and system turns no food.
    """
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.nullif(_first_word("text"), F.lit("the")).alias("drug_name"),
        F.nullif(F.col("role"), F.lit("system")).alias("food"),
        F.col("text").alias("interaction_text"),
    )


def unknown_drugs(spark, sf_dir):
    questions = _questions(spark, sf_dir)
    flagged = relevance.flag_known(questions, F.lower(T.strip("drug_name")), _word_vocabulary(spark, sf_dir), "known", ["query_id"])
    return flagged.select("query_id", "drug_name", "known")


def relevance_check(spark, sf_dir):
    checked = relevance.check_relevance(
        _questions(spark, sf_dir), _word_vocabulary(spark, sf_dir), irrelevant_words=OFF_TOPIC
    )
    return checked.select("query_id", "relevant", "relevance_reason", "relevance_message")


def validation(spark, sf_dir):
    return _questions(spark, sf_dir).select("query_id", relevance.validation_error().alias("error"))


def _reasoned(spark, sf_dir):
    """Documents as queries with the documents of their nearest vectors as neighbours; one without a vector meets none."""
    documents = table(spark, sf_dir, "documents").withColumn("drug_name", F.concat_ws("-", "source", "lang"))
    corpus = documents.select(
        F.col("doc_id").alias("row_id"), "drug_name", F.col("lang").alias("food"), F.col("text").alias("interaction_text")
    )
    neighbors = _neighbors(spark, sf_dir, 3).withColumn("severity", _severity_name("severity"))
    voted = vote.neighbor_vote(neighbors).select(
        "query_id", F.col("neighbor_pred").alias("final_severity"), F.round("neighbor_confidence", 6).alias("confidence")
    )
    neighbors = materialize(neighbors, "neighbors")
    lists = knn.neighbor_lists(knn.attach_rows(neighbors, corpus))
    none = F.array().cast(lists.schema["neighbors"].dataType)
    return (
        documents.select(F.col("doc_id").alias("query_id"), "drug_name", F.col("lang").alias("food"), F.col("text").alias("interaction_text"))
        .join(lists, "query_id", "left").withColumn("neighbors", F.coalesce("neighbors", none)).join(voted, "query_id", "left")
    )


def _with_mechanism(spark, sf_dir):
    return reasoning.add_mechanism(
        _reasoned(spark, sf_dir), _injectables(spark, sf_dir), words=MECHANISMS, thinning_foods=THINNING
    )


def context_text(spark, sf_dir):
    return _reasoned(spark, sf_dir).select("query_id", F.md5(reasoning.context_text()).alias("context"))


def mechanism(spark, sf_dir):
    return _with_mechanism(spark, sf_dir).select(
        "query_id", "type_label", "mechanism", "risk", "severity_english",
        reasoning.recommendation("final_severity").alias("recommendation"),
    )


def neighbor_examples(spark, sf_dir):
    return _reasoned(spark, sf_dir).select(
        "query_id", F.md5(F.array_join(reasoning.neighbor_examples(n=2), "\n")).alias("examples")
    )


def _bundled(spark, sf_dir):
    return _with_mechanism(spark, sf_dir).select(
        "query_id", "confidence", F.struct(
            "drug_name", "food", "final_severity", "mechanism", "risk", "severity_english",
            reasoning.recommendation("final_severity").alias("recommendation"),
            reasoning.neighbor_examples().alias("neighbor_examples"),
            F.col("food").alias("user_entered_food"),
            F.when(F.col("food") == "en", "english").otherwise(F.col("food")).alias("semantically_resolved_food"),
        ).alias("reasoning_bundle"),
    )


def prompts(spark, sf_dir):
    return _bundled(spark, sf_dir).select("query_id", F.md5(reasoning.explanation_prompt()).alias("prompt"))


def explanations(spark, sf_dir):
    """The template, or a text made for the labelled documents, with the safety notes."""
    generated = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("query_id"),
        F.when(F.col("quality") == 0, F.concat(F.lit(" made for "), F.col("doc_id").cast("string"), F.lit(" "))).alias("first_text"),
    )
    bundled = _bundled(spark, sf_dir).join(generated, "query_id", "left")
    level = S.confidence_level(F.lit(True), "confidence", 0.9, 0.4)
    text = reasoning.add_safety_notes(
        reasoning.explanation(generated=["first_text"]), F.col("reasoning_bundle.final_severity"), level
    )
    return bundled.select("query_id", text.alias("explanation"))


def explanation_texts(spark, sf_dir):
    """The explanations written as one text per query, and read back."""
    path = new_path(spark, "texts")
    store.write_texts(explanations(spark, sf_dir), path, "query_id", "explanation")
    return store.read_texts(spark, path).toDF("query_id", "explanation")


# Clusters

def cluster_sizes(spark, sf_dir):
    return cluster.cluster_sizes(_vectors(spark, sf_dir).withColumn("label", F.col("label").cast("long")), "label")


def _plane(spark, sf_dir):
    """All dimensions along two fixed orthogonal axes, which SQL can repeat."""
    plane = cluster.add_plane(_vectors(spark, sf_dir), AXES)
    return plane.select("row_id", "label", F.col("proj_x").alias("x"), F.col("proj_y").alias("y"))


def plot_bins(spark, sf_dir):
    bins = cluster.plot_bins(_plane(spark, sf_dir), "x", "y", "label", BIN, [])
    return bins.select("x_bin", "y_bin", F.col("label").cast("long").alias("label"), "code", "n")


def density_clusters(spark, sf_dir):
    found = cluster.add_density_clusters(_plane(spark, sf_dir), "x", "y", EPS, MIN_POINTS, MIN_SIZE)
    return found.select("row_id", F.col("cluster_hdbscan").cast("long").alias("cluster"))


def density_off(spark, sf_dir):
    off = cluster.without_density_clusters(_vectors(spark, sf_dir))
    return off.select("row_id", F.col("cluster_hdbscan").cast("long").alias("cluster"))


def kmeans(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return cluster.add_kmeans(vectors, cluster.fit_kmeans(vectors)).select("row_id", "cluster_kmeans")


def projection(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return cluster.add_projection(vectors, cluster.fit_projection(vectors)).select("row_id", "proj_x", "proj_y")


def clustering_summary(spark, sf_dir):
    """Sizes of the stored labels as clusters and of the density clusters, with the parameters; written and read back."""
    found = cluster.add_density_clusters(_plane(spark, sf_dir), "x", "y", EPS, MIN_POINTS, MIN_SIZE)
    summary = cluster.clustering_summary(found, ["label", "cluster_hdbscan"], eps=EPS, min_points=MIN_POINTS, metric="euclidean")
    path = new_path(spark, "clustering-summary")
    store.write_summary(summary, path)
    return store.read_summary(spark, path, "name STRING, id STRING, size LONG, eps DOUBLE, min_points LONG, metric STRING")


# Models

def _training(spark, sf_dir):
    return models.prepare_training(_vectors(spark, sf_dir).withColumnRenamed("label", "severity"))


def _scores(spark, sf_dir, estimators):
    _, _, scores = models.train_and_compare(_training(spark, sf_dir), estimators)
    return scores


def model_logreg(spark, sf_dir):
    return _scores(spark, sf_dir, {"logreg": models.logistic()})


def model_forest(spark, sf_dir):
    return _scores(spark, sf_dir, {"random_forest": models.forest()})


def model_mlp(spark, sf_dir):
    classes = table(spark, sf_dir, "embeddings").agg(F.countDistinct("label")).first()[0]
    return _scores(spark, sf_dir, {"mlp": models.network(64, classes)})


def model_boosted(spark, sf_dir):
    return _scores(spark, sf_dir, {"boosted": models.boosted()})


def model_selection(spark, sf_dir):
    """Compare, select, save, load, and write the reports; the reports are read back."""
    prepared = _training(spark, sf_dir)
    classes = table(spark, sf_dir, "embeddings").agg(F.countDistinct("label")).first()[0]
    fitted, counts, scores = models.train_and_compare(prepared, models.default_estimators(64, classes))
    name, best = models.select_best(fitted, scores)
    path = new_path(spark, "model")
    models.save_model(best, path)
    reports = new_path(spark, "reports")
    store.write_text_per_name(metrics.report_text(counts, scores), reports, "model", "report")
    queries = _vectors(spark, sf_dir).withColumnRenamed("row_id", "query_id")
    classified = models.classify(models.load_model(path), queries).filter(F.col("classifier_pred").isNotNull()).count()
    lines_read = spark.read.text(reports).groupBy("model").agg(F.count("*").alias("report_lines"))
    return lines_read.withColumn("best", F.lit(name)).withColumn("classified", F.lit(classified))


# Round trips through the sources and sinks

def _numbered(df):
    return df.withColumn("text_pos", F.col("text_pos").cast("long"))


def json_round_trip(spark, sf_dir):
    rows = _numbered(lines(spark, sf_dir))
    path = new_path(spark, "json")
    records.write_json_records(rows, path)
    return records.read_json_records(spark, path, rows.schema)


def csv_round_trip(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", F.nullif(F.col("lang"), F.lit("en")).alias("food"), "text")
    path = new_path(spark, "csv")
    records.write_csv_records(documents, path)
    back = records.read_csv_records(spark, path, documents.schema)
    return back.select("doc_id", "source", "food", F.md5("text").alias("text"))


def raw_records(spark, sf_dir):
    """Documents written as nested records, one per source, and loaded as interaction rows.

    Records without a list, and with an empty one, stand beside them for every labelled document; they give no rows.
    """
    nested = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("  "), F.col("source")).alias("name"),
        F.concat(F.col("doc_id").cast("string"), F.lit(" ")).alias("reference"),
        F.split("text", "\n").alias("food_interactions"),
    )
    bare = table(spark, sf_dir, "labels").select(
        F.lit("bare").alias("name"), F.concat(F.lit("0"), F.col("doc_id").cast("string")).alias("reference"),
        F.when(F.col("quality") == 1, F.array().cast("array<string>")).alias("food_interactions"),
    )
    path = new_path(spark, "raw")
    records.write_json_records(nested.unionByName(bare), path)
    loaded = records.load_drug_records(spark, path, multi_line=False)
    return loaded.select(
        F.col("reference").cast("long").alias("doc_id"), F.col("text_pos").cast("long").alias("text_pos"),
        "drug_name", F.md5("interaction_text").alias("interaction_text"),
    )


def vector_store_round_trip(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    path, meta_path = new_path(spark, "vectors"), new_path(spark, "meta")
    store.write_vectors(vectors, path)
    back = store.read_vectors(spark, path)
    keys.check_alignment(vectors, back, "row_id")
    store.write_metadata(store.vector_metadata(back, metric="cosine"), meta_path)
    meta = store.read_metadata(spark, meta_path, "num_rows LONG, embedding_dim LONG, metric STRING")
    total = back.agg(F.sum(V.total("embedding"))).first()[0]
    return meta.withColumn("total", F.round(F.lit(total), 4))


# The whole job

_CORPORA: dict = {}


def corpus(spark, sf_dir) -> answer.Corpus:
    """The prepared corpus of a folder, built once per session."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _CORPORA:
        extracted = _extracted(spark, sf_dir)
        triples = prepare.labelled_triples(extracted, _KEY, patterns=PATTERNS)
        hashed = materialize(prepare.with_places(triples, TFIDF_SIZE), "rows")
        release(triples)
        encoder = encode.hashed_encoder(encode.fit_hashed(hashed, "places", TFIDF_SIZE))
        # Only what is not zero is written and held.
        training = materialize(prepare.vectors_of(hashed, encoder, ["severity"]), "training")
        featured = training.withColumn("features", encode.sparse_features("terms", TFIDF_SIZE)).drop("terms")
        clusters = cluster.fit_kmeans(featured, vector="features")
        # The classifier has no penalty, and another order of its sums ends at other weights.
        classifier = models.fit(split.add_class_weight(featured, "severity", ["row_id"]), models.logistic())
        featured = encoder.terms(hashed, "places", "terms").withColumn("features", encode.sparse_features("terms", TFIDF_SIZE))
        rows = materialize(cluster.add_kmeans(featured, clusters, "features").drop("places", "terms", "features"), "rows")
        release(hashed)
        vectors = training.select("row_id", "terms", encode.full_vector("terms", TFIDF_SIZE).alias("embedding"))
        _CORPORA[name] = answer.build_corpus(
            rows, vectors, encoder, classifier, curated=CURATED, iv_tokens=IV_WORDS, oral_tokens=ORAL_WORDS,
        )
    return _CORPORA[name]


def _asked(spark, sf_dir):
    """Turns as queries about a source; some sources do not exist, and the first word is the food."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.concat(F.lit("SRC"), (F.col("conv_id") % 25).cast("string")).alias("drug_name"),
        _first_word("text").alias("food"),
        F.col("text").alias("interaction_text"),
    )


def encode_text(spark, sf_dir):
    """MLlib's encoder: length and width of its vectors, and how many values they hold, one for each known hash of a word."""
    documents = table(spark, sf_dir, "documents")
    encoder = encode.tfidf_encoder(encode.fit_tfidf(documents, "text", TFIDF_SIZE))
    unit = encoder(documents, "text", "embedding")
    return unit.select(
        "doc_id", F.round(V.l2_norm("embedding"), 4).alias("norm"), F.size("embedding").cast("long").alias("dim")
    )


def encode_hashed(spark, sf_dir):
    """The encoder of the corpus: every value of the vectors of all documents that is not zero."""
    documents = table(spark, sf_dir, "documents")
    encoder = encode.hashed_encoder(encode.fit_hashed(documents, "text", TFIDF_SIZE))
    terms = encoder(documents, "text", "embedding").select("doc_id", F.explode(sparse("embedding")).alias("t"))
    return terms.select("doc_id", F.col("t.term").cast("long").alias("term"), F.round(F.col("t.weight").cast("double"), 5).alias("weight"))


def encode_batches(spark, sf_dir):
    """A caller's model: here the shares of the vowels, from batches of texts."""
    def load():
        def predict(texts):
            counts = np.array([[str(t).count(v) for v in "aeiou"] for t in texts], np.float32)
            return counts / np.maximum(1.0, np.sqrt((counts * counts).sum(axis=1, keepdims=True)))
        return predict

    unit = encode.batch_encoder(load)(table(spark, sf_dir, "documents"), "text", "embedding")
    return unit.select("doc_id", *[F.round(F.col("embedding")[k].cast("double"), 4).alias(v) for k, v in enumerate("aeiou")])


def resolve_foods(spark, sf_dir):
    built = corpus(spark, sf_dir)
    return answer.resolve_foods(_asked(spark, sf_dir), built.foods, built.encoder).select(
        "query_id", "food", "resolved_food", F.round("food_similarity_score", 6).alias("food_similarity_score")
    )


def retrieve(spark, sf_dir):
    built = corpus(spark, sf_dir)
    encoded = answer.encode_queries(_asked(spark, sf_dir), built.encoder)
    found = answer.retrieve(encoded, built, 10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "row_id", "severity", F.round("distance", 6).alias("distance"))


def zero_shot(spark, sf_dir):
    return answer.zero_shot_severity(_asked(spark, sf_dir), corpus(spark, sf_dir)).select(
        "query_id", "neighbor_pred", F.round("neighbor_confidence", 6).alias("neighbor_confidence"),
        F.size("neighbors").cast("long").alias("n_neighbors"),
    )


def compare_predictions(spark, sf_dir):
    return answer.compare_predictions(_asked(spark, sf_dir), corpus(spark, sf_dir)).select(
        "query_id", "neighbor_pred", "neighbor_confidence", "classifier_pred"
    )


def explain(spark, sf_dir):
    results = answer.explain(_asked(spark, sf_dir), corpus(spark, sf_dir), irrelevant_words=OFF_TOPIC)
    return answer.explanation_records(results)


def _shares_text(shares):
    """The entries of a map in the order of their keys, as text."""
    entries = F.array_sort(F.map_entries(shares))
    return F.array_join(F.transform(entries, lambda e: F.format_string("%s:%.4f", e["key"], e["value"])), "|")


def _view_row(view):
    """All that the page shows, with lists as text and the texts of neighbours by digest."""
    def neighbor(n):
        shown = [n["drug_name"], n["food"], n["severity"], F.md5(n["interaction_text"]), F.round(n["distance"], 6), F.round(n["similarity"], 6)]
        return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in shown])

    return view.select(
        "query_id", "marker", "confidence_level", "explanation", "final_severity",
        "neighbor_pred", F.round("neighbor_confidence", 6).alias("neighbor_confidence"), _shares_text("neighbor_distribution").alias("neighbor_distribution"),
        "classifier_pred", _shares_text("classifier_probs").alias("classifier_probs"),
        F.array_join(F.transform("neighbors", neighbor), "|").alias("neighbors"), F.size("neighbors").alias("n_neighbors"),
    )


def result_view(spark, sf_dir):
    """The whole results page of every accepted question."""
    results = answer.explain(_asked(spark, sf_dir), corpus(spark, sf_dir), irrelevant_words=OFF_TOPIC)
    return _view_row(reasoning.result_view(results.filter("relevant")))


def explanations_csv(spark, sf_dir):
    results = answer.explain(_asked(spark, sf_dir), corpus(spark, sf_dir), irrelevant_words=OFF_TOPIC)
    flat = answer.explanation_records(results)
    path = new_path(spark, "explanations")
    records.write_csv_records(flat, path)
    back = records.read_csv_records(spark, path, flat.schema)
    return back.select("query_id", "drug_name", "food", F.md5("interaction_text").alias("interaction_text"), "relevant", "relevance_reason")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        severity_counts, explode_lines, normalize_text, lexicon_file, lexicon_match, lexicon_match_join,
        extract_terms_join, enumeration_extract,
        extract_terms, low_information, flatten_terms, severity_label, final_label, extract_with_answers,
        unresolved_prompts, parse_food_list, embedding_text, head_rows,
        row_key, alignment, id_range_check, category_codes, vocabulary, vocabulary_counts,
        l2_normalize, cosine_pairs, knn_exact, knn_blocked, knn_by_id, neighbor_lists, neighbor_vote,
        vote_distribution, nearest_food, vector_metadata,
        severity_combine, confusion, confusion_matrix, model_scores, class_report, best_model, model_summary, class_weights,
        stratified_split,
        injectable_set, unknown_drugs, relevance_check, validation, context_text, mechanism, neighbor_examples,
        prompts, explanations, explanation_texts,
        cluster_sizes, plot_bins, density_clusters, density_off, kmeans, projection, clustering_summary,
        model_logreg, model_forest, model_mlp, model_boosted, model_selection,
        json_round_trip, csv_round_trip, raw_records, vector_store_round_trip,
        encode_text, encode_hashed, encode_batches, resolve_foods, retrieve, zero_shot, compare_predictions, explain, result_view, explanations_csv,
    )
}
