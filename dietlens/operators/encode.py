"""Text encoders: hashed TF-IDF by MLlib or by MD5, or a caller's batch model."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

EMBEDDING_SIZE = 768
BATCH_SIZE = 64
# Rows that the hashed encoder weighs at once.
BLOCK_ROWS = 1024
# Words whose places a worker remembers.
MOST_WORDS = 1 << 18
_INPUT = "_document"

# An encoder adds a unit-length `array<float>` column: encoder(df, text column, output column). One whose vectors have few values other
# than zero, none of them negative, says so by an attribute `sparse_width`, the length of the vectors. It may have an attribute `terms`, which
# adds the values that are not zero instead, as an array of (term, weight).
Encoder = Callable[[DataFrame, str, str], DataFrame]


def fit_tfidf(df: DataFrame, text: str, size: int = EMBEDDING_SIZE) -> PipelineModel:
    """Tokenizer, hashed term counts, document frequencies of `df`, unit length."""
    stages = [
        RegexTokenizer(inputCol=_INPUT, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=size),
        IDF(inputCol="_counts", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(df.select(F.coalesce(text, F.lit("")).alias(_INPUT)))


def tfidf_encoder(model: PipelineModel) -> Encoder:
    """Encoder from a fitted model; null text is encoded as ''."""

    def encode(df: DataFrame, text: str, output: str = "embedding") -> DataFrame:
        encoded = model.transform(df.withColumn(_INPUT, F.coalesce(text, F.lit(""))))
        kept = [c for c in df.columns if c != output]
        return encoded.select(*kept, vector_to_array("_unit", "float32").alias(output))

    encode.sparse_width = model.stages[1].getNumFeatures()
    return encode


def _words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


_KNOWN: dict[int, dict[bytes, int]] = {}  # places of words, per size; in a worker


def _places(words: pa.Array, size: int) -> pa.Array:
    """Lists of words as lists of places. Each word of a batch is hashed once."""
    known = _KNOWN.setdefault(size, {})
    if len(known) > MOST_WORDS:
        known.clear()
    starts = words.offsets.to_numpy() - words.offsets[0].as_py()
    coded = words.flatten().cast(pa.binary()).dictionary_encode()
    found = []
    for word in coded.dictionary.to_pylist():
        place = known.get(word)
        if place is None:
            place = known[word] = int(hashlib.md5(word).hexdigest()[:8], 16) % size
        found.append(place)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.array(found, np.int32)[coded.indices.to_numpy()]))


def places(text: Column | str, size: int = EMBEDDING_SIZE) -> Column:
    """The place of each word of a text: the first 32 bits of its MD5, modulo the size."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def placed(words: pa.Array) -> pa.Array:
        return _places(words, size)

    return placed(_words(text))


def _is_placed(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, ArrayType)


def fit_hashed(df: DataFrame, text: str, size: int = EMBEDDING_SIZE) -> list[float]:
    """The weight of each of `size` hashed words: log((texts + 1) / (texts that hold it + 1)). What comes back has `size` rows.

    `text` is a column of texts, or of their `places`.
    """
    placed = _is_placed(df, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, n = np.zeros(size, np.int64), 0
        for batch in batches:
            lists = batch.column(0) if placed else _places(batch.column(0), size)
            for _, counts in _counts(lists, size):
                holding += (counts > 0).sum(axis=0)
            n += len(lists)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(np.append(holding, n))], names=["term", "n"])

    counted = df.select(F.col(text) if placed else _words(text)).mapInArrow(count, "term LONG, n LONG")
    found = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = found.get(size, 0)
    return [math.log((n + 1) / (found.get(k, 0) + 1)) for k in range(size)]


def _counts(places: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first row, counts) of lists of places: a row of `size` counts for each list, so many at a time that they take little room."""
    starts, flat = places.offsets.to_numpy(), places.values.to_numpy(zero_copy_only=False).astype(np.int64)
    for first in range(0, len(places), BLOCK_ROWS):
        own = starts[first : first + BLOCK_ROWS + 1]
        rows = np.repeat(np.arange(len(own) - 1), np.diff(own))
        cells = np.bincount(rows * size + flat[own[0] : own[-1]], minlength=(len(own) - 1) * size)
        yield first, cells.reshape(-1, size)


def _weighed(places: pa.Array, idf: np.ndarray) -> Iterator[np.ndarray]:
    """Unit rows of the weighed counts of lists of places, so many at a time that they take little room."""
    for _, cells in _counts(places, len(idf)):
        counts = cells * idf
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        yield np.divide(counts, norms, out=counts, where=norms > 0).astype(np.float32)


def hashed_encoder(weights: Sequence[float]) -> Encoder:
    """TF-IDF over words hashed by MD5, as any SQL engine can repeat it; null text is encoded as ''.

    In place of texts it takes their `places`, too.
    """
    size = len(weights)
    idf = np.array(weights)

    @F.arrow_udf(ArrayType(FloatType()))
    def weighed(places: pa.Array) -> pa.Array:
        found = [pa.array(rows.ravel()) for rows in _weighed(places, idf)]
        flat = pa.concat_arrays(found) if found else pa.array([], pa.float32())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1, dtype=np.int32) * size), flat)

    @F.arrow_udf(ArrayType(StructType([StructField("term", IntegerType()), StructField("weight", FloatType())])))
    def terms(places: pa.Array) -> pa.Array:
        sizes, names, values = [np.zeros(1, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.float32)]
        for rows in _weighed(places, idf):
            row, place = np.nonzero(rows)
            sizes.append(np.bincount(row, minlength=len(rows)))
            names.append(place.astype(np.int32))
            values.append(rows[row, place])
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(values))], names=["term", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pairs)

    def of(df: DataFrame, text: str) -> Column:
        return F.col(text) if _is_placed(df, text) else places(text, size)

    def encode(df: DataFrame, text: str, output: str = "embedding") -> DataFrame:
        return df.withColumn(output, weighed(of(df, text)))

    encode.sparse_width = size
    encode.terms = lambda df, text, output: df.withColumn(output, terms(of(df, text)))
    return encode


def batch_encoder(make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = BATCH_SIZE) -> Encoder:
    """Encoder around a caller's model; `make_predict` loads it once per Python worker."""
    model = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)

    def encode(df: DataFrame, text: str, output: str = "embedding") -> DataFrame:
        return df.withColumn(output, model(F.coalesce(F.col(text), F.lit(""))))

    return encode


def features(vector: str = "embedding") -> Column:
    """MLlib vector of an array column."""
    return array_to_vector(F.col(vector))


def sparse_features(terms: str, size: int = EMBEDDING_SIZE) -> Column:
    """MLlib vector of an array of (term, weight) in the order of the terms."""

    @F.arrow_udf(VectorUDT())
    def vector(pairs: pa.Array) -> pa.Array:
        n, flat = len(pairs), pairs.flatten()
        starts = pa.array((pairs.offsets.to_numpy() - pairs.offsets[0].as_py()).astype(np.int32))
        return pa.StructArray.from_arrays([
            pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
            pa.ListArray.from_arrays(starts, flat.field(0)), pa.ListArray.from_arrays(starts, flat.field(1).cast(pa.float64())),
        ], names=["type", "size", "indices", "values"])

    return vector(F.col(terms))


def full_vector(terms: str, size: int = EMBEDDING_SIZE) -> Column:
    """All values of an array of (term, weight)."""

    @F.arrow_udf(ArrayType(FloatType()))
    def full(pairs: pa.Array) -> pa.Array:
        n, flat, starts = len(pairs), pairs.flatten(), pairs.offsets.to_numpy()
        rows = np.zeros((n, size), np.float32)
        rows[np.repeat(np.arange(n), np.diff(starts)), flat.field(0).to_numpy(zero_copy_only=False)] = flat.field(1).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(rows.ravel()))

    return full(F.col(terms))


def add_features(df: DataFrame, vector: str = "embedding", output: str = "features") -> DataFrame:
    """Adds MLlib vectors of an array column, sparse ones where that takes less room. No array may be null or hold a value that is not finite."""
    dense = df.withColumn("_dense", features(vector))
    return VectorAssembler(inputCols=["_dense"], outputCol=output).transform(dense).drop("_dense")
