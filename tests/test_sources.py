import json
import os

from pyspark.sql import functions as F

from dietlens.session import new_path
from dietlens.sources import records, store

RAW = [
    {"name": " Warfarin ", "reference": " r1 ", "food_interactions": [" Avoid kale. ", "", None, "  ", "Second  "]},
    {"reference": "r2", "food_interactions": ["No name"]},
    {"name": "NoList", "reference": "r3"},
    {"name": "NullList", "reference": "r3", "food_interactions": None},
    {"name": "EmptyList", "food_interactions": []},
    {"name": "NoRef", "food_interactions": ["été"]},
]
EXPECTED = [
    (0, "Warfarin", "Avoid kale.", "r1"), (4, "Warfarin", "Second", "r1"), (0, "", "No name", "r2"), (0, "NoRef", "été", ""),
]


def _load(spark, tmp_path, body, **options):
    path = tmp_path / "raw.json"
    path.write_text(body, encoding="utf-8")
    rows = records.load_drug_records(spark, str(path), **options).orderBy("entry_id", "text_pos").collect()
    return [(r.text_pos, r.drug_name, r.interaction_text, r.reference) for r in rows]


def test_load_json_array(spark, tmp_path):
    assert _load(spark, tmp_path, json.dumps(RAW, ensure_ascii=False)) == EXPECTED


def test_load_json_lines(spark, tmp_path):
    body = "\n".join(json.dumps(r, ensure_ascii=False) for r in RAW)
    assert _load(spark, tmp_path, body, multi_line=False) == EXPECTED


def test_lexicon(spark, tmp_path):
    assert records.load_lexicon(spark).count() == 68
    assert records.load_lexicon(spark, str(tmp_path / "missing.txt")).count() == 68
    path = tmp_path / "terms.txt"
    path.write_text("  Figs \n\n KALE\n \nDates\n")
    terms = {r.term for r in records.load_lexicon(spark, str(path)).collect()}
    assert len(terms) == 70 and {"figs", "dates"} <= terms


def test_json_round_trip(spark, tmp_path):
    rows = [("a", None, ["x", "y"]), ("été \"q\"", "k\nl", [])]
    df = spark.createDataFrame(rows, "drug_name STRING, food STRING, food_entities ARRAY<STRING>")
    path = str(tmp_path / "out")
    records.write_json_records(df, path)
    back = records.read_json_records(spark, path, df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    text = "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in os.listdir(path) if f.startswith("part"))
    assert "été" in text and '"food":null' in text


def test_csv_round_trip_keeps_quotes_newlines_nulls_and_blanks(spark, tmp_path):
    rows = [("a", None, "x, \"y\"\nz"), ("b", "", " padded "), ("c", "k", "back\\slash")]
    df = spark.createDataFrame(rows, "drug_name STRING, food STRING, interaction_text STRING")
    path = str(tmp_path / "out")
    records.write_csv_records(df, path)
    assert sorted(map(tuple, records.read_csv_records(spark, path, df.schema).collect())) == sorted(rows)


def test_vector_store_and_metadata(spark, tmp_path):
    vectors = spark.createDataFrame([(0, [0.5, 0.25]), (1, [1.0, 0.0])], "row_id LONG, embedding ARRAY<FLOAT>")
    path = str(tmp_path / "vectors")
    store.write_vectors(vectors, path)
    back = store.read_vectors(spark, path)
    assert sorted(map(tuple, back.collect())) == [(0, [0.5, 0.25]), (1, [1.0, 0.0])]

    schema = "num_rows LONG, embedding_dim INT, metric STRING"
    meta_path = str(tmp_path / "meta")
    assert store.read_metadata(spark, meta_path, schema) is None
    store.write_metadata(store.vector_metadata(back, metric="cosine"), meta_path)
    assert [tuple(r) for r in store.read_metadata(spark, meta_path, schema).collect()] == [(2, 2, "cosine")]


def test_text_per_name(spark):
    df = spark.createDataFrame([("q1.txt", "one\ntwo"), ("q2.txt", "شرح")], "filename STRING, explanation STRING")
    path = new_path(spark, "texts")
    store.write_text_per_name(df, path, "filename", "explanation")
    folder = os.path.join(path, "filename=q1.txt")
    [part] = [f for f in os.listdir(folder) if f.startswith("part")]
    assert open(os.path.join(folder, part), encoding="utf-8").read() == "one\ntwo\n"


def test_split_lines(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = records.split_lines(documents, "doc_id", "source", "text")
    expected = sum(
        1 for r in documents.select("text").collect() for line in r.text.split("\n") if line.strip()
    )
    assert lines.count() == expected
    assert lines.filter(F.length("interaction_text") == 0).count() == 0
