import pytest
from brute import prose

LICENSE = "This work is licensed under a licence that nobody reads but everybody copies into every file they make."

# Every operator meets these: nulls in each column, empty, blank and long texts, ties, copies, whole repeated rows.
ROWS = [
    (1, prose(1, 120), "s1"), (2, prose(2, 90), "s1"), (3, None, "s2"), (4, "", "s2"), (5, " \t\n\x0b\f\r ", "s2"),
    (6, prose(1, 120), "s3"), (7, prose(1, 120).replace(" ", "\n"), None), (8, prose(8, 30_000), "s1"), (9, prose(9, 70), None),
    (9, prose(9, 70), None), (9, prose(9, 70), None), (None, prose(10, 80), "s3"), (None, prose(10, 80), "s4"), (None, None, None),
    (12, "one two", "s4"), (13, "One TWO", "s4"), (14, "été ÉTÉ 😀 naïve " + LICENSE, "é"), (15, LICENSE + "\n" + prose(15, 200), "s1"),
    (16, "x" * 300_000, "s1"), (17, prose(1, 119) + " changed", "s3"), (18, "Orre " * 200, "s5"), (19, "### $$$ %%% " * 60, "s5"),
    (20, prose(20, 60) + "  end\x1c", "s6"), (-5, prose(2, 90) + "\n", "s6"),
]
# Names that operators use for columns of their own.
CLASHES = "size kept fingerprint hash chunk recipe group ids copies n_words keep_id target found m blob first best run part row text_sha256".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The rows above with columns whose names clash, from Parquet."""
    from dietlens.session import materialize

    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return materialize(spark.createDataFrame([(*row, *CLASHES) for row in ROWS], schema).coalesce(3), "odd")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
