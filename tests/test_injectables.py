import random

import pytest

from dietlens.constants import CURATED_INJECTABLES
from dietlens.operators.injectables import injectable_drugs, tokens_per_group

ROWS = "row_id LONG, drug_name STRING, interaction_text STRING"


def test_rules(spark):
    rows = [
        (0, "OnlyIv", "Given by Infusion"), (1, "Both", "an injection"), (2, "Both", "or a tablet"),
        (3, "Heparin", "nothing"), (4, "Split", "given as im"), (5, "Split", "injection daily? no: iv"),
        (6, "Across", "take"), (7, "Across", "with"), (8, "Across", "food; bolus"),
        (9, "Pad", "by iv"), (10, "Pad", "drip"), (11, "End", "by iv"), (12, None, "infusion"), (13, "Nul", None),
        (14, "case", "infusion"), (15, "CASE", "tablet"),
    ]
    got = {r.drug_key for r in injectable_drugs(spark.createDataFrame(rows, ROWS).repartition(4)).collect()}
    assert got - set(CURATED_INJECTABLES) == {"onlyiv", "split", "pad", "case"}
    assert set(CURATED_INJECTABLES) <= got


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_tokens_across_texts_equal_the_joined_text(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.choice(["hot", "hot", "x", "y"]), "".join(rng.choice("ab ") for _ in range(rng.choice([0, 1, 2, 9])))) for i in range(300)]
    sets = {"one": ["ab ba b"], "two": ["b a a a b"], "three": ["aaab  bab", "bbb a a"], "none": ["c"]}
    got = {r.g: r for r in tokens_per_group(spark.createDataFrame(rows, "i LONG, g STRING, t STRING").repartition(5), "g", "t", "i", sets, block).collect()}
    for group in ("hot", "x", "y"):
        joined = " ".join(t for _, g, t in rows if g == group)
        for name, tokens in sets.items():
            assert got[group][name] == any(t in joined for t in tokens), (group, name)
