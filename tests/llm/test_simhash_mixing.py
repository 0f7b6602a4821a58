import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from dietlens.llm import mixing, simhash
from dietlens.llm.components import components


def unsigned(value):
    return value & (2**64 - 1)


def test_fingerprints_equal_brute_force(odd_docs, docs):
    for table in (odd_docs, docs):
        got = simhash.fingerprints(table.withColumn("whole", F.col("text")), keep=["whole"]).collect()
        assert len(got) == table.count()
        for r in got:
            assert unsigned(r.fingerprint) == brute.simhash(r.whole)


def test_shingles_and_hash_follow_spark(spark):
    row = spark.sql("SELECT xxhash64('a b c d') AS h").first()
    assert unsigned(row.h) == simhash.fingerprint(b"A b\tC\nd") == brute.simhash("A b\tC\nd")
    assert simhash.fingerprint(b" \t") == 0 and simhash.fingerprint("é É".encode()) != simhash.fingerprint("é é".encode())


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_planes_find_all_links(radius):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    values = np.concatenate([base, *(base ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64) for _ in range(k)]) for k in (1, 2, 3, 4, 5, 6))])
    values = np.unique(values)
    group = np.sort(rng.integers(0, 5, len(values)))
    a, b = simhash.linked(group, values, radius)
    for g in range(5):
        own = values[group == g].tolist()
        want = brute.components([(v, v) for v in own], radius)
        parent = {v: v for v in own}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if x in parent:
                assert parent[x] == x and y in parent
                parent[x] = y
        groups = Counter(parent.values())
        assert sorted(groups.values()) == sorted(Counter(want.values()).values())


@pytest.mark.parametrize(("group", "blocks"), [(2048, 6), (4, 5), (8, 7)])
def test_components_equal_brute_force(spark, group, blocks):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for x in base[:20]:
        for _ in range(30):
            x ^= sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))})
            prints.add(x)
    prints = sorted(prints)
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fingerprint long")
    found = components(simhash.links(table, 4, blocks, group), "a", "b").collect()
    root = {r.node: r.root for r in found}
    want = brute.components([(x - (1 << 64) if x >> 63 else x, x) for x in prints])
    assert {k: root.get(k, k) for k in want} == want


def test_near_duplicates_equal_brute_force(odd_docs, docs):
    for table in (odd_docs.filter("doc_id IS NOT NULL"), docs):
        got = simhash.near_duplicates(table).collect()
        prints = {(r.doc_id, brute.simhash(r.text)) for r in table.select("doc_id", "text").collect()}
        want = brute.components(sorted(prints))
        assert len(got) == table.count()
        assert all(r.component_id == want[r.doc_id] for r in got)
        assert sum(r.kept for r in got) == len(set(want.values()))


def test_null_ids_come_last(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs)
    assert got.filter("doc_id IS NULL AND component_id = 3").count() == 1  # the null text is with the empty ones
    assert got.filter("component_id IS NULL").count() == 2
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.kept_rows(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id = 9").count() == 1


def test_chain_star_and_hot_node(spark, monkeypatch):
    from dietlens.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 50)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(2000, 2400)]
    pairs = spark.createDataFrame([*chain, *star, (7, 7), (5, 3), (3, 5)], "a long, b long")
    got = {r.node: r.root for r in components(pairs, "a", "b").collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 1000 for i in range(2000, 2400)} | {5: 3}
    assert components(pairs.filter("false"), "a", "b").count() == 0


def check_mix(rows, got):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(brute.tokens(text))
    want = brute.targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.size == len(brute.tokens(r.text)) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    return want, taken


def test_mix_meets_targets(docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mixing.mix(docs, keep=["text", "source"]).collect()
    want, taken = check_mix(rows, got)
    assert len(got) == len(rows)
    for source, target in want.items():
        assert taken[source] == pytest.approx(target, rel=0.05)
    again = mixing.mix(docs.repartition(3), keep=["source"]).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text", "source").collect()
    got = mixing.mix(odd_docs, keep=["text", "source"]).collect()
    check_mix([tuple(r) for r in rows], got)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in rows)
    mixed = mixing.mixed_rows(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0


def test_tilt_solves_the_dual(spark):
    sizes = spark.createDataFrame([("=a", s) for s in (1, 5, 9, 30, 200)] + [("=b", s) for s in (10, 20, 30)], "source_key string, size long")
    targets = spark.createDataFrame([("=a", 0, 5, 245, 400.0, False), ("=b", 1, 3, 60, 20.0, False)], "source_key string, place long, n_docs long, tokens long, target double, full boolean")
    for r in mixing.solve(sizes, targets).collect():
        own = [s for k, s in [("=a", s) for s in (1, 5, 9, 30, 200)] + [("=b", s) for s in (10, 20, 30)] if k == r.source_key]
        rates = [min(3.0, float(np.exp(r.tilt * s / r["mean"]))) for s in own]
        assert sum(x * s for x, s in zip(rates, own, strict=True)) == pytest.approx(r.target, rel=1e-4)
