import math
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from brute import prose
from pyspark.sql import functions as F

from dietlens.llm import chosen_path, hard_negatives, signature_search
from dietlens.session import materialize


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Chosen-path join

def word_set(text, k=3):
    ws = brute.tokens(lower(text))
    return {" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def near(rows, percent=85):
    """{row number: (set size, component)} of (id, text) rows; null ids come last."""
    sets = [word_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holds = defaultdict(list)
    for i, s in enumerate(sets):
        met = Counter(j for g in s for j in holds[g])
        for j, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for g in s:
            holds[g].append(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        order = (key is None, key or 0)
        least[root(i)] = min(order, least.get(root(i), order))
    return {i: (len(sets[i]), None if least[root(i)][0] else least[root(i)][1]) for i in range(len(rows))}


def assert_near(table, **settings):
    got = chosen_path.near_duplicates(table.withColumn("whole", F.col("text")), keep=["whole"], **settings).collect()
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    want = Counter((*rows[i], n, c, rows[i][0] == c) for i, (n, c) in near(rows, settings.get("percent", 85)).items())
    assert Counter((r.doc_id, r.whole, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_near_duplicates_equal_brute_force(odd_docs, docs):
    assert_near(odd_docs)
    assert_near(docs)


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def crowd(spark):
    """A large group of near copies, edges of the threshold, chains, and a passage that all share."""
    rng = random.Random(4)
    base, shared = prose(50, 200).split(), prose(51, 60)
    texts = [edited(rng, base, rng.randrange(0, 9)) for _ in range(260)]
    texts += [prose(100 + i, 40) + " " + shared for i in range(150)]
    link = prose(60, 120).split()
    for k in range(20):  # a chain: each is near the one before only
        link[4 * k] = f"c{k}"
        texts.append(" ".join(link))
    return materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "crowd")


@pytest.mark.parametrize(("node", "limit", "depth", "some"), [(4096, 64, 12, "true"), (8, 2, 3, "doc_id < 40 OR doc_id BETWEEN 260 AND 280 OR doc_id > 420")])
def test_crowded_nodes_lose_no_link(crowd, monkeypatch, node, limit, depth, some):
    monkeypatch.setattr(chosen_path, "NODE", node)
    monkeypatch.setattr(chosen_path, "LIMIT", limit)
    monkeypatch.setattr(chosen_path, "DEPTH", depth)
    monkeypatch.setattr(chosen_path, "HUB_GROUP", 16)
    assert_near(crowd.filter(some))


def test_a_crowd_of_copies_does_not_make_all_pairs(crowd, monkeypatch):
    tested = []
    plain = chosen_path.confirmed
    monkeypatch.setattr(chosen_path, "confirmed", lambda pairs, *rest: tested.append(pairs.count()) or plain(pairs, *rest))
    assert_near(crowd.filter("doc_id < 260"))
    assert sum(tested) < 10 * 260  # all pairs would be 33,670


def test_forest_spans_the_components():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 60, 150), rng.integers(0, 60, 150)
    cost, color = rng.integers(0, 5, 150) / 5, rng.integers(0, 50, 60)
    chosen = chosen_path._forest(a, b, cost, color)

    def parts(edges):
        part = {c: c for c in color.tolist()}
        for i, j in edges:
            x, y = part[color[i]], part[color[j]]
            part = {k: (x if v == y else v) for k, v in part.items()}
        return part

    every, some = parts(zip(a, b, strict=True)), parts(zip(a[chosen], b[chosen], strict=True))
    assert len(set(every.values())) == len(set(some.values())) == len(set(color.tolist())) - len(chosen)
    order = sorted(range(150), key=lambda k: cost[k])
    least, part = 0, {c: c for c in color.tolist()}
    for k in order:
        x, y = part[color[a[k]]], part[color[b[k]]]
        if x != y:
            least += cost[k]
            part = {c: (x if v == y else v) for c, v in part.items()}
    assert cost[chosen].sum() == pytest.approx(least)


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(9)
    for n in (3, 50, 400, 9000):
        left, right = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
        right[: n * 9 // 10] = left[: n * 9 // 10]
        differ = np.bitwise_count(chosen_path.flips(left) ^ chosen_path.flips(right)).sum()
        assert differ <= len(set(left.tolist()) ^ set(right.tolist()))


def test_trees_and_sketches_meet_the_recall():
    assert chosen_path.trees(85, 0.9999) >= 4 and chosen_path.trees(85, 0.999999) > chosen_path.trees(85, 0.9999)
    assert chosen_path.trees(95, 0.9999) <= chosen_path.trees(60, 0.9999)
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(200):
        both = rng.integers(0, 2**64, 170, dtype=np.uint64)
        left, right = (np.concatenate([both, rng.integers(0, 2**64, 15, dtype=np.uint64)]) for _ in range(2))  # 0.85
        agree.append((chosen_path.signature(left) == chosen_path.signature(right)).sum())
    assert min(agree) >= chosen_path.cutoff(85) and abs(np.mean(agree) - 0.85 * 64) < 1


def test_near_duplicates_of_nothing(no_docs):
    found = chosen_path.near_duplicates(no_docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"] and found.isEmpty()


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranking(items, docs):
    counts = [(k, c) for k, t in docs if (c := Counter(TERM.findall(lower(t))))]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    out = Counter()
    for item, text in items:
        asked = TERM.findall(lower(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) for t in asked}
        scored = []
        for key, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked)
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out.update((item, rank, None if none else key, -s) for rank, (s, none, key) in enumerate(sorted(scored)[:10], 1))
    return out


def assert_ranked(items, docs):
    want = ranking([tuple(r) for r in items.select("item_id", "text").collect()], [tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = signature_search.search(items, docs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == want


def test_terms():
    text = "Été_2x—A.b\x7fÄ 😀z\x00Q[Zz"
    assert [t.decode() for t in signature_search.terms(text.encode())] == TERM.findall(lower(text))


def test_search_equals_brute_force(spark, sf_dir, docs):
    assert_ranked(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs)


def test_search_bears_odd_rows(spark, odd_docs):
    rows = [(1, "river stone Orre"), (2, None), (2, "the the the of"), (3, ""), (None, "été licence nobody"), (4, "unheard"), (4, prose(8, 4000)), (1, "river stone Orre")]
    items = spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, score string")
    assert_ranked(items, odd_docs)


def test_items_in_blocks(spark, sf_dir, docs, monkeypatch):
    monkeypatch.setattr(signature_search, "BLOCK_TERMS", 1500)
    assert_ranked(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs)


def test_bounds_are_never_below_the_score():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 120))).encode() for _ in range(150)]
    items = signature_search.Items.of({7: b"a bb ccc a d zz", 8: b"hhh"})
    found = [signature_search.terms(t) for t in texts]
    holding = np.array([sum(v in f for f in found) for v in items.vocabulary])
    items = items.weigh(holding, len(texts), sum(map(len, found)))
    keys = np.array([signature_search.xxhash.xxh64_intdigest(v, signature_search.SEED) for v in items.vocabulary], np.uint64)
    width = 256
    batch = signature_search._block(width, [(0, i, len(f), signature_search._keys(Counter(f))) for i, f in enumerate(found)])
    slices = np.frombuffer(batch.column(6)[0].as_py(), np.uint8).reshape(width, -1)
    bounds = signature_search.bounds(items, keys, width, np.array([len(f) for f in found]), slices)
    for item, bound in bounds.items():
        exact = np.array([items.score(item, Counter(f), len(f)) for f in found])
        assert (bound >= exact).all()
        assert (exact > 0).any() and (bound == 0).any() or item == 7


def test_search_of_nothing(spark, no_docs, odd_docs):
    items = spark.createDataFrame([(1, "river")], "item_id long, text string")
    assert signature_search.search(items, no_docs).isEmpty()
    assert signature_search.search(items.filter("false"), odd_docs).isEmpty()


# Hard negatives

def mined(rows):
    """(anchor, positive, rank, negative, scores) of (id, label, vector) rows."""
    kept = []
    for i, (key, label, vec) in enumerate(rows):
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if key is not None and key % 7 == 0 else label
        kept.append((i, key, label, [math.floor(256 * x) for x in vec]))
    out = Counter()
    for i, key, label, vec in kept:
        if key is None or key % 50:
            continue
        others = [(-sum(a * b for a, b in zip(vec, v)), k is None, k or 0, j, lab) for j, k, lab, v in kept if j != i]
        others.sort()
        for p in [o for o in others if o[4] == label][:5]:
            fits = [o for o in others if o[4] != label and 50 * -p[0] <= 100 * -o[0] <= 95 * -p[0]][:3]
            out.update((key, None if p[1] else p[2], rank, None if o[1] else o[2], -p[0], -o[0]) for rank, o in enumerate(fits, 1))
    return out


def assert_mined(table, **sizes):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(table, F.col("vec_id") % 50 == 0, label)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined([tuple(r) for r in table.select("vec_id", "label", "embedding").collect()])
    assert Counter(map(tuple, got.collect())) == want
    return want


@pytest.mark.parametrize("bucket", [4096, 8])
def test_mining_equals_brute_force(spark, sf_dir, monkeypatch, bucket):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", bucket)
    assert assert_mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def test_mining_bears_odd_rows(spark):
    rng = random.Random(6)
    rows = [(k, k % 3, [rng.uniform(-1, 1) * (1 + k % 5) for _ in range(4)]) for k in range(0, 400)]
    rows += [(50, 1, [0.5, 0.25, 0.0, 1.0])] * 3 + [(100, 2, [0.0] * 4), (150, 1, [1.0]), (None, 1, [1.0, 1.0, 0.5, 0.5]), (200, 1, [])]
    rows += [(7, 1, None), (8, None, [1.0] * 4), (9, 1, [1.0, None, 1.0, 1.0]), (50, 1, [1.0, math.nan, 1.0, 1.0]), (51, 1, [math.inf] * 4)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, id int, at string")
    assert assert_mined(materialize(table, "odd-vectors"))
    assert hard_negatives.mine(table.filter("false"), F.col("vec_id") % 50 == 0, F.col("label")).isEmpty()


def test_ranges_never_leave_out_a_row():
    rng = np.random.default_rng(3)
    vec = np.floor(256 * rng.normal(size=(500, 6)) * rng.uniform(0.2, 2, (500, 1)))
    lengths = np.sqrt((vec**2).sum(axis=1))
    rows = hard_negatives.Rows(np.zeros(500), np.arange(500), np.zeros(500, bool), np.arange(500), vec)
    bucket = hard_negatives.Bucket(rows, lengths)
    pruned = 0
    for anchor in vec[:50]:
        scores = vec @ anchor
        for least in np.quantile(scores, [0.0, 0.5, 0.9, 0.99, 1.0]):
            found = bucket.candidates(anchor, float(np.sqrt(anchor @ anchor)), least)
            if found is not None:
                pruned += 1
                assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())
    assert pruned
