import collections
import random

import numpy as np

from tallyloom.llm import graph, neardup
from tallyloom.llm.textblock import Block

from .helpers import classes, documents, empty, odd_texts, prose


def test_registers_agree_with_the_weighted_similarity():
    rng = random.Random(1)
    a = [rng.choice("abcdefgh") for _ in range(300)]
    b = a[:]
    for i in rng.sample(range(300), 12):
        b[i] = "zz"
    block = Block([" ".join(a), " ".join(b)])
    s = neardup.signatures(*neardup.shingles(block, 2), 2, 6000)
    ca, cb = (collections.Counter(zip(x, x[1:])) for x in (a, b))
    true = sum((ca & cb).values()) / sum((ca | cb).values())
    assert abs((s[0] == s[1]).mean() - true) < 0.02


def test_classes_against_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randint(60, 200), 3000)
        texts += [base, base, *(edited_some(rng, base) for _ in range(6))]
    big = prose(rng, 150, 3000)
    texts += [edited_some(rng, big, 12) for _ in range(60)] + [big]
    texts += [prose(rng, 80, 3000) for _ in range(30)] + odd_texts()
    out = {r["doc_id"]: r for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    want = classes(texts)
    last = len(texts) - 1
    assert [out[i]["class_id"] for i in range(last)] == want[:last]
    kept = collections.Counter(out[i]["class_id"] for i in range(last) if out[i]["keep"])
    assert set(kept.values()) == {1} and set(kept) == set(want[:last])
    docs = documents(spark, texts)
    one = neardup.dedup(docs)
    assert one.columns == docs.columns and one.count() == len(set(want))
    assert neardup.near_duplicates(empty(spark)).count() == 0 and neardup.dedup(empty(spark)).count() == 0


def edited_some(rng, text, most=8):
    words = text.split(" ")
    for _ in range(rng.randint(0, most)):
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 1)] = [f"x{rng.randrange(10**6)}"] if rng.random() < 0.8 else []
    return " ".join(words)


def test_texts_smaller_than_their_hub_meet_by_what_it_lacks(spark):
    """A pair of 98 shingles, 85 of them the hub's and 95 shared, in one bucket with the hub and its copies."""
    hub = [f"h{i}" for i in range(104)]
    copies = [" ".join(hub[:-1] + [f"c{i}"]) for i in range(6)]
    tail = [f"p{i}" for i in range(13)]
    pair = [" ".join(hub[:89] + tail), " ".join(hub[:89] + tail[:10] + ["q0", "q1", "q2"])]
    larger = [" ".join(hub[:84] + [f"r{i}" for i in range(21)] + [end]) for end in "ab"]
    texts = [" ".join(hub), *copies, *pair, *larger]
    docs = documents(spark, [*texts, None])
    rows = {r["doc_id"]: r for r in neardup.sketch(docs).collect()}
    made = [(rows[i]["node"], rows[i]["n"], [1, 2, 3] if i == 0 else [1, 2] if i < 6 else [1, 3] if i == 6 else [1]) for i in range(len(texts))]
    comps = {r["node"]: r["comp"] for r in neardup.links(spark.createDataFrame(made, "node long, n int, bands array<long>"), docs).collect()}
    got = [comps.get(node, node) for node, _, _ in made]
    assert [got.index(c) for c in got] == classes(texts) == [0] * 7 + [7, 7, 9, 9]


def test_triples_near_the_threshold_against_brute_force(spark):
    rng = random.Random(10)
    texts = []
    for k in range(340):
        n = rng.randint(40, 90)
        base = [f"t{k}w{rng.randrange(2000)}" for _ in range(n)]
        for _ in range(3):
            words = base[:]
            at = rng.randrange(n)
            words[at : at + rng.randint(0, 2)] = [f"x{rng.randrange(10**9)}" for _ in range(rng.randint(0, 3))]
            texts.append(" ".join(words[: n - rng.choice([0, 0, rng.randint(0, n // 6)])]))
    out = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, [*texts, None])).collect()}
    want = []
    for i in range(0, len(texts), 3):
        want += [i + c for c in classes(texts[i : i + 3])]
    assert [out[i] for i in range(len(texts))] == want and 400 < len(set(want)) < 900


def test_bitmap_marks_all_that_it_is_made_of(spark):
    rng = random.Random(6)
    some = [rng.randrange(-(2**63), 2**63) for _ in range(3000)] + [-1, 0, 63, 64, -(2**63), 2**63 - 1]
    for most in (27, 10):
        bits = neardup.marked(spark.createDataFrame([(x,) for x in some], "node long"), most)
        assert neardup._is_marked(np.array(some, np.int64), bits).all()
        others = np.array([rng.randrange(-(2**63), 2**63) for _ in range(3000)], np.int64)
        assert neardup._is_marked(others, bits).mean() < (0.1 if most > 10 else 1.01)


def test_components_in_one_task_and_by_stars(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (10**6, 0):
        got = {r["node"]: r["comp"] for r in graph.components(df, few=few).collect()}
        assert got == {x: root(x) for x in up}


def test_no_hashes_collide_on_similar_words():
    words = [f"w{i}" for i in range(20000)]
    assert len(np.unique(Block([" ".join(words)]).hashes)) == len(words)
