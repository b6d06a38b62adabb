import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracegauge.llm import simhash
from tracegauge.llm.components import components


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("hot", [4096, 2])
def test_links_connect_exactly_the_near_fingerprints(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        seed = rng.getrandbits(64)
        fps.add(seed)
        for _ in range(15):
            x = seed
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
            fps.add(x)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    links = simhash.near_links(df)
    pairs = [(x % (1 << 64), y % (1 << 64)) for x, y in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    found = components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).collect()
    groups = {}
    for node, root in found:
        groups.setdefault(root, set()).add(node % (1 << 64))
    assert {frozenset(g) for g in groups.values()} == brute_roots(fps)


def test_majority_counts_every_bit():
    rng = np.random.default_rng(1)
    for n in (1, 2, 255, 256, 1000):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        assert simhash.majority(h) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > n)


def test_classes_on_nulls_copies_and_clashing_columns(spark):
    texts = ["", None, "One two", "one TWO", "a b c d e", "a b c d e", " \t\n", "x" * 50_000 + " " + "y z " * 20_000]
    rows = [(i if i != 5 else None, t, "k", 1) for i, t in enumerate(texts)] + [(4, "a b c d e", "k", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string, fp int")
    got = {(r.doc_id, r.fp % (1 << 64)): r.component for r in simhash.classes(df).collect()}
    assert got[(0, 0)] == got[(1, 0)] == got[(6, 0)] == 0
    assert got[(2, brute_fp("one two"))] == got[(3, brute_fp("one two"))] == 2
    assert got[(None, brute_fp("a b c d e"))] == 4 and got[(4, brute_fp("a b c d e"))] == 4
    assert got[(7, brute_fp(texts[7]))] == 7
    kept = simhash.clean(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 7]
    assert simhash.classes(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
