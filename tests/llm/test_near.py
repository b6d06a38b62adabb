import random

import corpus_pipeline
from tracegauge.llm import near


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    a, b = grams(a), grams(b)
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_components(texts):
    """The smallest position that links of 0.8 or more reach."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike(texts[i], texts[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for length in (4, 5, 6, 9, 14, 30, 80, 300):
        for _ in range(3):
            base = rng.choices(words, k=length)
            for edits in (0, 1, 1, 2, 3, 5):
                copy = list(base)
                for _ in range(edits * max(1, length // 100)):
                    copy[rng.randrange(length)] = rng.choice(words)
                texts.append(" ".join(copy))
    texts += ["", None, " \t", "One two", "one TWO", "a b c", "a b d"]
    rng.shuffle(texts)
    return texts


def test_components_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component for r in near.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_a_crowd_that_one_entry_does_not_link(spark):
    # copies drift away from the first: neighbours are alike, ends are not, and many share minima
    rng = random.Random(3)
    at, texts = [f"v{i}" for i in range(200)], []
    for _ in range(120):
        at = list(at)
        at[rng.randrange(200)] = f"x{rng.random()}"
        texts.append(" ".join(at))
    texts += [" ".join(at[:90] + [f"y{rng.random()}" for _ in range(12)] + at[102:]) for _ in range(40)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component for r in near.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_the_stage_drops_copies_that_differ_in_many_fingerprint_bits(spark):
    words = [f"w{i}" for i in range(200)]
    copy = list(words)
    for i in (20, 60, 100, 140):
        copy[i] = f"new{i}"
    assert alike(" ".join(words), " ".join(copy))
    df = spark.createDataFrame([(2, " ".join(copy)), (1, " ".join(words)), (3, "something else entirely")], "doc_id bigint, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, df, "").collect()) == [1, 3]


def test_edges_of_the_stage(spark):
    doc = "doc_id bigint, text string, key string, root int, place int"
    rows = [(5, None), (4, ""), (None, " \t"), (7, "one two three"), (7, "one two three"), (9, "ONE two three"), (None, "alone here"), (8, "x " * 60_000 + "end"), (3, "x " * 60_000 + "END")]
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], doc)
    kept = near.clean(df)
    assert kept.columns == df.columns and sorted(kept.select("doc_id", "text").collect(), key=str) == sorted([(4, ""), (7, "one two three"), (None, "alone here"), (3, rows[8][1])], key=str)
    found = {(r.doc_id, r.component) for r in near.classes(df).collect()}
    assert found == {(5, 4), (4, 4), (None, 4), (7, 7), (9, 7), (None, None), (8, 3), (3, 3)}
    assert near.clean(df.limit(0)).count() == 0 and near.clean(df.where("text IS NULL")).count() == 1


def family(seed, n, length, most):
    """Copies of one text with 0 to ``most`` words replaced: alike to the original, apart from each other, or from all."""
    rng = random.Random(seed)
    base = [f"f{seed}w{i}" for i in range(length)]
    out = []
    for _ in range(n):
        copy = list(base)
        for i in rng.sample(range(length), rng.randrange(most + 1)):
            copy[i] = f"e{rng.random()}"
        out.append(" ".join(copy))
    return out


def test_families_of_copies_with_many_edits(spark):
    texts = family(1, 220, 120, 9) + family(2, 60, 60, 4) + family(3, 30, 300, 30)
    random.Random(1).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component for r in near.classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_the_prefix_filter_misses_no_pair_and_lists_few(spark):
    texts = family(4, 200, 100, 12)
    sets = [(i.to_bytes(16, "big"), sorted({hash(g) for g in grams(t)})) for i, t in enumerate(texts)]
    df = spark.createDataFrame(sets, "fp binary, grams array<bigint>").selectExpr("fp", "fp AS root", "grams")
    got = {(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in near.prefix_pairs(df).collect()}
    got = {tuple(sorted(p)) for p in got}
    want = {(i, j) for j in range(len(texts)) for i in range(j) if sets[i][1] != sets[j][1] and alike(texts[i], texts[j])}
    assert want and want <= got and len(got) < 4 * len(want) + 200  # of 19,900 pairs


def test_the_stage_links_by_simhash_first(spark, monkeypatch):
    """Fingerprints of the five-word sets meet by op1's multi-index hashing, whatever MinHash finds."""
    from tracegauge.llm import simhash

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join([*words, *words]), " ".join(reversed(words)), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = near.sketches(df, "doc_id", "text")
    sims = {r.doc_id: (bytes(r.fp), r.sim % (1 << 64)) for r in rows.collect()}
    for i, t in enumerate(texts):
        assert sims[i][1] == simhash.majority(simhash.np.unique(simhash.shingle_hashes(t, 5)))
    want = {(a[0], b[0]) for a in sims.values() for b in sims.values() if a[0] < b[0] and (a[1] ^ b[1]).bit_count() <= simhash.RADIUS}
    got = {(bytes(r.a), bytes(r.b)) for r in near.simhash_pairs(rows).collect()}
    assert got and {frozenset(p) for p in got} <= {frozenset(p) for p in want}
    called = []
    monkeypatch.setattr(near, "near_links", lambda fps: called.append(1) or simhash.near_links(fps))
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, df, "").collect()) == [0, 3, 4] and called
