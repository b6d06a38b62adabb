import random

import pytest
from pyspark.sql import functions as F

from tracegauge.functions import change as CH
from tracegauge.operators import claims as C
from tracegauge.operators import graph as G
from tracegauge.operators import impact as I
from tracegauge.operators import jobs as JB
from tracegauge.operators import joins as J
from tracegauge.operators import rules as R
from tracegauge.operators import scan as B

EDGE = "scan string, kind string, src_key string, dst_key string"
NODE = "scan string, key string, kind string"


def test_affected_walks_up_and_never_down_from_a_capability(spark):
    nodes = spark.createDataFrame([("s", "route", "route"), ("s", "f", "component"), ("s", "g", "component"), ("s", "cap", "capability"), ("s", "wf", "workflow")], NODE)
    edges = spark.createDataFrame([("s", "routes_to", "route", "f"), ("s", "calls", "f", "g"), ("s", "implements", "g", "cap"), ("s", "implements", "other", "cap"), ("s", "implements", "cap", "wf")], EDGE)
    got = {r.node: r.path for r in G.affected(nodes, edges, spark.createDataFrame([("s", "g")], "scan string, key string")).collect()}
    assert got == {"g": ["g"], "f": ["g", "f"], "route": ["g", "f", "route"], "cap": ["g", "cap"], "wf": ["g", "cap", "wf"]}


@pytest.mark.parametrize("seed", [1, 2])
def test_traverse_against_a_queue(spark, seed):
    rnd = random.Random(seed)
    e = [(f"s{rnd.randrange(3)}", f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(90)]
    starts = [("s0", "n1"), ("s1", "n2")]
    got = {(r.scan, r.node): r.hop for r in G.traverse(spark.createDataFrame(e, "scan string, src_key string, dst_key string"), spark.createDataFrame(starts, "scan string, node string")).collect()}
    want = {s: 0 for s in starts}
    todo = list(starts)
    for s in todo:
        for sc, a, b in e:
            if (sc, a) == s and (sc, b) not in want:
                want[(sc, b)] = want[s] + 1
                todo.append((sc, b))
    assert got == want


def test_paths_are_the_smallest_shortest_ones(spark):
    rnd = random.Random(8)
    nodes = [f"n{i}" for i in range(40)]
    e = [("a", rnd.choice(nodes), rnd.choice(nodes)) for _ in range(75)] + [("b", f"m{i}", f"m{i + 1}") for i in range(21)] + [("b", "m3", "m3")]
    starts = [("a", "n1"), ("a", "n7"), ("b", "m0")]
    got = {(r.scan, r.node): r.path for r in G.traverse(spark.createDataFrame(e, "scan string, src_key string, dst_key string"), spark.createDataFrame(starts, "scan string, node string"), with_path=True).collect()}
    want, front = {s: [s[1]] for s in starts}, {s: [s[1]] for s in starts}
    while front:
        reached = {}
        for (sc, a), path in front.items():
            for s, x, y in e:
                if (s, x) == (sc, a) and (s, y) not in want:
                    reached[s, y] = min(reached.get((s, y), [*path, y]), [*path, y])
        want |= reached
        front = reached
    assert got == want and len(got["b", "m21"]) == 22


def test_node_merge_and_edge_insert(spark):
    w = spark.createDataFrame(
        [("s", "k", 1, "component", "first", 1.0, {"a": "1", "b": "1"}), ("s", "k", 2, "tool", "second", 0.5, {"b": "2"})],
        "scan string, key string, seq int, kind string, label string, confidence double, attrs map<string,string>",
    )
    n = G.merge_nodes(w).first()
    assert (n.kind, n.label, n.confidence, n.attrs) == ("component", "first", 1.0, {"a": "1", "b": "2"})
    ew = spark.createDataFrame([("s", "calls", "k", "k", 0.5, 2), ("s", "calls", "k", "k", 0.9, 1), ("s", "calls", "k", "gone", 1.0, 3)], "scan string, kind string, src_key string, dst_key string, confidence double, seq int")
    assert [(r.dst_key, r.confidence) for r in G.insert_edges(ew, w).collect()] == [("k", 0.9)]


def brute_overlap(start, end, lo, n):
    return start < lo <= end if n == 0 else start <= lo + n - 1 and lo <= end


def test_overlap_join_against_all_pairs(spark):
    rnd = random.Random(4)
    spans = [(i, f"p{rnd.randrange(3)}", a := rnd.randrange(1, 500), a + rnd.randrange(0, 200)) for i in range(80)]
    hunks = [(i, f"p{rnd.randrange(3)}", rnd.randrange(1, 600), rnd.randrange(0, 90)) for i in range(60)]
    got = J.overlap_join(spark.createDataFrame(spans, "sid int, path string, line_start int, line_end int"), spark.createDataFrame(hunks, "hid int, path string, lo int, n int"), ["path"], "lo", "n", width=16)
    want = sorted((s, h) for s, p, a, b in spans for h, q, lo, n in hunks if p == q and brute_overlap(a, b, lo, n))
    assert sorted((r.sid, r.hid) for r in got.collect()) == want


def test_one_to_one_match(spark):
    mk = lambda ks: spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "k string, id long")
    r = J.match_one_to_one(mk(["a", "a", "b"]), mk(["a", "c"]), ["k"], "id").collect()
    assert sorted((x.k, x.outcome) for x in r) == [("a", "matched"), ("a", "missed"), ("b", "missed"), ("c", "extra")]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_greedy_match_equals_taking_in_order(spark, seed):
    rnd = random.Random(seed)
    pairs = sorted({(rnd.randrange(25), rnd.randrange(25)) for _ in range(90)})
    got = {(r.t, r.p) for r in J.match_greedy(spark.createDataFrame(pairs, "t int, p int")).collect()}
    used, want = set(), set()
    for t in sorted({t for t, _ in pairs}):
        for p in sorted(p for a, p in pairs if a == t):
            if p not in used:
                used.add(p)
                want.add((t, p))
                break
    assert got == want


def test_call_site_candidates(spark):
    t = spark.createDataFrame([(1, "app.py", "chain", ["handle"]), (2, "p.py", "<module>", None), (3, "b.py", "Bot.reply", None)], "t int, file string, function string, also_accept array<string>")
    p = spark.createDataFrame([(1, "component:app.py::chain#llm0"), (2, "component:app.py::handle#llm1"), (3, "component:app.py::other#llm0"), (4, "component:other.py::chain#llm0"), (5, "component:p.py::<module>#llm0"), (6, "component:b.py::Bot.reply#llm0")], "p int, key string")
    assert sorted((r.t, r.p) for r in R.call_site_candidates(t, p).collect()) == [(1, 1), (1, 2), (2, 5), (3, 6)]


def test_keys(spark):
    df = spark.createDataFrame([("component:app/llm.py::Bot.reply#llm0",), ("app/x.py::f",), ("component:pages/1_File_Q&A.py::<module>#llm0",)], "k string")
    got = [tuple(r) for r in df.select(CH.key_file(F.col("k")), CH.key_symbol(F.col("k")), CH.qualname(F.col("k"))).collect()]
    assert got == [("app/llm.py", "Bot", "Bot.reply"), ("app/x.py", "f", "f"), ("pages/1_File_Q&A.py", "<module>", "<module>")]


@pytest.mark.parametrize("path,cls", [
    ("requirements-dev.txt", "dependency"), ("a/pyproject.toml", "dependency"), ("tests/test_a.py", "tests"), (".github/workflows/ci.yml", "repo_meta"), ("img/x.PNG", "repo_meta"),
    ("app/main.py", "app"), ("scripts/x.py", "support"), ("web/a.tsx", "other_source"), ("docs/a.md", "docs"), ("data/a.csv", "unknown"),
])
def test_file_classes(spark, path, cls):
    assert spark.createDataFrame([(path,)], "p string").select(CH.classify_file(F.col("p"))).first()[0] == cls


@pytest.mark.parametrize("pat,key,hit", [("a*", "abc", True), ("a?c", "abc", True), ("a[!b]c", "abc", False), ("a[b-d]c", "acc", True), ("a.c", "abc", False), ("*", "", True), ("a", "ab", False), ("x[1", "x[1", True)])
def test_glob(spark, pat, key, hit):
    import fnmatch

    assert fnmatch.fnmatchcase(key, pat) == hit
    assert spark.createDataFrame([(key,)], "k string").select(R.glob_match(F.col("k"), pat)).first()[0] == hit


CAND = "subject string, predicate string, value string, source string, fact_id long, direct boolean"


def test_reconcile_discounts_rivals(spark):
    df = spark.createDataFrame([("app", "model", "GPT ", "ast", 1, True), ("app", "model", "gpt", "readme", 2, True), ("app", "model", "llama", "readme", 3, True), ("x", "p", "v", "llm", 4, False)], CAND)
    got = {(r.subject, r.normalized): r for r in C.reconcile(df).collect()}
    gpt, llama = 1 - 0.05 * 0.5, 0.5
    a, b, x = got[("app", "gpt")], got[("app", "llama")], got[("x", "v")]
    assert a.confidence == round(gpt * (1 - 0.5 * llama), 3) and b.confidence == round(llama * (1 - 0.5 * gpt), 3)
    assert (a.value, a.method, a.observation, a.status) == ("GPT ", "deterministic", "direct_observation", "contested") and a.conflict_group == b.conflict_group
    assert (x.confidence, x.method, x.observation, x.status, x.conflict_group) == (0.4, "llm", "inference", "supported", None)
    members = C.members(df)
    st = {(r.normalized, r.fact_id): r.stance for r in C.evidence(members, C.reconcile(df)).where("subject = 'app'").collect()}
    assert st[("gpt", 1)] == st[("gpt", 2)] == "supports" and st[("gpt", 3)] == "contradicts"
    assert members.count() == 4 and len(st) == 6
    n = {(r.subject, r.normalized): (r.n_supports, r.n_contradicts) for r in C.evidence_counts(members).collect()}
    assert n == {("app", "gpt"): (2, 1), ("app", "llama"): (1, 2), ("x", "v"): (1, 0)}


def test_factored_evidence_equals_the_listed_bridge(spark):
    """Stored rows grow with the facts; the bridge, facts times claims, is only derived."""
    rnd = random.Random(4)
    rows = [(f"s{rnd.randrange(3)}", "p", f"v{rnd.randrange(6)} ", "ast", rnd.randrange(60), True) for _ in range(150)] + [("s0", "p", "V1", "ast", 77, True)]
    df = spark.createDataFrame(rows, CAND)
    members, claims = C.members(df), C.reconcile(df)
    own = {(s, v.strip().lower(), f) for s, _, v, _, f, _ in rows}
    assert {(r.subject, r.normalized, r.fact_id) for r in members.collect()} == own and members.count() == len(own)
    got = {(r.subject, r.normalized, r.fact_id): r.stance for r in C.evidence(members, claims).collect()}
    want = {(s, v, f): "supports" if (s, v, f) in own else "contradicts" for s, v in {(s, v) for s, v, _ in own} for f in {f for t, _, f in own if t == s}}
    assert got == want
    one = C.evidence(members, claims.where("subject = 's1' AND normalized = 'v2'"))
    assert {(r.fact_id, r.stance) for r in one.collect()} == {(f, x) for (s, v, f), x in want.items() if (s, v) == ("s1", "v2")}
    n = {(r.subject, r.normalized): (r.n_supports, r.n_contradicts) for r in C.evidence_counts(members).collect()}
    assert n == {k: tuple(sum(1 for (s, v, _), x in want.items() if (s, v) == k and x == y) for y in ("supports", "contradicts")) for k in n}


def test_counted_candidates_equal_listed_ones(spark):
    listed = spark.createDataFrame([("a", "p", "v", "readme", i, True) for i in range(3)] + [("a", "p", "w", "ast", 9, True)], CAND)
    counted = spark.createDataFrame([("a", "p", "v", "readme", 0, True, 3), ("a", "p", "w", "ast", 9, True, 1)], CAND + ", n long")
    f = lambda d: sorted((r.normalized, r.confidence, r.n_support) for r in C.reconcile(d).collect())
    assert f(listed) == f(counted)


def test_own_normalizer(spark):
    df = spark.createDataFrame([("a", "p", "1-2", "ast", 1, True), ("a", "p", "12", "ast", 2, True)], CAND)
    assert C.reconcile(df, normalize=lambda v: F.replace(v, F.lit("-"), F.lit(""))).count() == 1


def test_serving_flags(spark):
    s = spark.createDataFrame([("s", "k", "serve M --a=b --c d --bare --e f g")], "scan string, key string, command string")
    assert {r.flag: r.value for r in B.parse_flags(s).collect()} == {"a": "b", "c": "d", "bare": "true", "e": "f"}
    assert B.positional_model(s).first().model == "M"


SUITE = (
    I.SuiteItem("check:cite", "check", ("prompt:*",), ("prompt",)), I.SuiteItem("bench:perf", "benchmark", ("workflow:*",), ("prompt",)),
    I.SuiteItem("unit:tests/test_a.py", "unit", (), ()), I.SuiteItem("sec", "security", ("tool:*",), ("tool",)), I.SuiteItem("always", "check", (), (), True), I.SuiteItem("deps", "check", (), ("dependency",)),
)


def select(spark, affected=(), cats=(), changed=(), fall=(), lost=()):
    mk = lambda rows, s: spark.createDataFrame([("s", *r) for r in rows], "scan string, " + s)
    out = I.select_items(
        spark.createDataFrame([("s",)], "scan string"), SUITE, mk([(k, [k]) for k in affected], "key string, path array<string>"), mk([(c,) for c in cats], "category string"),
        mk([(c,) for c in changed], "path string"), mk([(f,) for f in fall], "reason string"), mk([(k,) for k in lost], "key string"),
    )
    return {r.item: (r.selected, r.reason) for r in out.collect()}


def test_selection_reasons(spark):
    r = select(spark, ["prompt:a", "tool:t"], ["prompt"], ["tests/test_a.py"])
    assert r["check:cite"] == (True, "prompt change reaches prompt:a") and r["unit:tests/test_a.py"][0] and r["always"][0]
    assert r["sec"] == (False, "exercises tool:t, but the change is not one it detects") and not r["bench:perf"][0] and not r["deps"][0]
    assert select(spark, ["prompt:a"], ["prompt"], lost=["prompt:a#system"])["bench:perf"] == (True, "prompt:a#system lost its stable prefix")
    assert select(spark, cats=["dependency"])["deps"] == (True, "a dependency manifest changed")
    assert all(sel and why.startswith("full suite: x") for sel, why in select(spark, fall=["y", "x"]).values())


def test_mentions_find_the_first_quoted_name(spark):
    files = spark.createDataFrame([("s", "app/a.py", "x = 1\ny = ROOT / \"docs\"\n"), ("s", "app/b.py", "z = 'docs/pairing.md'\n"), ("s", "n.md", "'docs'")], "scan string, path string, text string")
    names = spark.createDataFrame([("s", "docs"), ("s", "pairing.md"), ("s", "absent")], "scan string, name string")
    assert {r.name: r.at for r in I.mentions(files, names).collect()} == {"docs": "app/a.py:2", "pairing.md": "app/b.py:1"}


def test_fencing_and_backoff(spark):
    ev = [("j", 1, 1.0, "write", "w1", 1), ("j", 2, 2.0, "claim", "w1", 1), ("j", 3, 3.0, "write", "w1", 1), ("j", 4, 4.0, "claim", "w2", 2), ("j", 5, 5.0, "write", "w1", 1), ("j", 6, 6.0, "write", "w2", 2)]
    r = {x.seq: (x.fenced, x.backoff_s) for x in JB.fencing_audit(spark.createDataFrame(ev, "job string, seq int, t double, kind string, worker string, attempt int"), width=1.5).collect()}
    assert r == {1: (True, 5.0), 3: (False, 5.0), 5: (True, 5.0), 6: (False, 10.0)}


def test_event_decisions(spark):
    rows = [("ping", None, None, None, False), ("push", "opened", "a/b", "a/b", False), ("pull_request", "closed", "a/b", "a/b", False), ("pull_request", "opened", "x/y", "x/y", False),
            ("pull_request", "opened", "a/b", "z/b", False), ("pull_request", "opened", "A/b", "A/b", True), ("pull_request", "ready_for_review", "a/b", "a/b", True), ("pull_request", "opened", "a/b", None, False)]
    df = spark.createDataFrame(rows, "e string, a string, r string, h string, d boolean")
    got = [r[0] for r in df.select(CH.event_decision(*[F.col(c) for c in "earhd"][:2], F.col("r"), F.col("h"), F.col("d"), ["a/b"])).collect()]
    assert got == ["ping", "ignored push/opened", "ignored pull_request/closed", "repository not allowed", "fork", "draft", "accept", "fork"]


def test_identity_ignores_field_order(spark):
    df = spark.createDataFrame([("x", 1, None)], "a string, b int, c string")
    one = CH.content_identity([("a", F.col("a")), ("b", F.col("b")), ("c", F.col("c"))])
    two = CH.content_identity([("c", F.col("c")), ("b", F.col("b")), ("a", F.col("a"))])
    r = df.select(one, two, CH.content_identity([("a", F.col("a")), ("b", F.lit(2)), ("c", F.col("c"))])).first()
    assert r[0] == r[1] != r[2]


SPAN = "scan string, path string, key string, line_start int, line_end int"
HUNK = "scan string, path string, hunk_id int, new_start int, new_lines int, old_start int, old_lines int"


def test_hunks_meet_spans_once_for_both_sides(spark):
    """Sides in one block, in far blocks and over many, inserts, open spans, null sides, and a hunk id that comes in two files."""
    rnd = random.Random(5)
    line = lambda: rnd.randrange(1, 400)
    spans = [("s", f"app/{rnd.randrange(3)}.py", f"k{i % 50}", a := line(), rnd.choice([None, a, a + 3, a + 200])) for i in range(60)] + [(None, "app/0.py", "n", 1, 400)]
    hunks = [("s", rnd.choice(["app/0.py", "app/1.py", "app/3.py", "tests/2.py"]), i % 70, a := line(), rnd.choice([0, 1, 5, 150]), rnd.choice([a, a + 1, line(), None]), rnd.choice([0, 2, 90, None])) for i in range(90)]
    hunks += hunks[:5] + [(None, "app/0.py", 99, 1, 5, 1, 5)]

    def over(s, lo, n):
        e = s[3] if s[4] is None else s[4]
        return lo is not None and n is not None and (s[3] < lo <= e if n == 0 else s[3] <= lo + n - 1 and lo <= e)

    want = {(s[0], s[1], s[2], h[2]) for s in spans for h in hunks if s[:2] == h[:2] and s[0] and (over(s, h[3], h[4]) or over(s, h[5], h[6]))}
    sdf, hdf = spark.createDataFrame(spans, SPAN), spark.createDataFrame(hunks, HUNK)
    hits = I.hunk_hits(sdf, hdf)
    assert {tuple(r) for r in hits.collect()} == want and want
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert sum(" Join " in f" {x.strip(' +-:')} " for x in plan.splitlines()) == 1
    app = {(w[0], w[3]) for w in want if w[1].startswith("app/")}
    free = sorted((h[1], h[2], h[3]) for h in hunks if h[1].startswith("app/") and (h[0], h[2]) not in app)
    for known in (None, hits):
        assert sorted((r.path, r.hunk_id, r.new_start) for r in I.unmapped_hunks(sdf, hdf, known).collect()) == free
        assert {tuple(r) for r in I.touched_by_hunks(sdf, hdf, known).collect()} == {(w[0], w[2]) for w in want}


def test_call_edges_of_grouped_orders_equal_the_plain_join(spark, tmp_path):
    """Orders combined by customer before the joins give the edges of the plain text; keys repeat, are null or below zero."""
    from tracegauge.plans.registry import SHARED, SQL_VIEWS, view

    rnd = random.Random(6)
    cust = [(i, rnd.choice([-5.0, 100.0, 9000.0]), "BUILDING") for i in range(60)] + [(3, 1.0, "FURNITURE"), (None, 1.0, "BUILDING")]
    orders = [(rnd.choice([None, -1, -2, -3, rnd.randrange(500)]), rnd.choice([None, 1000, rnd.randrange(60)])) for _ in range(400)] + [(7, 2)] * 3
    spark.createDataFrame(cust, "c_custkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = [tuple(r) for r in view(spark, str(tmp_path), "call_edge").collect()]
    assert "bit_or" in SHARED["call_edge"][0]
    plain = SQL_VIEWS["call_edge"][1].replace("JOIN fn ", "JOIN {fn} ").replace("FROM orders ", "FROM {orders} ")
    want = spark.sql(plain, fn=view(spark, str(tmp_path), "fn"), orders=spark.read.parquet(f"{tmp_path}/orders.parquet")).collect()
    assert sorted(got) == sorted(tuple(r) for r in want) and got


CHANGED = "scan string, path string, status string"


def test_fallbacks_name_their_reason(spark):
    changed = spark.createDataFrame([
        ("s", "app/a.py", "modified"), ("s", "app/b.py", "added"), ("s", "app/c.py", "modified"), ("s", "data/rows.csv", "modified"), ("s", "docs/guide.md", "modified"),
        ("s", "docs/other.md", "modified"), ("s", "web/x.tsx", "modified"), ("s", "data/none.bin", "modified"), ("s", "app/d.py", "removed"), ("t", "data/rows.csv", "modified"),
        ("s", "tests/test_a.py", "modified"), ("s", "app/e.py", "added")], CHANGED)
    spans = spark.createDataFrame([("s", "app/a.py"), ("s", "app/c.py"), ("s", "app/e.py")], "scan string, path string")
    code = spark.createDataFrame([("s", "app/a.py", "x = 1\nopen('data/rows.csv')\nload(\"docs/guide.md\")"), ("s", "notes.txt", "'none.bin'"), ("t", "app/z.py", "rows.csv unquoted")], "scan string, path string, text string")
    bad = spark.createDataFrame([("s", "app/c.py"), ("s", "app/d.py")], "scan string, path string")
    reads = I.app_reads(code, changed)
    assert {(r.scan, r.path, r.at) for r in reads.collect()} == {("s", "data/rows.csv", "app/a.py:2"), ("s", "docs/guide.md", "app/a.py:3")}
    got = {(r.scan, r.path): r.reason for r in I.file_fallbacks(changed, spans, reads, bad).collect()}
    assert got == {
        ("s", "app/b.py"): "app/b.py was added and maps to no graph node", ("s", "app/c.py"): "app/c.py does not parse as Python",
        ("s", "data/rows.csv"): "data/rows.csv is read by application code (app/a.py:2) and maps to no graph node",
        ("s", "docs/guide.md"): "docs/guide.md is read by application code (app/a.py:3) and maps to no graph node",
        ("s", "web/x.tsx"): "web/x.tsx: source the analysis does not parse", ("s", "data/none.bin"): "data/none.bin: a file the analysis does not model",
        ("s", "app/d.py"): "app/d.py was removed and maps to no graph node", ("t", "data/rows.csv"): "data/rows.csv: a file the analysis does not model"}


def test_a_hunk_in_unknown_code_selects_the_full_suite(spark):
    spans = spark.createDataFrame([("s", "component:app/a.py::f", "app/a.py", 10, 20), ("t", "component:app/a.py::f", "app/a.py", 10, 20)], "scan string, key string, path string, line_start int, line_end int")
    hunk = "scan string, path string, hunk_id int, new_start int, new_lines int, old_start int, old_lines int"
    hunks = spark.createDataFrame([("s", "app/a.py", 1, 12, 2, 12, 1), ("t", "app/a.py", 2, 40, 2, 40, 1), ("t", "tests/test_a.py", 3, 1, 1, 1, 1)], hunk)
    got = [(r.scan, r.reason) for r in I.hunk_fallbacks(spans, hunks).collect()]
    assert got == [("t", "app/a.py:40 changes code that maps to no graph node")]
    none = lambda schema: spark.createDataFrame([], schema)
    scans = spark.createDataFrame([("s",), ("t",)], "scan string")
    suite = (I.SuiteItem("unit:x", "unit", ("component:app/zzz*",), ("code",)),)
    sel = I.select_items(scans, suite, none("scan string, key string, path array<string>"), none("scan string, category string"), none(CHANGED), I.hunk_fallbacks(spans, hunks), none("scan string, key string"))
    assert {(r.scan, r.selected, r.reason) for r in sel.collect()} == {
        ("s", False, "exercises nothing this change touches"), ("t", True, "full suite: app/a.py:40 changes code that maps to no graph node")}


def test_touched_keys_and_lost_prefixes(spark):
    spans = spark.createDataFrame([("s", "call", "p", 1, 5), ("s", "far", "p", 50, 60)], "scan string, key string, path string, line_start int, line_end int")
    hunks = spark.createDataFrame([("s", "p", 1, 3, 1, 3, 1)], "scan string, path string, hunk_id int, new_start int, new_lines int, old_start int, old_lines int")
    digest = "scan string, key string, digest string"
    base = spark.createDataFrame([("s", "same", "a"), ("s", "differs", "a"), ("s", "gone", "a"), ("s", "null", None)], digest)
    head = spark.createDataFrame([("s", "same", "a"), ("s", "differs", "b"), ("s", "new", "a"), ("s", "null", None), ("s", "call", "x")], digest)
    owners = spark.createDataFrame([("s", "call", "f"), ("s", "far", "g")], "scan string, key string, owner string")
    got = {r.key: r.via for r in I.touched_keys(spans, hunks, base, head, owners).collect()}
    assert got == {"call": "attributes", "f": "owner", "differs": "attributes", "gone": "attributes", "new": "attributes"}
    m = "scan string, key string, path string, dynamic_head boolean"
    was = spark.createDataFrame([("s", "a#system", "p", False), ("s", "b#system", "p", True), ("s", "c#system", "p", False)], m)
    now = spark.createDataFrame([("s", "a#system", "p", True), ("s", "b#system", "p", True), ("s", "c#system", "p", False), ("s", "d#system", "p", True)], m)
    assert [r.key for r in I.lost_prefix(was, now).collect()] == ["a#system"]


def test_finding_match_takes_every_emitted_finding(spark, monkeypatch):
    from tracegauge.plans import findings as P
    from tracegauge.plans.registry import QUERIES

    keys = [f"prompt:app/m{i}.py::ask{i % 10}#p{i}" for i in range(9)] + ["prompt:app/m9.py::odd_1#p9"]
    rows = [("s1", "obs.prompt_versioning", k) for k in keys] + [("s1", "rel.llm_timeout", "component:app/m3.py::ask3#llm3")]
    df = spark.createDataFrame(rows, "scan string, rule_id string, subject string")
    monkeypatch.setattr(P, "findings", lambda spark, d: df)
    got = sorted(tuple(r) for r in QUERIES["J9_finding_match"](spark, "").collect())
    assert got == [(k, k) for k in sorted(keys[:9])]  # of even length; every third id too


def test_hop_distance_writes_its_edges_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(G, "written", lambda df, name, real=G.written: names.append(name) or real(df, name))
    nodes = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", "c", 2), ("s", "d", 3), ("s", "n", None)], "scan string, key string, layer int")
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "a", "b"), ("s", "d", "b"), ("s", "b", "c"), ("s", "b", "n")], "scan string, src_key string, dst_key string")
    h = G.hop_distance(nodes, edges, spark.createDataFrame([("s", "b")], "scan string, key string"))
    assert sorted((r.direction, r.node, r.hop) for r in h.collect()) == [("left", "a", 1), ("right", "b", 0), ("right", "c", 1), ("right", "d", 1)]
    assert names.count("edges") == 1
