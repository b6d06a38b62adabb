"""Operators against brute-force versions on small fixtures: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import io
import random
import re
import time
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from tracegauge.llm import decontaminate, licenses, packing, pii, quality, queries, relative_lz, repeats, suffixes, urls, warc

DOC = "doc_id bigint, text string, quality string, hits int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "q", 1) for i, t in texts], DOC)


def test_quality_edges(spark):
    good = "\n".join(" ".join(f"{w}{i}" for i in range(9)).capitalize() + "." for w in ("alpha", "beta", "gamma", "delta"))
    texts = [(0, None), (1, ""), (2, good), (3, good + "\nHome | About | Contact | Help"), (4, "word " * 400), (None, good), (2, good), (5, "a | b | c | d\n" * 40)]
    df = frame(spark, texts)
    got = {(r.doc_id, r.text): r for r in quality.assess(df, into="found").select("doc_id", "text", "found.*").collect()}
    assert got[0, None].n_words == 0 and not got[0, None].kept
    assert got[2, good].kept and got[2, good].cleaned == good and got[None, good].kept
    assert got[3, texts[3][1]].kept and got[3, texts[3][1]].cleaned == good
    assert got[4, texts[4][1]].n_repeat_words == 400 and got[4, texts[4][1]].base_failed
    assert not got[5, texts[7][1]].kept
    kept = quality.clean(df)
    plans = [x._jdf.queryExecution().optimizedPlan().toString().count("sort_array(transform") for x in (quality.assess(df), kept)]
    assert plans[0] == plans[1] > 0  # no rule is evaluated twice
    assert kept.columns == df.columns and kept.count() == 4 and quality.clean(df.limit(0)).count() == 0


def test_licences_equal_a_plain_search(spark):
    rng = random.Random(5)
    words = "the mit License of GNU general Public license apache mit-license MIT licence lcense".split()
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(90, None), (None, ""), (91, "É\nMIT\n  License " + "x " * 9000 + "apache   license")]
    df = frame(spark, texts)
    got = {(r.doc_id, i): r for i, r in enumerate(sorted(licenses.scan(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id)))}
    by_id = {r.doc_id: r for r in got.values()}
    for i, t in texts:
        low = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want = {(k, n.label) for n in licenses.NOTICES if n.base for k in range(len(low)) if low[k:k + len(n.phrase.split())] == n.phrase.split()}
        r = by_id[i]
        assert r.n_words == len(low) and r.base_words == sorted(k for k, _ in want) and r.base_labels == sorted({x for _, x in want})
        line = " " + " ".join(low) + " "
        for n in licenses.NOTICES[:3]:
            fuzzy = regex.search(rf"(?<= )(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}(?= )", line)
            assert bool(fuzzy) == any(m.label == n.label and m.edits <= n.edits for m in r.matches)


def test_every_notice_is_found_with_its_place_and_edits(spark):
    """Each notice exact, with a changed letter, and twice in a row; places, spans, edits and score of all of them."""
    rows, want = [], {}
    for i, n in enumerate(licenses.NOTICES):
        words = n.phrase.split()
        typo = n.phrase.replace("e", "x", 1)
        rows += [(3 * i, f"So. {n.phrase.upper()}; so"), (3 * i + 1, f"a {typo}"), (3 * i + 2, f"{typo}, {n.phrase} - {typo}")]
        size = len(words)
        want[3 * i] = [(1, size, 0)]
        want[3 * i + 1] = [(1, size, int(typo != n.phrase))]
        want[3 * i + 2] = [(k * size, (k + 1) * size - 1, int(k != 1 and typo != n.phrase)) for k in range(3)]
    texts = dict(rows)
    for r in licenses.scan(frame(spark, rows)).collect():
        n = licenses.NOTICES[r.doc_id // 3]
        own = [m for m in r.matches if m.label == n.label and m.last_word - m.first_word == len(n.phrase.split()) - 1]
        assert [(m.first_word, m.last_word, m.edits) for m in own] == want[r.doc_id], (n.phrase, r)
        low = [re.sub(r"[^a-z0-9]+", " ", texts[r.doc_id][m.start:m.end].lower()) for m in own]
        assert all(x in (n.phrase, n.phrase.replace("e", "x", 1)) for x in low)
        assert r.score == max(1 - m.edits / len(licenses.NOTICES[k].phrase) for m in r.matches for k in [next(k for k, o in enumerate(licenses.NOTICES) if o.label == m.label)]) or r.score >= 1 - 1 / len(n.phrase)
    both = licenses.scan(frame(spark, [(1, "mit licence or mit license"), (2, "mit license " * 3000)])).collect()
    assert {r.doc_id: len([m for m in r.matches if m.label == "mit"]) for r in both} == {1: 2, 2: 3000}


def test_personal_data_of_a_very_long_text_is_linear():
    crf = pii.SemiCRF(pii.train().w)
    piece = "Mail anna.berg@mail.example.org or call +49 30 1234 5678 from 10.20.30.40, says Dr. Ines Vogel of 12 Lind Road. "
    seconds = []
    for n in (500, 4000):
        t = time.perf_counter()
        base, spans = pii.find(piece * n, crf)
        seconds.append(time.perf_counter() - t)
        assert len(base) == 3 * n and set(base) <= set(spans)
        plain = [(a, b, k) for a, b, k in spans if (a, b, k) not in set(base)][:200]
        assert not any(x < b and a < y for a, b, _ in plain for x, y, _ in base[:1000])
    assert seconds[1] < 20 * seconds[0] + 1  # eight times the text


@pytest.mark.parametrize("block", [decontaminate.BLOCK_CHARS, 60])
def test_decontamination_equals_a_plain_search(spark, block):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((2, 5, 13, 16))))) for i in range(12)] + [(50, None), (51, "  "), (3, "W1, w2!")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) + "." + (items[i % 12][1].upper() if i % 2 else "")) for i in range(40)] + [(77, None), (77, "")]
    df, it = frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.text): r.found for r in decontaminate.annotate(df, it, into="found", block_chars=block).collect()}
    for i, t in docs:
        words = decontaminate.words_of(t)
        hit, seen = set(), set()
        for item, x in items:
            w = decontaminate.words_of(x)
            for k in range(max(1, len(w) - 12) if w else 0):
                window = w[k:k + 13]
                for p in range(len(words) - len(window) + 1):
                    if words[p:p + len(window)] == window:
                        hit |= set(range(p, p + len(window)))
                        seen.add(str(item))
        r = got[i, t]
        assert r.n_words == len(words) and sum(h.end - h.start for h in r.hit) == len(hit) and r["items"] == sorted(seen)
        assert all(decontaminate.words_of(t[s.start:s.end]) == words[h.start:h.end] for s, h in zip(r.spans, r.hit, strict=True))
    assert decontaminate.clean(df, it).columns == df.columns and decontaminate.annotate(df, it.limit(0)).count() == len(docs)


def test_pii(spark):
    for text, spans in pii.sentences(200, 12):
        base = pii.base_spans(text)
        brute = [(*m.span(), "email") for m in pii.EMAIL.finditer(text)]
        assert [s for s in base if s[2] == "email"] == brute
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("a0.@_-% 1+") for _ in range(rng.randint(0, 24)))
        assert list(pii.emails(text)) == [m.span() for m in pii.EMAIL.finditer(text)]
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000) == []
    crf = pii.train()
    held = pii.sentences(300, 123)
    hits = sum(len(set(g) & set(crf.best(t))) for t, g in held)
    assert hits / sum(len(g) for _, g in held) > 0.95 and hits / sum(len(crf.best(t)) for t, _ in held) > 0.93
    texts = [(0, None), (1, ""), (None, "a@b.co x"), (2, "Prose without any of it, version 2.0."), (3, "x " * 40_000 + "call 10.20.30.40"), (3, "+1 (017) 555-7713")]
    df = frame(spark, texts)
    out = pii.clean(df)
    assert out.columns == df.columns
    assert {r.text for r in out.collect()} == {None, "", "<email> x", texts[3][1], "x " * 40_000 + "call <ip>", "<phone>"}
    assert pii.scan(df).count() == len(texts) and pii.scan(df.limit(0)).count() == 0


def test_pii_query(spark, tmp_path):
    texts = [(0, None), (1, "a@b.co or 10.0.0.1, +1 (017) 555-7713"), (2, "4111 1111 1111 1111 x@y.org")]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op8_pii"](spark, str(tmp_path)).collect()}
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in map(got.get, range(3))] == [(0, 0, 0, 0), (1, 1, 0, 1), (1, 0, 1, 0)]
    shown = {0: "", 1: "email:0:6,ip:10:18,phone:20:37", 2: "card:0:19,email:20:27"}
    assert all(got[i].base_sha256 == hashlib.sha256(s.encode()).hexdigest() and set(s.split(",")) <= set(got[i].spans.split(",")) for i, s in shown.items())


def test_packing(spark):
    rng = random.Random(4)
    texts = [(i % 60, " ".join(rng.choice(("alpha", "Beta,", "été", "x1")) for _ in range(rng.choice((0, 3, 30, 200, 2100))))) for i in range(120)] + [(None, None), (7, "")]
    rows = packing.pack(frame(spark, texts)).collect()
    tokenizer = packing.encoder(packing.default_vocabulary()).tokenizer
    want = Counter()
    for i, t in texts:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        want.update((i, p, s, min(2048, n - s)) for p, s in enumerate(range(0, n, 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1 + 1.02 * sum(r.length for r in rows) / 2048 + 1
    assert packing.pack(frame(spark, texts).limit(0)).count() == 0


def test_urls_equal_a_plain_match(spark):
    rng = random.Random(8)
    names = ["com", "a.com", "b.a.com", "net", "x.net", "COM"]
    rules = [(rng.choice(names), rng.choice(["", "/", "/a", "/a/b"]), v) for v in ("allow", "block") for _ in range(6)] + [(None, "/", "block")]
    pages = [(i, f"http{'s' * (i % 2)}://{rng.choice(['', 'www.', 'b.', 'xa'])}{rng.choice(names)}{rng.choice(['', '/', '/a/b?q', '/ab#x', '/a/b/c'])}", "k") for i in range(200)]
    pages += [(500, None, "k"), (501, "no scheme", "k"), (None, "http://", "k"), (502, "http://a.com/", "k"), (502, "http://a.com/", "k")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, host string")
    got = Counter(urls.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    want = Counter()
    for i, url, _ in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fits = sorted((-len(h + p), h.lower() + p, v) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p))
        want[i, host, path, fits[0][1] if fits else None, fits[0][2] if fits else "allow"] += 1
    assert got == want


def test_warc(spark):
    big = "p" * 200
    pages = [(3, "http://a b", big), (1, None, big), (1, None, big), (2, "u", None), (4, "u", "short"), (5, "u", "short"), (None, "u", big), (6, "é", "é" * 300_000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter()
    for i, _, h in pages:
        again = h == big and i != 1
        want[i, len((h or "").encode()), sha(h), "revisit" if again else "response", 1 if again else None] += 1
    assert rows == want
    raw = warc.record(1, "u", b"x" * 10, 10, hashlib.sha256(b"x" * 10).hexdigest(), None)
    for samples in ([b"abc"], [b"some text %d" % i * 30 for i in range(400)]):
        f = io.BytesIO()
        warc.write(f, iter([raw] * 3), warc.train(samples))
        assert [warc.parse(r)["payload"] for r in warc.read(io.BytesIO(f.getvalue()))] == [b"x" * 10] * 3
        with pytest.raises(warc.BadArchive):
            list(warc.read(io.BytesIO(f.getvalue()[:-3])))
    with pytest.raises(warc.BadArchive):
        warc.parse(raw.replace(b"xxxxxxxxxx", b"xxxxxxxxxy"))
    with pytest.raises(warc.BadArchive):
        warc.read(io.BytesIO(b"no archive")).__next__()


def plain_removal(rows, length):
    out = []
    for i, seq in rows:
        order = float("inf") if i is None else i
        known = {tuple(s[k:k + length]) for j, s in rows if (float("inf") if j is None else j) < order for k in range(len(s) - length + 1)}
        gone = set()
        for k in range(len(seq) - length + 1):
            if tuple(seq[k:k + length]) in known:
                gone |= set(range(k, k + length))
        out.append((i, len(seq), len(gone), [x for k, x in enumerate(seq) if k not in gone]))
    return out


def passages(units, n, seed):
    rng = random.Random(seed)
    shared = [[rng.choice(units) for _ in range(rng.randint(45, 140))] for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 3)):
            part = list(rng.choice(shared))
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = rng.choice(units)
            lo = rng.randint(0, 20)
            parts += [rng.choice(units) for _ in range(rng.randint(0, 30))] + part[lo:]
        rows.append((rng.choice((i, i, i, 5, None)), parts))
    return rows + rows[:6]


@pytest.mark.parametrize("hot", [repeats.GROUP, 3])
def test_repeated_bytes_and_words_equal_a_plain_search(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "GROUP", hot)
    rows = passages("abé \n", 40, 1)
    df = frame(spark, [(i, "".join(p)) for i, p in rows] + [(900, None), (901, "")])
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect())
    assert got == Counter((i, n, g, bytes(k)) for i, n, g, k in plain_removal([(i, list("".join(p).encode())) for i, p in rows] + [(900, []), (901, [])], 50))
    rows = passages([f"w{i}" for i in range(9)], 40, 2)
    df = frame(spark, [(i, "\t".join(p)) for i, p in rows] + [(900, None), (901, " ")])
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in relative_lz.remove_repeats(df).collect())
    assert got == Counter((i, n, g, " ".join(k)) for i, n, g, k in plain_removal([*rows, (900, []), (901, [])], 50))


def common_passage(words, n, length, seed):
    """Most texts hold one passage, whole or from a place on, between words of their own; some of those are shared by two."""
    rng = random.Random(seed)
    middle = [rng.choice(words) for _ in range(length)]
    out = []
    for i in range(n):
        own = [f"{rng.choice(words)}" for _ in range(rng.randrange(70))]
        a = rng.choice([0, 0, 0, 1, 7])
        text = [*own, *(middle[a:] if i % 8 else []), *[rng.choice(words) for _ in range(rng.randrange(70))]]
        out.append((i, text if i % 10 or not out else list(out[-1][1][3:])))
    return out


@pytest.mark.parametrize("group", [repeats.GROUP, 5])
def test_one_passage_in_most_texts(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = common_passage("abcdefgh é\n", 120, 130, 3)
    got = Counter((r.doc_id, r.n_removed, bytes(r.kept)) for r in suffixes.remove_repeats(frame(spark, [(i, "".join(t)) for i, t in rows])).collect())
    assert got == Counter((i, g, bytes(k)) for i, _, g, k in plain_removal([(i, list("".join(t).encode())) for i, t in rows], 50))
    rows = common_passage([f"w{i}" for i in range(40)], 90, 130, 4)
    got = Counter((r.doc_id, r.n_removed, r.kept) for r in relative_lz.remove_repeats(frame(spark, [(i, " ".join(t)) for i, t in rows])).collect())
    assert got == Counter((i, g, " ".join(k)) for i, _, g, k in plain_removal(rows, 50))


def test_surroundings_of_a_crowded_gram_become_few(spark):
    rows = common_passage([f"w{i}" for i in range(3000)], 400, 130, 9)
    docs = repeats.keyed(frame(spark, [(i, " ".join(t)) for i, t in rows]), "doc_id", "text")
    firsts = docs.groupBy("k1", "k2").agg(F.min("ord").alias("ord"))
    places = repeats.materialize(repeats.surroundings(docs, firsts, repeats.shared_anchors(docs, relative_lz.SHAPE), relative_lz.SHAPE), "places")
    crowded = repeats.crowded_grams(places)
    before = places.join(crowded, "gram", "left_semi")
    after = repeats.trimmed(before, relative_lz.SHAPE)
    most = lambda df: df.select("gram", "c1", "c2").distinct().groupBy("gram").count().agg(F.max("count")).first()[0]
    assert most(before) > 150 and most(after) < 60


def test_maximal_repeats_list_all_occurrences():
    strings = [b"xxabcabcdyy", b"zabcabcdw", b"abcabc"]
    got = {(d, frozenset(zip(n.tolist(), o.tolist(), strict=True))) for d, n, o in suffixes.maximal_repeats(strings, 3)}
    everything = {}
    for i, s in enumerate(strings):
        for a in range(len(s)):
            for b in range(a + 3, len(s) + 1):
                everything.setdefault(s[a:b], []).append((i, a))
    want = set()
    for v, at in everything.items():
        lefts = {strings[i][a - 1:a] or (i, a) for i, a in at}
        rights = {strings[i][a + len(v):a + len(v) + 1] or (i, a) for i, a in at}
        if len(at) > 1 and len(lefts) > 1 and len(rights) > 1:
            want.add((len(v), frozenset(at)))
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert suffixes.remove_repeats(none).count() == relative_lz.remove_repeats(none).count() == licenses.scan(none).count() == 0
    assert quality.assess(none, into="found").where(F.col("found")["kept"]).count() == 0
