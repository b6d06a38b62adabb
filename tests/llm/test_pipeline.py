"""The whole pipeline beside plain Python: which documents survive, what is left of them, and how their tokens are packed."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near import brute_components
from tracegauge.llm import pii, quality

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars int"


def plain_quality(text):
    """The cleaned text of a kept document, else None."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    repeated = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    if len(words) < 20 or 100 * len(repeated) > 30 * len(words):
        return None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]

    def fails(x):
        return bool(
            regex.search(quality.NAVIGATION, x) or regex.search(quality.BOILERPLATE, x) or not regex.search(quality.LETTER, x)
            or 5 * len(regex.findall(quality.ODD_MARKS, x)) > len(x)
            or (len(regex.findall(quality.SHOUTING, x)) >= 3 and 20 * len(regex.findall(quality.SHOUTING, x)) > len(x)))

    kept = [x for x in lines if not fails(x)]
    if 100 * (sum(map(len, lines)) - sum(map(len, kept))) > 50 * sum(map(len, lines)):
        return None
    return text if len(kept) == len(lines) else "\n".join(kept)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(text, items):
    words, hit = plain_words(text), set()
    for item in items:
        body = plain_words(item)
        for k in range(max(1, len(body) - 12)) if body else ():
            window = body[k:k + 13]
            for i in range(len(words) - len(window) + 1):
                if words[i:i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
    return bool(hit) and 20 * len(hit) >= len(words)


def corpus():
    rng = random.Random(11)
    stock = [f"{a}{b}" for a in ("ha", "lo", "mi", "ter", "von", "su", "bra") for b in ("den", "ling", "ro", "sta", "vik", "ne", "pol", "gar")]

    def prose(n):
        return ". ".join(" ".join(rng.choice(stock) for _ in range(rng.randint(6, 14))).capitalize() for _ in range(n)) + "."

    items = [" ".join(rng.choice(stock) for _ in range(n)) for n in (5, 13, 30)]
    rows = [prose(rng.randint(4, 40)) for _ in range(30)]
    for i in range(0, 12, 2):
        words = rows[i].split()
        words[len(words) // 2] = "changed"
        rows.append(" ".join(words))
    rows += [rows[1], rows[3], rows[3], prose(3) + " " + items[1] + " " + prose(1), items[2].upper() + "\n" + prose(2), prose(400) + " " + items[1]]
    rows += [prose(6) + "\nHome | About | Contact | Help\nAll rights reserved\n" + prose(3), "a | b | c | d\n" * 40, "too short", "same words again and again here now " * 30]
    rows += [prose(5) + " Write to anna.berg@mail.example.org or +49 30 1234 5678.", None, "", " \n", prose(600)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(10 * k + 3, rows[i], "en", "s", len(rows[i] or "")) for k, i in enumerate(order)], list(enumerate(items))


def expected(docs, items):
    """(doc_id, text) behind the fourth stage."""
    kept = [(i, c) for i, t, *_ in docs if (c := plain_quality(t)) is not None]
    roots = brute_components([t for _, t in kept])
    first = {}
    for (i, _), r in zip(kept, roots, strict=True):
        first[r] = min(first.get(r, i), i)
    kept = [(i, t) for (i, t), r in zip(kept, roots, strict=True) if first[r] == i]
    kept = [(i, t) for i, t in kept if not contaminated(t, [t for _, t in items])]
    crf = pii.SemiCRF(pii.train().w)
    return {i: pii.redact(t, pii.find(t, crf)[1]) for i, t in kept}


def test_pipeline_equals_plain_python(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = expected(docs, items)
    assert len(want) > 25 and any("<email>" in t for t in want.values())
    assert {r.doc_id for r in pieces} == set(want)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    places = defaultdict(list)
    for i, text in want.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.piece)
        cuts = [len(ids)] if len(ids) <= 2048 else [*[2048] * (len(ids) // 2048), *([len(ids) % 2048] if len(ids) % 2048 else [])]
        assert [(r.piece, r.start, r.length) for r in own] == [(k, sum(cuts[:k]), n) for k, n in enumerate(cuts)]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in own]
        for r in own:
            places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
    total = sum(r.length for r in pieces)
    assert -(-total // 2048) <= len(places) <= 1.2 * total / 2048 + 1


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, None, None, None, None)]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
