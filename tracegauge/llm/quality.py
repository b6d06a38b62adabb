"""Line-first cleaning with DataFrame functions only.

Every line is judged alone (punctuation, navigation, boilerplate); failing lines go, and a document
that loses too much of its text goes with them. Counting rules over the whole text come first.
Null text counts as empty (no words, rejected); a null id is carried along; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.common import SPACE, let

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document that loses more than this share of its characters with its lines is rejected.
MAX_LOST_PERCENT = 50

#: Line rules, by reason. Patterns read alike in Java and RE2.
NAVIGATION = r"\|[^|]*\|[^|]*\|"
BOILERPLATE = (
    r"(?i)\b(javascript is (required|disabled)|enable javascript|cookie (policy|settings)|uses cookies|privacy policy|"
    r"terms of (use|service)|all rights reserved|sign in|log in|subscribe to|click here|read more|share this|skip to content)\b"
)
#: Symbols that prose hardly has, and shouted or doubled sentence marks.
ODD_MARKS = r"[#*$%&|<>{}\\^~=+_@/]"
SHOUTING = r"[!?]{2,}"
LETTER = r"\p{L}"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def count_repeat_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that the text has at least twice; linear but for one sort of the windows."""

    def doubled(h: Column, step: int) -> Column:
        left = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, 1, left), F.slice(h, step + 1, left), lambda a, b: F.xxhash64(a, b))

    def covered(places: Column) -> Column:
        n = F.size(places)
        gaps = F.zip_with(F.slice(places, 2, n - 1), F.slice(places, 1, n - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda acc, g: acc + g)

    def repeated(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(ranked, lambda s: F.filter(
            F.transform(s, lambda e, i: F.when(
                ((i > 0) & (e["h"] == F.get(s, i - 1)["h"])) | (e["h"] == F.get(s, i + 1)["h"]), e["i"])),
            lambda x: x.isNotNull()))
        return let(F.sort_array(places), covered)

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(repeated(windows))

    one = F.transform(words, lambda w: F.xxhash64(w))
    two = let(one, lambda h: doubled(h, 1))
    four = let(two, lambda h: doubled(h, 2))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(let(let(four, lambda h: doubled(h, 4)), count))


def line_fails(line: Column) -> Column:
    """Navigation bars, boilerplate phrases, lines without letters, full of symbols, or shouting."""
    marks = F.regexp_count(line, F.lit(ODD_MARKS))
    shouts = F.regexp_count(line, F.lit(SHOUTING))
    return (
        line.rlike(NAVIGATION) | line.rlike(BOILERPLATE) | ~line.rlike(LETTER)
        | (marks * 5 > F.length(line)) | ((shouts >= 3) & (shouts * 20 > F.length(line)))
    )


def assess(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into``: counts, verdicts and ``cleaned`` (the text without failing lines)."""
    body = F.coalesce(F.col(text), F.lit(""))
    raw = f"{into}__"
    staged = docs.withColumn(raw, F.struct(
        body.alias("body"), split_words(body).alias("words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"),
    ))
    words, lines, whole = F.col(raw)["words"], F.col(raw)["lines"], F.col(raw)["body"]
    staged = staged.withColumn(raw, F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        count_repeat_words(words).cast("long").alias("n_repeat_words"),
        F.size(lines).alias("n_lines"),
        F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)).alias("line_chars"),
        F.filter(lines, lambda x: ~line_fails(x)).alias("kept_lines"),
        whole.alias("body"),
    ))
    q = F.col(raw)
    failed = (q["n_words"] < MIN_WORDS) | (q["n_repeat_words"] * 100 > q["n_words"] * MAX_REPEAT_PERCENT)
    lost = q["line_chars"] - F.aggregate(q["kept_lines"], F.lit(0), lambda a, x: a + F.length(x))
    return staged.withColumn(into, F.struct(
        *(q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"),
        (~failed & (lost * 100 <= q["line_chars"] * MAX_LOST_PERCENT)).alias("kept"),
        (q["n_lines"] - F.size(q["kept_lines"])).cast("long").alias("n_failed_lines"),
        F.when(F.size(q["kept_lines"]) == q["n_lines"], q["body"]).otherwise(F.array_join(q["kept_lines"], "\n")).alias("cleaned"),
    )).drop(raw)


def clean(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """Kept documents with failing lines removed, in the columns of ``docs``."""
    into = "_".join(["quality", *docs.columns])
    # judged once: without the one-element generator the filter would be pushed below and every rule run again above it
    judged = assess(docs, text, into)
    once = judged.select(*(f"`{c}`" for c in docs.columns), F.explode_outer(F.array(F.col(into))).alias(into))
    kept = once.where(F.col(into)["kept"])
    out = {text: F.col(into)["cleaned"]}
    if n_chars in docs.columns:
        out[n_chars] = F.length(F.col(into)["cleaned"]).cast(docs.schema[n_chars].dataType)
    return kept.select(*(out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
