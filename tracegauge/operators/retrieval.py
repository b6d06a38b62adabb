"""BM25 retrieval over sectioned documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.functions.text import strip
from tracegauge.session import written

# Okapi parameters and the floor for terms that occur in more than half of the chunks.
K1, B, EPSILON = 1.5, 0.75, 0.25


def sections(docs: DataFrame) -> DataFrame:
    """``## heading`` sections of each document (text before the first heading is no section)."""
    parts = F.slice(F.split("text", r"(?m)^## "), 2, 2147483647)
    s = docs.select("doc_id", F.posexplode_outer(parts).alias("section", "s")).where("section IS NOT NULL")
    return s.select(
        "doc_id", "section", strip(F.split_part("s", F.lit("\n"), F.lit(1))).alias("heading"),
        strip(F.when(F.instr("s", "\n") > 0, F.expr("substring(s, instr(s, '\n') + 1)")).otherwise("")).alias("body"),
    )


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(chunks: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """Top chunks per query. ``chunks``: chunk_id, text; ``queries``: query_id, text.

    One pass counts each term's chunks, the corpus size and its length, combined before the shuffle: a row per distinct
    term and task moves. A second pass meets the terms of the queries first, so postings of other terms are neither
    shuffled nor written; where the query terms are few Spark broadcasts them and the postings do not move at all: the chunks
    have been dealt by their ids before, which costs the text once. Only the top k per query leave a task.
    """
    tok = chunks.select("chunk_id", terms(F.col("text")).alias("_t"))
    # a chunk has each of its terms once, and one NULL row with its length for the corpus
    once = tok.select(F.size("_t").alias("len"), F.explode(F.array_append(F.array_distinct("_t"), F.lit(None))).alias("term"))
    vocabulary = written(once.groupBy("term").agg(F.count("*").alias("df"), F.sum("len").alias("len")), "vocabulary")
    corpus = vocabulary.where("term IS NULL")
    n, avg_len = corpus.select("df").scalar(), corpus.select(F.col("len") / F.col("df")).scalar()
    raw = vocabulary.where("term IS NOT NULL").withColumn("idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean_idf = raw.agg(F.avg("idf")).scalar()
    idf = raw.select("term", F.when(F.col("idf") < 0, mean_idf * EPSILON).otherwise(F.col("idf")).alias("idf"))
    q = queries.select("query_id", F.explode_outer(terms(F.col("text"))).alias("term")).where("term IS NOT NULL").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = written(q.join(idf, "term"), "asked")
    wanted = asked.select("term").distinct()
    # a chunk's text moves once, to the task of its id: counts and scores are then made there, and no posting moves
    here = chunks.repartition("chunk_id").select("chunk_id", terms(F.col("text")).alias("_t"))
    places = here.select("chunk_id", F.size("_t").alias("len"), F.explode_outer("_t").alias("term")).join(wanted, "term", "left_semi")
    postings = places.groupBy("chunk_id", "len", "term").agg(F.count("*").alias("tf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg_len))
    scores = postings.join(asked, "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
