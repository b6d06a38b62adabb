"""Prefix reuse across prompts, shared-prefix groups and snapshot checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegauge.functions.text import approx_token_count, approx_tokens, common_prefix_length, prefix_block_digests
from tracegauge.operators.ordered import time_bucket


Tokenizer = Callable[[Column], Column]
#: Prompts of a span, where none is given.
SPAN = 1 << 20


def prompt_blocks(prompts: DataFrame, block: int = 16, tokenize: Tokenizer = approx_tokens) -> DataFrame:
    """(seq, pos, digest) for every full leading block of every prompt.

    ``tokenize`` maps the text column to its token array; any Column function (also an Arrow UDF
    around a model's tokenizer) can stand in for the default words-and-punctuation split.
    """
    t = tokenize(F.col("prompt"))
    # the token array is its own column: inside the fold it would be computed again for every block
    split = prompts.select("seq", t.alias("_tok"))
    rows = split.select("seq", F.posexplode_outer(prefix_block_digests(F.col("_tok"), block)).alias("pos", "digest"))
    return rows.where("pos IS NOT NULL")


def prefix_reuse(prompts: DataFrame, block: int = 16, tokenize: Tokenizer = approx_tokens) -> DataFrame:
    """Per prompt: tokens, full blocks and leading blocks already seen in an earlier prompt.

    A chained digest is new only where it occurs first, and a prompt's reuse ends at its first new
    block. So one combined aggregate finds first occurrences and a second one the first miss per
    prompt; the blocks themselves are never joined back, however often one prefix repeats.
    """
    firsts = prompt_blocks(prompts, block, tokenize).groupBy("digest").agg(F.min(F.struct("seq", "pos")).alias("f"))
    miss = firsts.groupBy(F.col("f.seq").alias("seq")).agg(F.min("f.pos").alias("_miss"))
    text = F.col("prompt")
    n = approx_token_count(text) if tokenize is approx_tokens else F.size(tokenize(text))
    size = prompts.select("seq", n.cast("long").alias("n_tokens")).withColumn(
        "n_blocks", F.floor(F.col("n_tokens") / block)
    )
    return size.join(miss, "seq", "left").select(
        "seq", "n_tokens", "n_blocks", F.coalesce(F.col("_miss").cast("long"), F.col("n_blocks")).alias("reused_blocks")
    )


def reuse_ratio(reuse: DataFrame, block: int = 16, keys: Sequence[str] = ()) -> DataFrame:
    g = reuse.groupBy(*keys).agg(
        F.sum(F.col("reused_blocks") * block).alias("reused_tokens"), F.sum("n_tokens").alias("total_tokens")
    )
    return g.withColumn("ratio", F.when(F.col("total_tokens") > 0, F.col("reused_tokens") / F.col("total_tokens")).otherwise(0.0))


def reuse_gap_curve(prompts: DataFrame, gaps: Sequence[int], block: int = 16, span: float | None = None) -> DataFrame:
    """Reused tokens when only prefixes used within the last ``g`` prompts count, for several g.

    ``seq`` must be a dense prompt number. The previous use of a block is looked up inside spans of
    prompts, so a block that every prompt shares does not fill one task. Uses that reach into the next span by the
    largest gap stand there too; older ones count for no gap. So texts are cut once and blocks move once.
    """
    width, reach = float(max(SPAN if span is None else span, *gaps)), max(gaps)
    own, ahead = (time_bucket(F.col("seq") + more, width) for more in (0, reach))
    blocks = prompt_blocks(prompts, block).withColumns({"_own": own, "_span": F.explode(F.array_distinct(F.array(own, ahead)))})
    before = F.lag("seq").over(Window.partitionBy("digest", "_span").orderBy("seq"))
    prev = blocks.withColumn("_prev", before).where(F.col("_span").eqNullSafe(F.col("_own")))
    age = F.col("seq") - F.col("_prev")
    first_miss = [F.min(F.when(age.isNull() | (age > g), F.col("pos"))).alias(f"m{g}") for g in gaps]
    per = prev.groupBy("seq").agg(F.count("*").alias("_n"), *first_miss)
    curve = F.array(*[
        F.struct(F.lit(g).alias("gap"), F.coalesce(F.col(f"m{g}").cast("long"), F.col("_n")).alias("run")) for g in gaps
    ])
    return per.select(F.explode(curve).alias("c")).groupBy("c.gap").agg((F.sum("c.run") * block).alias("reused_tokens"))


def shared_prefix(prompts: DataFrame, key: str, text: str = "prompt", order: str = "seq") -> DataFrame:
    """Shortest prefix every prompt of the key shares with the key's first prompt."""
    first = prompts.groupBy(key).agg(F.min_by(text, order).alias("_first"))
    # the first prompts are few and the comparison is combined map-side: the texts need no shuffle
    j = prompts.select(key, text).join(first, key)
    return j.groupBy(key).agg(F.min(common_prefix_length(F.col(text), F.col("_first"))).alias("shared"))


def snapshot_prefix_check(base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """PASS if the head keeps 90 % of the base's shared prefix; INCONCLUSIVE if that is not meaningful
    or the two snapshots do not ask the same distinct questions."""
    asked = lambda df, tag: df.groupBy(key, F.md5("question").alias("question")).agg(F.count("*").alias(tag))
    both = asked(base, "_b").join(asked(head, "_h"), [key, "question"], "full_outer")
    same = both.groupBy(key).agg(F.bool_and((F.coalesce("_b", F.lit(0)) == 1) & (F.coalesce("_h", F.lit(0)) == 1)).alias("_same"))
    role = base.groupBy(key).agg(F.min_by("first_role", "seq").alias("_role"))
    s = (
        shared_prefix(base, key).withColumnRenamed("shared", "base_shared")
        .join(shared_prefix(head, key).withColumnRenamed("shared", "head_shared"), key)
        .join(role, key).join(same, key)
    )
    required = F.floor(F.col("base_shared") * 0.9)
    status = (
        F.when(~F.col("_same") | (required <= F.length("_role") + 1), "INCONCLUSIVE")
        .when(F.col("head_shared") >= required, "PASS")
        .otherwise("FAIL")
    )
    return s.select(key, "base_shared", "head_shared", required.alias("required"), status.alias("status"))


def prefix_groups(prompts: DataFrame) -> DataFrame:
    """Requests sharing an identical system prompt (at least two): share of all and common prefix tokens."""
    total = prompts.agg(F.count("*").alias("_all"))
    g = prompts.where(F.length("system") > 0).withColumn("prefix_hash", F.sha2("system", 256))
    first = g.groupBy("prefix_hash").agg(F.count("*").alias("n"), F.min_by("prompt", "seq").alias("_first")).where("n >= 2")
    j = g.select("prefix_hash", "prompt").join(first, "prefix_hash").select(
        "prefix_hash", "n", approx_tokens(F.col("prompt")).alias("_a"), approx_tokens(F.col("_first")).alias("_b")
    )
    a, b = F.col("_a"), F.col("_b")
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    common = F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b)))
    per = j.groupBy("prefix_hash").agg(F.min(common.cast("long")).alias("tokens"), F.max("n").alias("n"))
    # grouped by the whole digest, shown short
    return per.select(F.substring("prefix_hash", 1, 12).alias("prefix_hash"), "n", "tokens", (F.col("n") / total.scalar()).alias("share"))
