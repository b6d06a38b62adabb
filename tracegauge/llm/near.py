"""Near-duplicates by Jaccard similarity of five-word shingles, 0.8 or more: SimHash and MinHash candidates, exact verification.

SimHash comes first, by op1's multi-index hashing: the fingerprint's bits are majorities over the shingle set, and sets whose
fingerprints are equal or differ in 3 bits or fewer are candidates. Most pairs at 0.8 differ in more bits, so MinHash goes on
from the components of that step and finds the rest.

A text's sketch is ``BANDS`` x ``ROWS`` minima of its shingle hashes; texts that agree in all minima of a band meet in a
place. A pair of similarity s meets nowhere with probability (1 - s^5)^48: 5e-9 at 0.8, 2e-12 at 0.85. Every link is
verified on the complete shingle sets, so no pair below ``LEAST`` is linked.

Texts of one shingle set are one entry. Components grow from SimHash's in two steps, neither of which lists the pairs of a place:

1. in each place one entry, a pivot, is compared with all others. The first pivot is the entry that meets most others,
   so the text that many copies were made from links its copies at once; the second is the heaviest of the place's smallest
   component;
2. places that still hold several components go through an exact prefix filter. Shingles that only one component has
   cannot be shared with another one, so an entry with less than 0.8 of its shingles elsewhere is done. The others
   list their rarest common shingles, as many as a partner must share one of; two entries meet at such a shingle if what
   they both have from there on may still suffice. Those pairs are verified, and no other pair of two
   components can be linked.

Shingle sets are kept only of entries that meet another one.

Null and empty texts have one empty set in common and are copies of each other; letters A-Z count as lower case. A null id
never names a component unless all its ids are null; rows that repeat an id and text are copies. Only the id and
the text are read, so other columns may have any names. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.common import discard, map_batches, materialize
from tracegauge.llm.components import components
from tracegauge.llm.simhash import chosen_rows, keep_chosen, majority, near_links, shingle_hashes, text_key

SHINGLE = 5
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 48, 5
_FACTORS = np.random.default_rng(42).integers(1 << 62, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(grams: np.ndarray) -> np.ndarray:
    """The place of every band: a hash of the band's number and its minima. A text without words has one for itself."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(grams), 1024):
        least = np.minimum(least, (_FACTORS[:, None] * grams[None, lo:lo + 1024]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, key, fp, size, sim, places) per row: ``fp`` names the shingle set, ``size`` counts it, ``sim`` is its SimHash fingerprint."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            memo: dict[bytes, tuple[bytes, int, int, np.ndarray]] = {}
            keys = batch.column(1).to_pylist()
            for key, t in zip(keys, batch.column(2).to_pylist(), strict=True):
                if key not in memo:
                    grams = np.unique(shingle_hashes(t, SHINGLE))
                    memo[key] = xxhash.xxh3_128_digest(grams.tobytes()), len(grams), majority(grams), sketch(grams)
            found = [memo[k] for k in keys]
            places = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([f[3] for f in found])))
            sims = pa.array(np.array([f[2] for f in found], np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int32()), sims, places],
                names=[batch.schema.names[0], "key", "fp", "size", "sim", "places"])

        return step

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col), text_key(F.col(text)).alias("key"), F.col(text))
    return map_batches(rows, make, f"`{id_col}` {kind}, key binary, fp binary, size int, sim bigint, places array<bigint>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(fp, grams) of the wanted (fp, key)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(shingle_hashes(t, SHINGLE)).view(np.int64) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "grams"])

        return step

    texts = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text")).join(wanted, "key")
    return map_batches(texts.groupBy("fp").agg(F.min("text").alias("text")), make, "fp binary, grams array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    num, den = LEAST
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("grams").alias("ga")), "a").join(
        sets.select(F.col("fp").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where(den * shared >= num * (F.size("ga") + F.size("gb") - shared)).select("a", "b")


def simhash_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of shingle sets by their fingerprints: all of one fingerprint with the first of them, and the first ones of
    near fingerprints as op1 links them."""
    entries = materialize(rows.select("fp", "sim").distinct(), "entries")
    firsts = materialize(entries.groupBy("sim").agg(F.min("fp").alias("first")), "firsts")
    same = entries.join(firsts, "sim").where("fp != first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    near = near_links(firsts.select(F.col("sim").alias("fp")))
    x, y = (firsts.select(F.col("sim").alias(c), F.col("first").alias(f"of_{c}")) for c in ("x", "y"))
    linked = near.join(x, "x").join(y, "y").select(F.least("of_x", "of_y").alias("a"), F.greatest("of_x", "of_y").alias("b"))
    out = materialize(same.union(linked).distinct(), "pairs")
    discard(entries, firsts)
    return out


def open_places(met: DataFrame) -> DataFrame:
    """(place, heaviest, second): the places of ``met`` (place, fp, size, weight, root) with several components, with
    their heaviest entry and the heaviest of their smallest component."""
    parts = met.groupBy("place", "root").agg(F.count("*").alias("n"), F.max(F.struct("weight", "fp")).alias("best"))
    of = parts.groupBy("place").agg(
        F.count("*").alias("parts"), F.max("best").alias("first"), F.min_by("best", F.struct("n", "root")).alias("last"))
    return of.where("parts > 1").select("place", F.col("first.fp").alias("heaviest"), F.col("last.fp").alias("second"))


def pivot_pairs(met: DataFrame, pivot: str) -> DataFrame:
    """Distinct pairs (a, b) of the pivot of each open place and an entry of another component."""
    num, den = LEAST
    held = met.join(open_places(met).select("place", F.col(pivot).alias("pivot")), "place")
    pivots = held.where("fp = pivot").select("place", F.col("fp").alias("x"), F.col("size").alias("sx"), F.col("root").alias("rx"))
    near = (F.col("rx") != F.col("root")) & (F.least("sx", "size") * den >= F.greatest("sx", "size") * num)
    return held.join(pivots, "place").where(near).select(F.least("x", "fp").alias("a"), F.greatest("x", "fp").alias("b")).distinct()


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may be similar enough; ``sets``: fp, root, grams. No similar pair is missing."""
    num, den = LEAST
    grams = sets.select("fp", "root", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    common = grams.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("df")).where("lo < hi")
    held = grams.join(common.select("gram", "df"), "gram").groupBy("fp", "root", "size").agg(
        F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("common"))  # of one text
    n, m = F.col("size"), F.size("common")
    least = F.floor((n * num + den - 1) / den)  # what any partner must share
    # of the whole set in order, with the shingles of its own component first, a partner shares one of the first n - least + 1
    first = F.greatest(F.lit(0), m - least + 1).cast("int")
    seats = held.where(m >= least).select("fp", "root", "size", m.alias("m"), F.posexplode(F.slice("common", F.lit(1), first)).alias("at", "c"))
    seats = materialize(seats.select("fp", "root", "size", (F.col("m") - F.col("at")).alias("left"), F.col("c.gram").alias("gram")), "seats")
    x, y = (seats.select("gram", *[F.col(c).alias(f"{c}_{tag}") for c in ("fp", "root", "size", "left")]) for tag in ("a", "b"))
    enough = F.least("left_a", "left_b") * (num + den) >= (F.col("size_a") + F.col("size_b")) * num
    sized = F.least("size_a", "size_b") * den >= F.greatest("size_a", "size_b") * num
    pairs = x.join(y, "gram").where((F.col("root_a") < F.col("root_b")) & enough & sized)
    out = materialize(pairs.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct(), "pairs")
    discard(seats)
    return out


def links(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame | None:
    """(node, root) of the shingle sets that reach another one by links, or None. ``rows`` as ``sketches`` returns them."""
    seats = rows.select("fp", "size", F.explode("places").alias("place"))
    crowd = materialize(seats.groupBy("place").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("place"), "crowd")
    met = materialize(seats.join(crowd, "place").select("place", "fp", "size").distinct(), "met")
    heavy = met.join(met.groupBy("place").agg(F.count("*").alias("n")), "place").groupBy("fp").agg(F.sum("n").alias("weight"))
    weighed = materialize(met.join(heavy, "fp").select("place", "fp", "size", "weight"), "weighed")
    discard(crowd, met)
    firsts = rows.groupBy("fp").agg(F.min("key").alias("key"))  # copies are one row before they are looked up
    alike = simhash_pairs(rows)
    meeting = weighed.select("fp").union(alike.select("a")).union(alike.select("b")).distinct()
    wanted = firsts.join(meeting, "fp", "left_semi")
    sets = materialize(shingle_sets(docs, wanted, text), "sets")
    roots: DataFrame | None = None

    def rooted(df: DataFrame) -> DataFrame:
        if roots is None:
            return df.withColumn("root", F.col("fp"))
        return df.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    def joined(pairs: DataFrame) -> DataFrame | None:
        fresh = materialize(verified(pairs, sets), "verified")
        discard(pairs)
        if fresh.isEmpty():
            discard(fresh)
            return roots
        edges = fresh if roots is None else fresh.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        out = materialize(components(edges), "roots")
        discard(fresh, *([] if roots is None else [roots]))
        return out

    roots = joined(alike)
    for pivot in ("heaviest", "second"):
        roots = joined(materialize(pivot_pairs(rooted(weighed), pivot), "pairs"))
    state = rooted(weighed)
    apart = state.join(open_places(state).select("place"), "place", "left_semi").select("fp", "root").distinct()
    roots = joined(prefix_pairs(sets.join(apart, "fp").select("fp", "root", "grams")))
    discard(weighed, sets)
    return roots


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rows: DataFrame | None = None) -> DataFrame:
    """(id, key, fp, root, component): the component is the smallest id that links of similarity ``LEAST`` or more reach."""
    rows = materialize(sketches(docs, id_col, text), "sketches") if rows is None else rows
    roots = links(docs, rows, text)
    own = rows.select(id_col, "key", "fp")
    if roots is None:
        labelled = own.withColumn("root", F.col("fp"))
    else:
        labelled = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = labelled.groupBy("root").agg(F.min(id_col).alias("component"))
    return labelled.join(names, "root").select(id_col, "key", "fp", "root", "component")


def clean(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the smallest id, then the smallest text key; repeated rows of it once."""
    rows = materialize(sketches(docs, id_col, text), "sketches")
    roots = links(docs, rows, text)
    own = rows.select(id_col, "key", "fp")
    own = own.withColumn("root", F.col("fp")) if roots is None else own.join(
        roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = materialize(chosen_rows(own, id_col), "chosen")  # a row per component; all other tables go
    discard(rows, *([] if roots is None else [roots]))
    return keep_chosen(docs, chosen, id_col, text)
