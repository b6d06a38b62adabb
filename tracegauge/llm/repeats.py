"""Routing for long repeats between documents: which places must be compared, and where.

A repeat is a run of ``length`` units (bytes or words) that also starts in a document with a smaller id. Every
run of that many units holds an anchor: the unit ``gram`` with the least hash among the run's grams, chosen by the run's
content alone. Equal runs have equal anchors, so:

1. anchors of all texts are counted by hash; those in one text only take no further part;
2. each remaining anchor's surroundings (all runs that hold it lie in them) go to the solver by the gram. Where a gram has
   more of them than a task's share, runs are counted first (combined before the shuffle), and surroundings are cut
   to the stretches whose runs stand in two documents: where a passage begins or ends, N different
   surroundings become one. What is left of such a gram goes by the gram together with half of what a run may reach on
   its right, and again with as much on its left, since a run reaches that far on one side at least, as do grams with
   more than GROUP surroundings;
3. the solver (the operator's own method) finds which stretches of a surrounding stand in which earliest document;
4. answers go back to every occurrence, and are united per text.

Ids are whole numbers. Equal texts take part once, as the text of their smallest id; every later copy is a repeat as a whole. Surroundings
that many texts share are solved once per distinct content, so a passage in a third of all texts is one entry of one
group, and its occurrences meet the answer in a join that Spark may split. Hashes shrink with the text, nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.common import discard, materialize, partitions, release_shuffles

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Units hashed at once, and bytes of surroundings solved at once (whole groups).
CHUNK = 1 << 19
BLOCK_BYTES = 2 << 20
#: Surroundings of one gram that a solver's task may hold, where its share of all is larger.
GROUP = 50_000
#: Times as many, beyond which they are reduced before they are dealt out.
TRIMMED = 4
#: Bytes of text to a bucket of anchors.
BUCKET_BYTES = 64 << 20
LAST = (1 << 63) - 1


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left ^ (left >> np.uint64(29))) * _A + (right ^ (right >> np.uint64(32))) * _B


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` units, by doubling."""
    power, size = (units.astype(np.uint64) + np.uint64(1)) * _A, 1
    out, done = None, 0
    while size <= k:
        if k & size:
            if out is None:
                out, done = power, size
            else:
                n = len(units) - done - size + 1
                out, done = _join(out[:n], power[done:done + n]), done + size
        n = len(units) - 2 * size + 1
        if n <= 0:
            break
        power, size = _join(power[:n], power[size:size + n]), size * 2
    if out is None or done < k:
        return np.zeros(0, np.uint64)
    out = (out ^ (out >> np.uint64(31))) * _B
    return out ^ (out >> np.uint64(29))


def _slide(x: np.ndarray, w: int, pick: Callable) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``w`` neighbours."""
    n, size = len(x) - w + 1, 1
    while size * 2 <= w:
        x, size = pick(x[:-size], x[size:]), size * 2
    return pick(x[:n], x[w - size:w - size + n])


def anchors(units: np.ndarray, text_no: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of concatenated texts; no run crosses from one text to the next."""
    if len(units) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(units, k)
    w = length - k + 1
    low = _slide(h, w, np.minimum)
    low[text_no[:len(low)] != text_no[length - 1:]] = 0  # a run in two texts chooses nothing
    edge = np.zeros(w - 1, np.uint64)
    chosen = _slide(np.concatenate([edge, low, edge]), w, np.maximum)
    at = np.nonzero(chosen == h)[0]
    return at, h[at]


@dataclass(frozen=True)
class Shape:
    """Units of a text, and the sizes that go with them."""

    units: Callable[[str | None], np.ndarray]
    length: int
    gram: int

    @property
    def beside(self) -> int:
        return self.length - self.gram

    @property
    def half(self) -> int:
        return (self.beside + 1) // 2


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, ord, k1, k2, text): the id with nulls last, and a 128-bit key of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"),
        F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(7), body).alias("k2"), body.alias("text"))


def _packed(n: int, no: np.ndarray, keys: np.ndarray, h: np.ndarray, at: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """Anchors of a batch as one row per bucket. known: 1 needs no answer and may go anywhere, 2 is shared and speaks for those."""
    bucket = np.where(known == 1, keys[no] % n, (h % np.uint64(n)).astype(np.int64))
    order = np.argsort(bucket, kind="stable")
    bucket, key, h, at, known = bucket[order], keys[no[order]], h[order], at[order], known[order]
    cuts = np.nonzero(np.diff(bucket))[0] + 1
    cols = [[x.tobytes() for x in np.split(c, cuts)] for c in (key, h, at.astype("<u4"), known)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[np.r_[0, cuts]].astype(np.int32)), *(pa.array(c, pa.binary()) for c in cols)],
                                      names=["bucket", "key", "hash", "at", "known"])


def buckets(rows: DataFrame) -> int:
    """Buckets of anchors: as many as the session shuffles to, more where Spark expects more text than they should hold."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(rows.sparkSession), size // BUCKET_BYTES if size < 1 << 60 else 0)


def shared_anchors(rows: DataFrame, shape: Shape) -> DataFrame:
    """(k1, at): one row per text that has any, with the places of its anchors that stand in another text as well."""
    n = buckets(rows)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a text that is in the batch twice is read once
            _, rows = np.unique(b.column(0).to_numpy(), return_index=True)
            keys = b.column(0).to_numpy()[rows]
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            held: list[np.ndarray] = []
            first = 0

            def flush(upto: int) -> None:
                if not held:
                    return
                sizes = [len(u) for u in held]
                no = np.repeat(np.arange(first, upto), sizes)
                starts = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
                at, h = anchors(np.concatenate(held), no, shape.length, shape.gram)
                found.append((no[at], h, at - starts[at]))
                held.clear()

            texts, units = b.column(1), 0
            for i, r in enumerate(rows.tolist()):
                held.append(shape.units(texts[r].as_py()))
                units += len(held[-1])
                if units >= CHUNK:
                    flush(i + 1)
                    first, units = i + 1, 0
            flush(len(rows))
            no, h, at = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(h):
                continue
            # anchors that two texts of the batch share are known at once; one of them goes on to tell the others
            order = np.lexsort((no, h))
            sh, sn = h[order], no[order]
            new = np.r_[True, sh[1:] != sh[:-1]]
            group = np.cumsum(new) - 1
            ends = np.r_[np.nonzero(new)[0][1:], len(sh)] - 1
            several = (sn[ends] != sn[np.nonzero(new)[0]])[group]
            known = np.zeros(len(h), np.uint8)
            known[order] = np.where(several, np.where(new, 2, 1), 0)
            yield _packed(n, no, keys, h, at, known)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.concatenate([np.frombuffer(x, t) for x in c.to_pylist()]) for c, t in zip(b.columns[1:], ("<i8", "<u8", "<u4", "u1"), strict=True)]
                 for b in batches if b.num_rows]
        if not parts:
            return
        key, h, at, known = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        shared = known > 0
        ask = np.nonzero(known != 1)[0]
        order = ask[np.lexsort((key[ask], h[ask]))]
        if len(order):
            new = np.r_[True, h[order][1:] != h[order][:-1]]
            heads = np.nonzero(new)[0]
            ends = np.r_[heads[1:], len(order)] - 1
            shared[order] |= (key[order][ends] != key[order][heads])[np.cumsum(new) - 1]
        key, at = key[shared], at[shared]
        target = key % n
        order = np.argsort(target, kind="stable")
        target, key, at = target[order], key[order], at[order]
        if len(key):
            cuts = np.nonzero(np.diff(target))[0] + 1
            cols = [pa.array([x.tobytes() for x in np.split(c, cuts)], pa.binary()) for c in (key, at.astype("<u4"))]
            yield pa.RecordBatch.from_arrays([pa.array(target[np.r_[0, cuts]].astype(np.int32)), *cols], names=["target", "key", "at"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.concatenate([np.frombuffer(x, t) for x in c.to_pylist()]) for c, t in zip(b.columns[1:], ("<i8", "<u4"), strict=True)]
                 for b in batches if b.num_rows]
        if not parts:
            return
        key, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        edges = np.r_[0, np.nonzero(np.diff(key))[0] + 1, len(key)]
        for lo in range(0, len(edges) - 1, 4096):
            e = edges[lo:lo + 4097]
            spans = pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), pa.array(at[e[0]:e[-1]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(key[e[:-1]]), spans], names=["k1", "at"])

    packed = rows.select("k1", "text").mapInArrow(emit, "bucket int, key binary, hash binary, at binary, known binary")
    asked = packed.repartition(n, "bucket").mapInArrow(meet, "target int, key binary, at binary")
    return asked.repartition(n, "target").mapInArrow(gather, "k1 bigint, at array<int>")


def surroundings(rows: DataFrame, firsts: DataFrame, shared: DataFrame, shape: Shape) -> DataFrame:
    """One row per shared anchor of each distinct text: its gram's hash, its surroundings with their hash (c1, c2) and start, and its place in them."""
    texts = rows.join(firsts.join(shared, "k1"), ["k1", "k2", "ord"]).select("k1", "k2", "ord", "at", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                if (out := part(b.slice(lo, 256))) is not None:
                    yield out

    def part(b: pa.RecordBatch) -> pa.RecordBatch | None:
        row, start, at, body, gram = [], [], [], [], []
        for r in range(b.num_rows):
            units = shape.units(b.column(4)[r].as_py())
            width, n, raw = units.itemsize, len(units), units.tobytes()
            found = np.unique(b.column(3)[r].values.to_numpy())
            low, high = np.maximum(found - shape.beside, 0), np.minimum(found + shape.length, n)
            fits = (high - low >= shape.length) & (found + shape.gram <= n)
            for p, lo, hi in zip(found[fits].tolist(), low[fits].tolist(), high[fits].tolist(), strict=True):
                row.append(r)
                start.append(lo)
                at.append(p - lo)
                body.append(raw[lo * width:hi * width])
                gram.append(raw[p * width:(p + shape.gram) * width])
        if not row:
            return None
        own = [b.column(i).take(pa.array(row)) for i in range(3)]
        content = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, body)), "<i8").reshape(-1, 2)
        grams = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, gram)), "<i8")
        cols = [pa.array(start, pa.int64()), pa.array(at, pa.int32()), pa.array(body, pa.binary()), pa.array(content[:, 0].copy()), pa.array(content[:, 1].copy()), pa.array(grams)]
        return pa.RecordBatch.from_arrays([*own, *cols], names=["k1", "k2", "ord", "start", "at", "body", "c1", "c2", "gram"])

    return texts.mapInArrow(cut, "k1 bigint, k2 bigint, ord bigint, start bigint, at int, body binary, c1 bigint, c2 bigint, gram bigint")


#: A solver sees distinct surroundings (bytes) with the smallest id each stands in, and returns (number, start, end) of
#: stretches that also stand in a document with a smaller id than that.
Solver = Callable[[list[bytes], list[int]], list[tuple[int, int, int]]]


def crowded_grams(places: DataFrame) -> DataFrame:
    """(gram, trim): grams with more surroundings than GROUP or than half of a task's even share, to be dealt out by more
    than the gram; ``trim`` marks those beyond that share or several times GROUP, to be reduced first."""
    per = places.groupBy("gram").count()
    total = per.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    share = total // (2 * partitions(places.sparkSession))
    held = per.where(F.col("count") > min(GROUP, share))
    return materialize(held.select("gram", (F.col("count") > min(TRIMMED * GROUP, share)).alias("trim")), "crowded")


def trimmed(hot: DataFrame, shape: Shape) -> DataFrame:
    """The surroundings ``hot``, cut to the stretches whose runs stand in two documents; ``start``, ``at``, ``body`` and its hash follow."""
    width = shape.units("").itemsize
    of = ["gram", "c1", "c2"]
    contents = materialize(hot.groupBy(*of).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.first("body").alias("body")), "contents")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, h = [], [], []
            for r, body in enumerate(b.column(5).to_pylist()):
                found = gram_hashes(np.frombuffer(body, f"u{width}"), shape.length)
                row.append(np.full(len(found), r))
                at.append(np.arange(len(found), dtype=np.int32))
                h.append(found.view(np.int64))
            if row:
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(5)), pa.array(np.concatenate(at)), pa.array(np.concatenate(h))],
                                                 names=[*of, "lo", "hi", "i", "run"])

    listed = contents.select(*of, "lo", "hi", "body").mapInArrow(runs, "gram bigint, c1 bigint, c2 bigint, lo bigint, hi bigint, i int, run bigint")
    # written, so that the join below is between two tables and a run that most of them have may be split
    shared = materialize(listed.groupBy("gram", "run").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a < b").select("gram", "run"), "runs")
    kept = listed.select(*of, "i", "run").join(shared, ["gram", "run"]).groupBy(*of).agg(F.sort_array(F.collect_list("i")).alias("i"))
    found = contents.select(*of, "body").join(kept, of)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, lo, body = [], [], []
            for r, (raw, at) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                # from the first such run to the last: all runs hold the gram, so what is left does
                row.append(r)
                lo.append(at[0])
                body.append(raw[at[0] * width:(at[-1] + shape.length) * width])
            if row:
                d = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, body)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).take(pa.array(row)) for i in range(3)), pa.array(lo, pa.int32()), pa.array(body, pa.binary()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())],
                    names=[*of, "skip", "part", "d1", "d2"])

    parts = found.mapInArrow(cut, "gram bigint, c1 bigint, c2 bigint, skip int, part binary, d1 bigint, d2 bigint")
    out = hot.drop("body").join(parts, of)
    out = out.select("k1", "k2", "ord", (F.col("start") + F.col("skip")).alias("start"), (F.col("at") - F.col("skip")).alias("at"),
                     F.col("part").alias("body"), F.col("d1").alias("c1"), F.col("d2").alias("c2"), "gram")
    done = materialize(out, "trimmed")
    discard(contents, shared)
    return done


def dealt(places: DataFrame, shape: Shape) -> tuple[DataFrame, list[DataFrame]]:
    """The places (a written table), with those of crowded grams trimmed and marked ``hot``, and the tables they are in."""
    crowded = crowded_grams(places)
    flags = crowded.withColumn("hot", F.lit(True))
    marked = places.join(flags, "gram", "left").select(*places.columns, F.coalesce("hot", F.lit(False)).alias("hot"), F.coalesce("trim", F.lit(False)).alias("trim"))
    if crowded.where("trim").isEmpty():
        return marked.drop("trim"), [places, crowded]
    hot = materialize(places.join(crowded.where("trim"), "gram", "left_semi").select(places.columns), "hot")
    cut = trimmed(hot, shape)
    discard(hot)
    return marked.where("NOT trim").drop("trim").unionByName(cut.withColumn("hot", F.lit(True))), [places, crowded, cut]


def answers(places: DataFrame, shape: Shape, solve: Solver) -> DataFrame:
    """(c1, c2, least, spans): the smallest id that distinct surroundings stand in, and their stretches known from smaller ones."""
    n = partitions(places.sparkSession)
    digest = xxhash.xxh3_64_digest

    def sides(body: bytes, at: int, width: int) -> Iterator[bytes]:
        """What a run around a crowded gram surely holds: the gram and half of what it may reach on its left, or on its right."""
        if at >= shape.half:
            yield b"<" + body[(at - shape.half) * width:(at + shape.gram) * width]
        if len(body) >= (at + shape.gram + shape.half) * width:
            yield b">" + body[at * width:(at + shape.gram + shape.half) * width]

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal surroundings of a batch become one row per key."""
        width = shape.units("").itemsize
        for b in batches:
            if not b.num_rows:
                continue
            o, c1, c2, gram = (b.column(i).to_numpy() for i in (0, 1, 2, 3))
            order = np.lexsort((o, gram, c2, c1))
            new = np.r_[True, (np.diff(c1[order]) != 0) | (np.diff(c2[order]) != 0) | (np.diff(gram[order]) != 0)]
            heads = np.nonzero(new)[0]
            ends = np.r_[heads[1:], len(order)] - 1
            pick = order[heads]
            rows = b.take(pa.array(pick))
            least, top, key = o[pick], o[order[ends]], gram[pick].copy()
            hot = rows.column(4).to_numpy(zero_copy_only=False)
            parts = [(np.arange(len(pick)), key)]
            if (crowd := np.nonzero(hot)[0]).size:
                pairs = [(i, int.from_bytes(digest(s), "little", signed=True))
                         for i in crowd.tolist() for s in sides(rows.column(6)[i].as_py(), rows.column(5)[i].as_py(), width)]
                calm = np.setdiff1d(np.arange(len(pick)), crowd)
                parts = [(calm, key[calm]), (np.array([i for i, _ in pairs], np.int64), np.array([k for _, k in pairs], np.int64))]
            for take, keys in parts:
                if len(take):
                    t = rows.take(pa.array(take))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(least[take]), pa.array(top[take]), t.column(6), t.column(1), t.column(2)],
                                                     names=["key", "ord", "top", "body", "c1", "c2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size, at = 0, None
        for b in batches:
            for key, o, top, body, c1, c2 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != at and size >= BLOCK_BYTES:
                    yield from solved(held)
                    held, size = {}, 0
                at = key
                if (entry := held.get((c1, c2))) is None:
                    held[c1, c2] = [o, top, body]
                    size += len(body)
                else:
                    entry[0], entry[1] = min(entry[0], o), max(entry[1], top)
        if held:
            yield from solved(held)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def solved(held: dict[tuple[int, int], list]) -> Iterator[pa.RecordBatch]:
        keys, (least, top, bodies) = list(held), (list(x) for x in zip(*held.values(), strict=True))
        spans: dict[int, list[dict]] = {}
        for i, a, b in solve(bodies, least):
            spans.setdefault(i, []).append({"start": a, "end": b})
        told = [i for i in range(len(keys)) if i in spans or top[i] > least[i]]
        if told:
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i][0] for i in told], pa.int64()), pa.array([keys[i][1] for i in told], pa.int64()),
                 pa.array([least[i] for i in told], pa.int64()), pa.array([spans.get(i, []) for i in told], span)], names=["c1", "c2", "least", "spans"])

    thinned = places.select("ord", "c1", "c2", "gram", "hot", "at", "body").mapInArrow(
        thin, "key bigint, ord bigint, top bigint, body binary, c1 bigint, c2 bigint")
    return thinned.repartition(n, "key").sortWithinPartitions("key").mapInArrow(
        run, "c1 bigint, c2 bigint, least bigint, spans array<struct<start: bigint, end: bigint>>")


def covered(starts: np.ndarray, total: int, number: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int, int]]:
    """Overlapping stretches (number, first, last) of concatenated strings united; ``starts`` are the strings' places."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts[number] + first, 1)
    np.add.at(change, starts[number] + last, -1)
    inside = np.cumsum(change) > 0
    # strings touch: a stretch at the end of one is not joined to one at the beginning of the next
    edges = np.r_[inside[0], inside[1:] != inside[:-1]]
    cuts = np.zeros(total + 1, bool)
    cuts[starts] = True
    begin = np.nonzero(inside & (edges | cuts))[0]
    finish = np.nonzero(inside[:-1] & (~inside[1:] | cuts[1:]))[0] + 1
    owner = np.searchsorted(starts, begin, side="right") - 1
    return list(zip(owner.tolist(), (begin - starts[owner]).tolist(), (finish - starts[owner]).tolist(), strict=True))


def repeats(docs: DataFrame, shape: Shape, solve: Solver, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, whole, spans) for every row of ``docs``: ``whole`` marks later copies of a text, ``spans`` the unit
    intervals (start, end; unsorted, may overlap) that repeat a document with a smaller id. Null text comes back empty."""
    rows = keyed(docs, id_col, text)
    firsts = rows.groupBy("k1", "k2").agg(F.min("ord").alias("ord"))
    shared = materialize(shared_anchors(rows, shape), "anchors")
    places = materialize(surroundings(rows, firsts, shared, shape), "surroundings")
    discard(shared)
    places, tables = dealt(places, shape)
    told = materialize(answers(places, shape, solve), "answers")
    width = shape.units("").itemsize
    all_of = F.struct(F.col("start").alias("start"), (F.col("start") + F.col("size")).alias("end"))
    parts = F.transform("spans", lambda x: F.struct((F.col("start") + x["start"]).alias("start"), (F.col("start") + x["end"]).alias("end")))
    # contents may come from the groups of several grams; an answer for a later document says nothing about an earlier one
    met = places.select("k1", "k2", "ord", "start", "c1", "c2", (F.octet_length("body") / width).cast("long").alias("size")).join(told, ["c1", "c2"])
    spans = met.select("k1", "k2", "ord", F.when(F.col("ord") > F.col("least"), F.array(all_of)).when(F.col("ord") == F.col("least"), parts).alias("spans")).where(F.size("spans") > 0)
    del met
    gathered = spans.groupBy("k1", "k2", "ord").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    del spans
    spans = materialize(gathered, "spans")
    del gathered
    discard(*tables, told)
    release_shuffles(docs.sparkSession)
    decided = firsts.join(spans, ["k1", "k2", "ord"], "left").withColumn("own", F.lit(True))
    return rows.join(decided, ["k1", "k2", "ord"], "left").select(
        F.col("id").alias(id_col), "text", F.col("own").isNull().alias("whole"), "spans")
