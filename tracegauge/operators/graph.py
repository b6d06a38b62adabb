"""Edge-table traversals, many graphs (scans) at once.

Each round joins the frontier with the edges, keeps one row per new node (combined before the
shuffle) and writes it, so lineage stays short and a lost executor costs one round. The edges are
written once. A frontier row has a constant width: a path is kept as a pointer to the node before, and
whole paths are put together at the end by pointer doubling. The driver only asks whether the frontier is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegauge.session import written

MAX_ROUNDS = 1000


def traverse(
    edges: DataFrame, starts: DataFrame, keys: Sequence[str] = ("scan",), *, source: str | None = None,
    with_path: bool = False,
) -> DataFrame:
    """Breadth-first reach: keys, [source], node, hop and optionally the first path.

    ``edges``: keys, src_key, dst_key. ``starts``: keys, [source], node. The path kept for a node is
    the lexicographically smallest of the shortest ones: paths of one length compare as the ranks of the
    nodes before do, so a frontier carries its rank, which is its place in a range-partitioned sort.
    """
    # Written once, every round reads it. Spread by whole edges, not by node: a hub's edges then lie in
    # many partitions, where a small (broadcast) frontier meets them in parallel; for a large frontier
    # AQE splits the hub in the shuffled join.
    # Repeated edges stay: every round combines what it reaches before the shuffle.
    return _walk(written(edges.select(*keys, F.col("src_key").alias("node"), F.col("dst_key").alias("_to")), "edges"), starts, keys, source, with_path)


def _walk(e: DataFrame, starts: DataFrame, keys: Sequence[str], source: str | None = None, with_path: bool = False) -> DataFrame:
    """``traverse`` over edges (keys, node, _to) that are written already."""
    ids = [*keys, *([source] if source else []), "node"]
    frontier = starts.select(*ids).distinct()

    def kept(rows: DataFrame, hop: int, by: Sequence[str]) -> DataFrame:
        if with_path:
            order = [*ids[:-1], *by]
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_rank", F.monotonically_increasing_id())
        return written(rows.withColumn("hop", F.lit(hop)), f"hop{hop}")

    if with_path:
        frontier = frontier.withColumn("_from", F.lit(None).cast(frontier.schema["node"].dataType))
    seen = frontier = kept(frontier, 0, ["node"])
    for hop in range(1, MAX_ROUNDS + 1):
        if with_path:
            step = frontier.select(*ids[:-1], F.struct(F.col("_rank"), F.col("node")).alias("_b"), "node").join(e, [*keys, "node"])
            step = step.groupBy(*ids[:-1], F.col("_to").alias("node")).agg(F.min("_b").alias("_b"))
            step = step.select(*ids, F.col("_b._rank").alias("_before"), F.col("_b.node").alias("_from"))
        else:
            step = frontier.select(*ids).join(e, [*keys, "node"]).drop("node").withColumnRenamed("_to", "node").select(*ids).distinct()
        fresh = step.join(seen.select(*ids), ids, "left_anti")
        frontier = kept(fresh, hop, ["_before", "node"]).drop("_before")
        if frontier.isEmpty():
            return paths(seen, ids, hop - 1) if with_path else seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")


def paths(seen: DataFrame, ids: Sequence[str], longest: int) -> DataFrame:
    """The whole path of every node from the pointers ``_from``: each round doubles the piece a node holds of its own.

    A piece ends at the node and begins behind ``_up``; the piece of ``_up`` goes in front of it. Rounds are the
    logarithm of the longest path; only whole pieces are read, and nodes that have reached their start rest.
    """
    up = ids[:-1]
    held = written(seen.select(*ids, "hop", F.col("_from").alias("_up"), F.array("node").alias("path")), "pieces")
    reach = 1
    while reach <= longest:
        # a piece that is complete already is as long as its node's distance
        front = held.select(*[F.col(c).alias(f"_f_{c}") for c in up], F.col("node").alias("_at"), F.col("_up").alias("_next"), F.col("path").alias("_front"))
        same = [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in up] + [F.col("_up") == F.col("_at")]
        longer = held.join(front, same, "left").select(
            *ids, "hop", F.when(F.col("_up").isNotNull(), F.col("_next")).alias("_up"),
            F.when(F.col("_up").isNotNull(), F.concat("_front", "path")).otherwise(F.col("path")).alias("path"))
        held = written(longer, "pieces")
        reach *= 2
    return held.select(*ids, "hop", "path")


def upward_edges(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ("scan",)) -> DataFrame:
    """Edges to walk from a changed node to whatever it affects.

    ``implements`` is followed forward; every other edge backward, but never out of a capability or
    workflow (a change to one member does not affect its siblings).
    """
    forward = edges.where("kind = 'implements'").select(*keys, "src_key", "dst_key")
    backward = edges.where("kind <> 'implements'").select(
        *keys, F.col("dst_key").alias("src_key"), F.col("src_key").alias("dst_key")
    )
    stop = nodes.where(F.col("kind").isin("capability", "workflow")).select(*keys, F.col("key").alias("src_key"))
    return forward.unionByName(backward.join(stop, [*keys, "src_key"], "left_anti"))


def affected(nodes: DataFrame, edges: DataFrame, touched: DataFrame, keys: Sequence[str] = ("scan",)) -> DataFrame:
    """Touched nodes and their affected ancestors with the path that justifies each."""
    return traverse(upward_edges(nodes, edges, keys), touched.select(*keys, F.col("key").alias("node")), keys, with_path=True)


def hop_distance(nodes: DataFrame, edges: DataFrame, start: DataFrame, keys: Sequence[str] = ("scan",)) -> DataFrame:
    """Signed layered distance: walk right to higher layers, left to lower ones.

    Inside one layer a step follows the edge's own direction (callers left, callees right).
    """
    layer = nodes.select(*keys, "key", "layer")
    l = edges.join(layer.withColumnsRenamed({"key": "src_key", "layer": "_ls"}), [*keys, "src_key"]).join(
        layer.withColumnsRenamed({"key": "dst_key", "layer": "_ld"}), [*keys, "dst_key"]
    )
    # one table, read along and against its direction
    up = F.col("_ld") >= F.col("_ls")
    right = written(l.where(up.isNotNull()).select(
        *keys, F.when(up, F.col("src_key")).otherwise(F.col("dst_key")).alias("node"), F.when(up, F.col("dst_key")).otherwise(F.col("src_key")).alias("_to")), "edges")
    left = right.select(*keys, F.col("_to").alias("node"), F.col("node").alias("_to"))
    s = start.select(*keys, F.col("key").alias("node"))
    r = _walk(right, s, keys).withColumn("direction", F.lit("right"))
    return r.unionByName(_walk(left, s, keys).where("hop > 0").withColumn("direction", F.lit("left")))


def merge_nodes(writes: DataFrame, keys: Sequence[str] = ("scan",)) -> DataFrame:
    """First writer fixes kind, label and confidence; for each attribute the last writer wins.

    ``writes``: keys, key, seq, kind, label, confidence, attrs (map).
    """
    head = writes.groupBy(*keys, "key").agg(F.min_by(F.struct("kind", "label", "confidence"), "seq").alias("f"))
    attrs = (
        writes.select(*keys, "key", "seq", F.explode("attrs").alias("a", "v"))
        .groupBy(*keys, "key", "a").agg(F.max_by("v", "seq").alias("v"))
        .groupBy(*keys, "key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("a", "v")))).alias("attrs"))
    )
    return head.join(attrs, [*keys, "key"], "left").select(*keys, "key", "f.*", "attrs")


def insert_edges(writes: DataFrame, nodes: DataFrame, keys: Sequence[str] = ("scan",)) -> DataFrame:
    """Unique (kind, src, dst) by first writer; edges without both end nodes are dropped."""
    e = writes.groupBy(*keys, "kind", "src_key", "dst_key").agg(F.min_by("confidence", "seq").alias("confidence"))
    have = nodes.select(*keys, "key").distinct()
    return e.join(have.withColumnRenamed("key", "src_key"), [*keys, "src_key"], "left_semi").join(
        have.withColumnRenamed("key", "dst_key"), [*keys, "dst_key"], "left_semi"
    )


def merged_graph(base_nodes: DataFrame, head_nodes: DataFrame, base_edges: DataFrame, head_edges: DataFrame,
                 keys: Sequence[str] = ("scan",)) -> tuple[DataFrame, DataFrame]:
    """Head nodes plus the nodes only the base has; edges of both."""
    gone = base_nodes.join(head_nodes.select(*keys, "key"), [*keys, "key"], "left_anti")
    return head_nodes.unionByName(gone, allowMissingColumns=True), head_edges.unionByName(base_edges).distinct()


def induced_subgraph(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("scan",)) -> tuple[DataFrame, DataFrame]:
    """Nodes with the wanted keys and the edges between them."""
    w = wanted.select(*keys, "key").distinct()
    n = nodes.join(w, [*keys, "key"], "left_semi")
    have = n.select(*keys, "key")
    e = edges.join(have.withColumnRenamed("key", "src_key"), [*keys, "src_key"], "left_semi").join(
        have.withColumnRenamed("key", "dst_key"), [*keys, "dst_key"], "left_semi"
    )
    return n, e
