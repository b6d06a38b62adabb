"""Claim and join queries over part, lineitem, documents and the derived scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegauge.operators import claims as C
from tracegauge.operators import joins as J
from tracegauge.plans import scan_views  # noqa: F401  registers the shared views
from tracegauge.plans import views as V
from tracegauge.plans.registry import query, shared_view, view

shared_view(
    "claim_candidates",
    """SELECT p_brand AS subject, 'type' AS predicate, CASE WHEN p_partkey % 2 = 0 THEN ' ' || lower(p_type) ELSE p_type END AS value,
      CASE WHEN p_size < 10 THEN 'ast' WHEN p_size < 20 THEN 'config' WHEN p_size < 30 THEN 'readme' WHEN p_size < 40 THEN 'dependency' ELSE 'llm' END AS source,
      p_partkey AS fact_id, p_size % 2 = 0 AS direct FROM {part}""",
)
PRIOR_SQL = "CASE source WHEN 'ast' THEN 0.95 WHEN 'ast_heuristic' THEN 0.7 WHEN 'config' THEN 0.9 WHEN 'dependency' THEN 0.6 WHEN 'readme' THEN 0.5 WHEN 'absence' THEN 0.6 ELSE 0.4 END::DOUBLE"


def claims_ctes(source: str, keys: str, name: str = "claims", n: str = "1") -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""{name}_p AS (SELECT {keys}, lower(trim(value)) AS normalized, sum(ln(1 - {PRIOR_SQL}) * {n}) AS ls, sum({n})::BIGINT AS n_support,
      arg_max(value, {PRIOR_SQL} * 1e9 - fact_id) AS value, list_sort(list_distinct(list(source))) AS sources,
      bool_or(direct AND source IN ('ast', 'config', 'trace')) AS d, count(DISTINCT CASE source WHEN 'llm' THEN 'llm' ELSE 'deterministic' END) AS nm, max(CASE source WHEN 'llm' THEN 'llm' ELSE 'deterministic' END) AS mm
      FROM {source} GROUP BY {keys}, lower(trim(value))),
    {name} AS (SELECT a.*, b.n AS n_values, round(round((1 - exp(ls)) * (1 - 0.5 * CASE WHEN b.n > 1 THEN 1 - exp(b.total - ls) ELSE 0 END), 9), 3) AS confidence,
      CASE WHEN nm = 1 THEN mm ELSE 'reconciled' END AS method, CASE WHEN d THEN 'direct_observation' ELSE 'inference' END AS observation,
      CASE WHEN b.n > 1 THEN 'contested' ELSE 'supported' END AS status
      FROM {name}_p a JOIN (SELECT {keys}, sum(ls) AS total, count(*) AS n FROM {name}_p GROUP BY {keys}) b ON {on})"""


CLAIMS = "WITH " + claims_ctes("claim_candidates", "subject, predicate")


def _claims(spark, d):
    return C.reconcile(view(spark, d, "claim_candidates"))


@query(
    "A33_noisy_or", "claim_candidates",
    sql=f"SELECT subject, lower(trim(value)) AS normalized, round(1 - exp(sum(ln(1 - {PRIOR_SQL}))), 9) AS support FROM claim_candidates GROUP BY ALL",
)
def a33(spark, d):
    c = view(spark, d, "claim_candidates").withColumn("p", C._lookup(C.PRIORS, F.col("source")))
    return c.groupBy("subject", F.lower(F.trim("value")).alias("normalized")).agg(F.round(C.noisy_or(F.col("p")), 9).alias("support"))


@query(
    "A34_claim_reconcile", "claim_candidates",
    sql=CLAIMS + """SELECT subject, normalized, value, confidence, method, observation, status, array_to_string(sources, ',') AS sources, n_support,
      CASE WHEN n_values > 1 THEN substr(sha256(subject || '|' || predicate), 1, 12) END AS conflict_group FROM claims""",
)
def a34(spark, d):
    c = _claims(spark, d)
    return c.select("subject", "normalized", "value", "confidence", "method", "observation", "status", F.array_join("sources", ",").alias("sources"), "n_support", "conflict_group")


@query(
    "S13_claim_evidence", "claim_candidates",
    sql=CLAIMS + """SELECT c.subject, c.normalized, f.fact_id, CASE WHEN bool_or(f.nv = c.normalized) THEN 'supports' ELSE 'contradicts' END AS stance FROM claims c
      JOIN (SELECT DISTINCT subject, predicate, lower(trim(value)) AS nv, fact_id FROM claim_candidates) f ON f.subject = c.subject AND f.predicate = c.predicate GROUP BY ALL""",
)
def s13(spark, d):
    e = C.evidence(C.members(view(spark, d, "claim_candidates")), _claims(spark, d))
    return e.select("subject", "normalized", "fact_id", "stance")


@query("S13_evidence_members", "claim_candidates", sql="SELECT DISTINCT subject, lower(trim(value)) AS normalized, fact_id FROM claim_candidates")
def s13m(spark, d):
    """What is stored: one row per fact and value."""
    return C.members(view(spark, d, "claim_candidates")).select("subject", "normalized", "fact_id")


@query(
    "S13_evidence_counts", "claim_candidates",
    sql="""WITH m AS (SELECT DISTINCT subject, predicate, lower(trim(value)) AS normalized, fact_id FROM claim_candidates)
      SELECT subject, normalized, count(*) AS n_supports, (SELECT count(DISTINCT fact_id) FROM m o WHERE o.subject = m.subject AND o.predicate = m.predicate) - count(*) AS n_contradicts FROM m GROUP BY subject, predicate, normalized""",
)
def s13c(spark, d):
    return C.evidence_counts(C.members(view(spark, d, "claim_candidates"))).select("subject", "normalized", "n_supports", "n_contradicts")


@query(
    "U5_reconcile_callback", "claim_candidates",
    sql="""WITH c AS (SELECT *, upper(regexp_replace(trim(value), '[^A-Za-z]', '', 'g')) AS nv, """ + PRIOR_SQL + """ AS prior FROM claim_candidates),
      p AS (SELECT subject, predicate, nv, sum(ln(1 - prior)) AS ls, count(*) AS n_support FROM c GROUP BY ALL),
      t AS (SELECT subject, predicate, sum(ls) AS total, count(*) AS n FROM p GROUP BY ALL)
      SELECT subject, nv AS normalized, n_support, CASE WHEN n > 1 THEN 'contested' ELSE 'supported' END AS status,
        round(round((1 - exp(ls)) * (1 - 0.5 * CASE WHEN n > 1 THEN 1 - exp(total - ls) ELSE 0 END), 9), 3) AS confidence FROM p JOIN t USING (subject, predicate)""",
)
def u5(spark, d):
    """Reconciled under a caller's own normalizer: letters only, upper case."""
    own = lambda v: F.upper(F.regexp_replace(F.trim(v), "[^A-Za-z]", ""))
    c = C.reconcile(view(spark, d, "claim_candidates"), normalize=own)
    return c.select("subject", "normalized", "n_support", "status", "confidence")


@query(
    "A35_contradictions", "claim_candidates",
    sql=CLAIMS + """SELECT subject, n_values, value, confidence, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, normalized) = 1 AS strongest FROM claims WHERE n_values > 1""",
)
def a35(spark, d):
    return C.contradictions(_claims(spark, d)).select("subject", "n_values", "value", "confidence", "strongest")


@query(
    "G10_primary_claim", "claim_candidates",
    sql=CLAIMS + """SELECT subject, value, confidence, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, normalized) AS place FROM claims""",
)
def g10(spark, d):
    """The primary claim (place 1) and its alternatives, a row each."""
    return C.primary(_claims(spark, d)).select("subject", "value", "confidence", "place")


# ---------------------------------------------------------------- diffs

shared_view("head_files", """SELECT scan, path, id, CASE WHEN lang = 'de' THEN text || ' changed\nnew line' ELSE text END AS text FROM {files} WHERE lang <> 'es' OR source <> 'src1'
    UNION ALL SELECT scan, path || '.new', id, text FROM {files} WHERE source = 'src2'""", "files")


def _trees(spark, d):
    one = lambda n: view(spark, d, n).withColumn("sha", F.md5("text"))
    return one("files"), one("head_files")


@query(
    "J5_tree_diff", "files", "head_files",
    sql="""SELECT coalesce(b.id, h.id) AS id, coalesce(b.path, h.path) AS path, CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' ELSE 'modified' END AS status
      FROM files b FULL JOIN head_files h ON b.id = h.id AND b.path = h.path WHERE md5(b.text) IS DISTINCT FROM md5(h.text)""",
)
def j5(spark, d):
    b, h = _trees(spark, d)
    return J.tree_diff(b, h, ["id", "path"], "sha").select("id", "path", "status")


@query(
    "J5_line_changes", "files", "head_files",
    sql="""WITH b AS (SELECT id, path, l, count(*) AS n FROM (SELECT id, path, unnest(string_split(text, chr(10))) AS l FROM files) GROUP BY ALL),
    h AS (SELECT id, path, l, count(*) AS n FROM (SELECT id, path, unnest(string_split(text, chr(10))) AS l FROM head_files) GROUP BY ALL)
    SELECT id, path, sum(greatest(coalesce(h.n, 0) - coalesce(b.n, 0), 0))::BIGINT AS added, sum(greatest(coalesce(b.n, 0) - coalesce(h.n, 0), 0))::BIGINT AS removed
    FROM b FULL JOIN h USING (id, path, l) GROUP BY id, path HAVING sum(abs(coalesce(h.n, 0) - coalesce(b.n, 0))) > 0""",
)
def j5l(spark, d):
    b, h = _trees(spark, d)
    return J.line_changes(b, h, ["id", "path"], "text").select("id", "path", "added", "removed")


@query(
    "J6_attribute_diff",
    sql="""WITH b AS (SELECT c_custkey AS key, c_mktsegment AS seg, round(c_acctbal, 0)::BIGINT::VARCHAR AS bal FROM customer WHERE c_nationkey <> 3),
    h AS (SELECT c_custkey AS key, CASE WHEN c_nationkey = 5 THEN 'RETAIL' ELSE c_mktsegment END AS seg, CASE WHEN c_nationkey = 7 THEN NULL ELSE round(c_acctbal, 0)::BIGINT::VARCHAR END AS bal FROM customer WHERE c_nationkey <> 9)
    SELECT key, b.key IS NOT NULL AS in_base, h.key IS NOT NULL AS in_head,
      CASE WHEN b.key IS NOT NULL AND h.key IS NOT NULL THEN array_to_string(list_filter([CASE WHEN b.bal IS DISTINCT FROM h.bal THEN 'bal' END, CASE WHEN b.seg IS DISTINCT FROM h.seg THEN 'segment' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS changed
    FROM b FULL JOIN h USING (key) WHERE b.key IS NULL OR h.key IS NULL OR b.seg IS DISTINCT FROM h.seg OR b.bal IS DISTINCT FROM h.bal""",
)
def j6(spark, d):
    """Nodes from customers: the head recodes one nation's segment, loses another's balance, moves lines."""
    c = V.table(spark, d, "customer")
    bal = F.round("c_acctbal", 0).cast("long").cast("string")
    attrs = lambda seg, b, line: F.map_filter(F.create_map(F.lit("segment"), seg, F.lit("bal"), b, F.lit("line"), F.lit(line)), lambda k, v: v.isNotNull())
    base = c.where("c_nationkey <> 3").select(F.col("c_custkey").alias("key"), attrs(F.col("c_mktsegment"), bal, "1").alias("attrs"))
    head = c.where("c_nationkey <> 9").select(
        F.col("c_custkey").alias("key"),
        attrs(F.when(F.col("c_nationkey") == 5, "RETAIL").otherwise(F.col("c_mktsegment")), F.when(F.col("c_nationkey") != 7, bal), "2").alias("attrs"),
    )
    a = J.attribute_diff(base, head, ["key"])
    return a.select("key", "in_base", "in_head", F.array_join(F.array_sort(F.map_keys("changes")), ",").alias("changed"))


@query(
    "J4_overlap_join", "spans", "hunks",
    sql="""SELECT s.scan, s.key, s.kind, h.hunk_id FROM spans s JOIN hunks h ON s.scan = h.scan AND s.path = h.path
      AND CASE WHEN h.new_lines = 0 THEN s.line_start < h.new_start AND h.new_start <= s.line_end ELSE s.line_start <= h.new_start + h.new_lines - 1 AND h.new_start <= s.line_end END""",
)
def j4(spark, d):
    o = J.overlap_join(view(spark, d, "spans"), view(spark, d, "hunks"), ["scan", "path"], "new_start", "new_lines")
    return o.select("scan", "key", "kind", "hunk_id")


MATCH_SQL = """WITH t AS (SELECT l_partkey AS k, l_orderkey * 8 + l_linenumber AS id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 8 + l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'A'),
    p AS (SELECT l_partkey AS k, l_orderkey * 8 + l_linenumber AS id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 8 + l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R'),
    m AS (SELECT k, t.id AS truth_id, p.id AS pred_id, CASE WHEN p.id IS NULL THEN 'missed' WHEN t.id IS NULL THEN 'extra' ELSE 'matched' END AS outcome FROM t FULL JOIN p USING (k, n))"""


@query("J8_one_to_one_match", sql=MATCH_SQL + "SELECT k, truth_id, pred_id, outcome FROM m")
def j8(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_returnflag")
    return J.match_one_to_one(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), ["k"], "id")


@query(
    "J15_prompt_identity",
    sql="""WITH a AS (SELECT conv_id, turn, text AS base, CASE WHEN conv_id % 5 = 0 THEN text || ' ' ELSE text END AS head FROM conversations WHERE role = 'user')
      SELECT (conv_id % 5)::BIGINT AS app, count(*) AS n, round(avg((base = head)::INTEGER), 8) AS identical_share FROM a GROUP BY 1""",
)
def j15(spark, d):
    """Share of questions whose rendered prompt is identical on both sides."""
    c = V.table(spark, d, "conversations").where("role = 'user'")
    base = c.select("conv_id", "turn", F.col("text").alias("base"))
    head = c.select("conv_id", "turn", F.when(F.col("conv_id") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("head"))
    return base.join(head, ["conv_id", "turn"]).groupBy((F.col("conv_id") % 5).alias("app")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("base").eqNullSafe(F.col("head")).cast("double")), 8).alias("identical_share")
    )


@query(
    "J14_paired_workload",
    sql="""WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')
      SELECT (conv_id % 3)::BIGINT AS repeat, count(*) AS n, count(*) FILTER (conv_id % 5 <> 0) AS same_query, count(*) FILTER (conv_id % 7 <> 0) AS a_equals_b, count(*) FILTER (conv_id % 8 <> 0) AS prefix_placed,
        count(*) FILTER (conv_id % 11 <> 0 AND conv_id % 8 <> 0) AS metadata_paired FROM a GROUP BY 1""",
)
def j14(spark, d):
    """Four conditions of the same request: equal queries, A = B, metadata before (C) or after (D) the prefix."""
    c = V.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    meta = F.concat(F.lit("req "), F.col("conv_id").cast("string"))
    prefix = F.lit("Shared prefix.")
    rows = F.array(
        F.struct(F.lit("A").alias("cond"), prefix.alias("system")),
        F.struct(F.lit("B").alias("cond"), F.when(F.col("conv_id") % 7 == 0, F.lit("Shared prefix!")).otherwise(prefix).alias("system")),
        F.struct(F.lit("C").alias("cond"), F.concat(meta, F.lit("\n\n"), prefix).alias("system")),
        F.struct(F.lit("D").alias("cond"), F.when(F.col("conv_id") % 8 == 0, F.concat(meta, F.lit("\n\n"), prefix)).otherwise(
            F.concat(prefix, F.lit("\n\n"), F.when(F.col("conv_id") % 11 == 0, F.lit("req ?")).otherwise(meta))).alias("system")),
    )
    long = c.select("conv_id", "turn", "text", F.explode(rows).alias("r")).select("conv_id", "turn", "text", "r.*")
    # another question in one condition of some conversations
    long = long.withColumn("text", F.when((F.col("cond") == "C") & (F.col("conv_id") % 5 == 0), F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    at = lambda k: F.max(F.when(F.col("cond") == k, F.col("system")))
    w = long.groupBy("conv_id", "turn").agg(
        F.countDistinct("text").alias("q"), at("A").alias("a"), at("B").alias("b"), at("C").alias("c"), at("D").alias("d")
    )
    first = F.expr("substring(c, 1, length(c) - length(a) - 2)")
    last = F.expr("substring(d, length(a) + 3)")
    placed = F.expr("endswith(c, '\n\n' || a) AND startswith(d, a || '\n\n')")
    return w.groupBy((F.col("conv_id") % 3).alias("repeat")).agg(
        F.count("*").alias("n"), F.count_if(F.col("q") == 1).alias("same_query"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("a_equals_b"),
        F.count_if(placed).alias("prefix_placed"), F.count_if(placed & (first == last)).alias("metadata_paired"),
    )


# ---------------------------------------------------------------- latest, retained, superseded, labels

@query(
    "W9_latest_per_key",
    sql="SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def w9(spark, d):
    e = V.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return J.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    "W10_retained_history",
    sql="""WITH l AS (SELECT user_id % 25 AS project, (props::JSON ->> '$.k')::INTEGER AS run, max(event_id) AS last_event FROM events GROUP BY ALL)
      SELECT project, run, last_event FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY last_event DESC, run DESC) AS rn FROM l) WHERE rn <= 10""",
)
def w10(spark, d):
    e = V.table(spark, d, "events").select((F.col("user_id") % 25).alias("project"), F.get_json_object("props", "$.k").cast("int").alias("run"), F.col("event_id").alias("last_event"))
    return J.keep_recent(e, ["project"], "run", "last_event", 10).select("project", "run", "last_event")


@query(
    "J16_superseded",
    sql="""WITH h AS (SELECT user_id, arg_max(props, event_id) AS head FROM events WHERE event_type = 'purchase' GROUP BY user_id)
      SELECT e.event_id, e.props <> h.head AS superseded FROM events e JOIN h USING (user_id) WHERE e.event_type = 'click'""",
)
def j16(spark, d):
    """Jobs (clicks) whose head differs from the current head of their request (latest purchase)."""
    e = V.table(spark, d, "events")
    head = J.latest(e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("props").alias("head")), ["user_id"], ["event_id"]).select("user_id", "head")
    return e.where("event_type = 'click'").join(head, "user_id").select("event_id", (F.col("props") != F.col("head")).alias("superseded"))


@query(
    "S12_labels_last_wins",
    sql="""WITH l AS (SELECT user_id AS id, arg_max(event_type, event_id) AS label, count(*) AS n FROM events GROUP BY user_id)
      SELECT id, label, n, EXISTS (SELECT 1 FROM labels q WHERE q.doc_id = l.id) AS in_queue FROM l""",
)
def s12(spark, d):
    """Label rows: the newest of an id wins; ids that are not in the queue are told apart."""
    e = V.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", "event_id").alias("label"), F.count("*").alias("n"))
    q = V.table(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct().withColumn("_q", F.lit(True))
    return e.join(q, "id", "left").select("id", "label", "n", F.coalesce("_q", F.lit(False)).alias("in_queue"))


@query(
    "W15_fact_dedup",
    sql="""WITH u AS (SELECT l_partkey % 25 AS scan, l_suppkey AS key, l_linenumber AS line, min(l_orderkey) AS first_seq FROM lineitem GROUP BY ALL)
      SELECT scan, key, line, row_number() OVER (PARTITION BY scan ORDER BY first_seq, key, line) AS short_id FROM u""",
)
def w15(spark, d):
    """First fact of each (key, location) and a dense short id per scan, numbered inside order blocks."""
    from tracegauge.operators.ordered import order_bucket, position

    u = V.table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 25).alias("scan"), F.col("l_suppkey").alias("key"), F.col("l_linenumber").alias("line")).agg(F.min("l_orderkey").alias("first_seq"))
    p = position(u, ["scan"], [F.col("first_seq"), F.col("key"), F.col("line")], order_bucket(u, ["scan"], "first_seq"), "short_id")
    return p.select("scan", "key", "line", "short_id")
