import json

import pytest
from pyspark.sql import functions as F

from tracegauge.operators import retrieval as RT
from tracegauge.operators import synth as SY
from tracegauge.plans import views as V
from tracegauge.sources import files as FS
from tracegauge.sources import metrics as M
from tracegauge.sources import traces as T
from tracegauge.streaming import jobs as SJ
from tracegauge.streaming import live as SL
from tracegauge.streaming.run import run_available, use_rocksdb


def test_read_traces_from_a_file(spark, tmp_path):
    lines = [
        json.dumps({"ts": 1.5, "messages": [{"role": "system", "content": "S"}, {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}], "prompt_tokens": 0, "usage": {"prompt_tokens": 7}, "model": "m"}),
        json.dumps({"request": {"messages": [{"role": "user", "content": "q"}], "model": "n", "stream": True}, "response": {"usage": {"completion_tokens": 3}, "choices": [{"message": {"tool_calls": [{"id": "x"}, {"id": "y"}]}}, {"message": {}}]}}),
        '{"messages": [', "", '{"messages": []}', '{"other": 1}', '{"messages": [{"role": "user", "content": "x"}]} trailing',
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    a, b = T.read_traces(spark, str(tmp_path / "log.jsonl")).orderBy(F.col("ts").desc_nulls_last()).collect()
    assert (a.prompt, a.prompt_tokens, a.model, a.tool_calls, a.stream) == ("system\nS\nuser\nab\n", 7, "m", 0, None)
    assert (b.prompt, b.completion_tokens, b.model, b.tool_calls, b.stream) == ("user\nq\n", 3, "n", 2, True)


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_run_files_round_trip_and_prune(spark, sf, tmp_path, fmt):
    cols = "idx, level, repeat, ok, error, send_ts, ttft_ms, e2e_ms, chunk_gaps_ms, n_chunks, input_tokens, output_tokens, run_id".split(", ")
    r = V.requests(spark, sf).select(*cols)
    T.write_run(r, str(tmp_path / "runs"), fmt)
    back = T.read_requests(spark, str(tmp_path / "runs")) if fmt == "json" else spark.read.parquet(str(tmp_path / "runs"))
    assert back.count() == r.count() and {x[0] for x in back.select("run_id").distinct().collect()} == {x[0] for x in r.select("run_id").distinct().collect()}
    plan = back.where("run_id = 'r3'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_telemetry_lines_keep_absent_keys_absent(spark):
    df = spark.createDataFrame([('{"t": 1.0, "running": 2, "waiting": null}',), ('{"t": 2.0, "gpu_power_w": 3.5}',)], "value string")
    assert sorted(map(tuple, M.parse_telemetry(df).collect())) == [(1.0, "running", 2.0), (2.0, "gpu_power_w", 3.5)]


BODY = '# HELP x\nvllm:hits_total{a="1"} 3 1700\nvllm:hits_total{a="}"} 4\nh_bucket{le="1"} 9\nh_created 1\nbad x\nn NaN\nplain 2.5\nempty'


def test_metrics_text(spark):
    df = spark.createDataFrame([("s", BODY)], "snapshot_id string, body string")
    assert {r.metric: r.value for r in M.parse_metrics_text(df).collect()} == {"vllm:hits_total": 7.0, "plain": 2.5}
    st = lambda n, b=BODY: M.strict_counter(spark.createDataFrame([("s", b)], "snapshot_id string, body string"), n).first()
    assert st("vllm:hits_total").value == 7.0 and st("vllm:hits").reject == "missing"
    assert st("c", "c -1").reject == st("c", "c NaN").reject == st("c", "c 1\nc inf").reject == "invalid"


def test_chunks_to_requests(spark):
    d = lambda **k: json.dumps({"choices": [{"delta": k}]})
    rows = [
        ("a", 1.0, d(role="assistant", content="")), ("a", 1.5, d(content="x")), ("a", 1.7, d(reasoning_content="r")), ("a", 2.0, d(tool_calls=[{"id": 1}])),
        ("a", 2.1, json.dumps({"choices": [{"delta": {}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 5, "completion_tokens": 9}})),
        ("b", 1.0, d(content="x")), ("b", 1.2, json.dumps({"error": {"message": "boom"}})), ("b", 1.4, d(content="late")),
        ("c", 1.0, d(role="assistant")), ("d", 1.0, json.dumps({"choices": [{"text": "legacy"}]})),
    ]
    c = spark.createDataFrame(rows, "request_id string, ts double, payload string").withColumn("send_ts", F.lit(0.5))
    r = {x.request_id: x for x in M.to_request_record(M.chunks_to_requests(c)).collect()}
    a = r["a"]
    assert (a.ok, a.ttft_ms, a.first_byte_ms, a.n_chunks, a.chunk_gaps_ms) == (True, 1000.0, 500.0, 3, [200.0, 300.0])
    assert (a.input_tokens, a.output_tokens, a.token_count_source, a.finish_reason, a.tpot_ms) == (5, 9, "server_usage", "stop", pytest.approx(75.0))
    assert (r["b"].ok, r["b"].error, r["b"].n_chunks, r["b"].e2e_ms) == (False, "http_5xx", 1, pytest.approx(700.0))
    assert r["c"].error == "empty_output" and (r["d"].output_tokens, r["d"].token_count_source, r["d"].tpot_ms) == (1, "chunk_count", None)


def test_flatten_json(spark):
    doc = json.dumps({"a": {"b": 1, "c": {"d": None, "e": "x"}}, "l": [1], "t": True, "empty": {}})
    got = {r.keypath: r.value for r in T.flatten_json(spark.createDataFrame([(1, doc)], "id int, doc string"), "doc").collect()}
    assert got == {"a.b": "1", "a.c.d": None, "a.c.e": "x", "t": "true"}


def test_file_inventory(spark, tmp_path):
    for rel, data in {"a/x.py": b"print()", "a/node_modules/y.js": b"1", "b.bin": b"ab\0c", "Dockerfile": b"FROM x", "p/z.md": "é".encode()}.items():
        f = tmp_path / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    got = {r.path: (r.lang, r.bytes, r.binary, r.parseable) for r in FS.file_inventory(spark, str(tmp_path)).collect()}
    assert got == {"a/x.py": ("python", 7, False, True), "b.bin": ("other", 4, True, False), "Dockerfile": ("dockerfile", 6, False, True), "p/z.md": ("markdown", 2, False, True)}


def test_sections_and_bm25(spark):
    docs = spark.createDataFrame([(1, "intro\n## Plans\nThe workshop plan costs 79\n## Pairing\nHold the pair button"), (2, "no sections here")], "doc_id int, text string")
    s = RT.sections(docs)
    assert [(r.section, r.heading, r.body) for r in s.collect()] == [(0, "Plans", "The workshop plan costs 79"), (1, "Pairing", "Hold the pair button")]
    ch = s.select(F.col("section").alias("chunk_id"), F.concat_ws(" ", "heading", "body").alias("text")).unionByName(spark.createDataFrame([(7, "unrelated words"), (8, "!!!")], "chunk_id int, text string"))
    top = RT.bm25(ch, spark.createDataFrame([(1, "pair button")], "query_id int, text string"), 1).first()
    assert top.chunk_id == 1 and top["rank"] == 1


def test_synthesis(spark):
    rows = spark.range(4000)
    a = SY.sample_lengths(rows, "id", spark.createDataFrame([(100.0, 3), (10.0, 1)], "upper double, count long"), 1.0)
    share = a.where("length <= 10").count() / 4000
    assert 0.2 < share < 0.3 and a.agg(F.max("length")).first()[0] <= 100
    b = SY.log_normal_lengths(rows, "id", 40.0, 160.0)
    p = b.agg(F.percentile("length", F.array(F.lit(0.5), F.lit(0.95)))).first()[0]
    assert p[0] == pytest.approx(40, rel=0.1) and p[1] == pytest.approx(160, rel=0.15)
    g = SY.generate_requests(b, "id", [("x", 0.5, 8)], ["u", "v", "w"])
    assert g.where("prefix_group = 'x'").count() / 4000 == pytest.approx(0.5, abs=0.04)
    heads = g.where("prefix_group = 'x' AND length > 8").select(F.expr("substring_index(prompt, ' ', 8)").alias("h")).distinct().count()
    assert heads == 1 and g.where("size(split(prompt, ' ')) <> length").count() == 0
    assert sorted(map(tuple, g.collect())) == sorted(map(tuple, SY.generate_requests(b.repartition(9), "id", [("x", 0.5, 8)], ["u", "v", "w"]).collect()))


def stream_of(spark, df, folder, parts):
    """Write a table as several files and read it one file per micro-batch, oldest first."""
    for i, part in enumerate(parts):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/f{i}")
    import os
    import time

    flat = f"{folder}/flat"
    os.makedirs(flat)
    for i in range(len(parts)):
        for f in sorted(os.listdir(f"{folder}/f{i}")):
            if f.endswith(".parquet"):
                data = open(f"{folder}/f{i}/{f}", "rb").read()
                open(f"{flat}/{i}-{f}", "wb").write(data)
                os.utime(f"{flat}/{i}-{f}", (time.time() - 1000 + i * 10,) * 2)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(flat)


def shuffled(df, late=3600):
    """File numbers that bring rows up to ``late`` seconds after newer ones, and mix every file."""
    span = df.agg(F.max("t")).first()[0] / 5
    jitter = F.pmod(F.xxhash64("seq"), F.lit(1000)) / 1000.0 * min(late, span) * 0.9
    return df.withColumn("_f", F.floor((F.col("t") + jitter) / span).cast("int")), [f"_f = {i}" for i in range(7)], df.agg(F.max("t")).first()[0] - late


def test_live_rates_of_unordered_micro_batches_equal_batch(spark, sf, tmp_path):
    from tracegauge.operators.telemetry import live_rates

    use_rocksdb(spark)
    w = V.telemetry_wide(spark, sf)
    held, parts, upto = shuffled(w, 86400)
    s = stream_of(spark, held, str(tmp_path), parts)
    got = run_available(SL.live_rates(s, "1 day")).select("run_id", "seq", F.round("prefix_hit_rate", 9).alias("a"), F.round("gen_tok_s", 9).alias("b"))
    want = live_rates(w, ["run_id"]).where(F.col("t") < upto).select("run_id", "seq", F.round("prefix_hit_rate", 9).alias("a"), F.round("gen_tok_s", 9).alias("b"))
    nan = lambda rows: sorted(tuple(None if x != x else x for x in r) for r in map(tuple, rows))
    key = lambda rows: sorted(nan(rows), key=str)
    assert key(got.collect()) == key(want.collect()) and got.count() > 100


def test_one_active_job_of_unordered_micro_batches(spark, sf, tmp_path):
    from tracegauge.operators.jobs import one_active_job
    from tracegauge.plans.misc import _triggers

    use_rocksdb(spark)
    t = _triggers(spark, sf)
    held, parts, upto = shuffled(t, 86400)
    got = run_available(SJ.one_active_job(stream_of(spark, held, str(tmp_path), parts), "1 day")).select("key", "seq", "outcome")
    want = one_active_job(t).join(t.where(F.col("t") < upto).select("key", "seq"), ["key", "seq"]).select("key", "seq", "outcome")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100


def test_rate_limit_of_unordered_micro_batches_replays(spark, sf, tmp_path):
    use_rocksdb(spark)
    e = V.table(spark, sf, "events").select((F.col("user_id") % 5).alias("key"), F.col("event_id").alias("seq"), V.clock(F.col("ts")).alias("t"))
    held, parts, upto = shuffled(e, 86400)
    got = {r.seq: r.accepted for r in run_available(SJ.rate_limit(stream_of(spark, held, str(tmp_path), parts), 3, 20000.0, "1 day")).collect()}
    hits, want = {}, {}
    for r in sorted(e.collect(), key=lambda r: (r.t, r.seq)):
        live = [x for x in hits.get(r.key, []) if r.t - x <= 20000.0]
        if r.t < upto:
            want[r.seq] = len(live) < 3
        hits[r.key] = live + [r.t] * (len(live) < 3)
    assert got == want and len(set(got.values())) == 2


def test_an_idle_key_forgets(spark, tmp_path):
    """What is carried ends with the idle time; rows of a burst come out in pieces."""
    use_rocksdb(spark)
    rows = [("a", i, float(t), "start") for i, t in enumerate([10, 20, 30, 5000, 5001])] + [("b", 9, 40.0, "start"), ("c", 10, 90_000.0, "start")]
    df = spark.createDataFrame([(ord(k), i, t, x) for k, i, t, x in rows], "key long, seq long, t double, kind string")
    s = stream_of(spark, df, str(tmp_path), ["t < 25", "t >= 25 AND t < 6000", "t >= 6000"])
    got = {r.seq: r.outcome for r in run_available(SJ.one_active_job(s, "1 minute", 1_000_000)).collect()}
    assert got == {0: "created", 1: "attached", 2: "attached", 3: "created", 4: "attached", 9: "created"}


def test_secret_spans_in_sql(spark):
    from tracegauge.functions.tables import register

    register(spark)
    spark.createDataFrame([(1, "key AKIA" + "A1" * 8), (2, "nothing"), (3, None)], "id int, text string").createOrReplaceTempView("secret_docs_view")
    rows = spark.sql("SELECT d.id, s.* FROM secret_docs_view d, LATERAL secret_spans(d.text) s").collect()
    assert [tuple(r) for r in rows] == [(1, "aws_access_key_id", 4, 24, 1)]


def test_recent_history_is_bounded_and_newest(spark, sf, tmp_path):
    use_rocksdb(spark)
    w = V.telemetry_wide(spark, sf).withColumn("run_id", F.lit("one"))
    s = stream_of(spark, w, str(tmp_path), ["seq < 500", "seq >= 500"])
    h = run_available(SL.recent_history(s), "update")
    last = h.where(F.col("batch") == h.agg(F.max("batch")).first()[0])
    want = [r.seq for r in w.orderBy(F.col("t").desc()).limit(90).collect()]
    assert sorted(r.seq for r in last.collect()) == sorted(want)


class _Held:
    """A list state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def appendList(self, rows):
        self.put([*self.rows, *rows])

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class _Handle:
    def __init__(self):
        self.lists, self.timers = {}, []

    def getListState(self, name, schema):
        return self.lists.setdefault(name, _Held())

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_many_keys_cost_few_state_calls(spark):
    """Keys of a group share their state: calls do not grow with keys or rows; nulls stay nulls, long numbers whole."""
    from types import SimpleNamespace

    import pandas as pd

    from tracegauge.streaming.jobs import _OneActive

    p, h = _OneActive(None), _Handle()
    p.init(h)
    big = (1 << 62) + 1
    rows = [(0, k, 1000 * t, float(t), big + t, "start") for k in range(500) for t in (3, 1, 2)] + [(1, 0, 1000, 1.0, 7, "start")]
    part = pd.DataFrame(rows, columns=["nulls_", "key", "at_ms", "t", "seq", "kind"])
    list(p.handleInputRows((0,), iter([part]), None))
    out = pd.concat(p.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 2500), SimpleNamespace(getExpiryTimeInMs=lambda: 1000)))
    got = {(None if r.key != r.key else int(r.key), r.outcome): r for r in out.itertuples()}
    assert len(out) == 1001 and len(got) == 1001 and got[None, "created"].seq == 7
    assert out[out.key == 499].seq.tolist() == [big + 1, big + 2]
    assert h.timers == [1000, 3000] and sum(x.calls for x in h.lists.values()) <= 6
