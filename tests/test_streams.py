"""Streams with state, hot keys and scans over raw points."""

import hashlib
import os
import random

import pytest
from pyspark.sql import Window, functions as F

import __spark_entry__ as entry
from gradeloom import constants as K, session
from gradeloom.operators import costs, frontier, ordered, resolve
from gradeloom.sources import batches, results as R
from gradeloom.streaming import caps, ingest, jobs, windows


def answer(i, prompt="p", status=200):
    body = f'{{"model": "m", "choices": [{{"message": {{"content": "said {i}"}}}}], "usage": {{"prompt_tokens": {10 + i}, "completion_tokens": 2}}}}'
    return f'{{"custom_id": "{prompt}{i}", "response": {{"status_code": {status}, "body": {body}}}}}'


def claude(i, kind="succeeded"):
    body = f'{{"model": "c", "content": [{{"type": "text", "text": "said {i}"}}], "usage": {{"input_tokens": {20 + i}, "output_tokens": 3}}}}'
    return f'{{"custom_id": "p{i}", "result": {{"type": "{kind}", "message": {body}}}}}'


def tables(spark):
    jobs = spark.createDataFrame([("j1", "r1", "gpt-5.4-mini", "batch"), ("j2", "r1", "claude-haiku-4-5", "batch"), ("j3", "r1", "no price", "batch")], "batch_id string, run_id string, model string, lever string")
    prompts = spark.createDataFrame([(f"p{i}", "reasoning", "easy") for i in range(20)], "prompt_id string, task_category string, complexity string")
    return jobs, prompts, costs.pricing(spark)


def test_lines_of_either_provider_or_none_have_one_first_reason(spark):
    lines = spark.createDataFrame([("j1", answer(1)), ("j2", claude(2)), ("j1", answer(3, status=500)), ("j2", claude(4, "errored")), ("j9", answer(5)), ("j1", answer(99)),
                                   ("j3", answer(6)), ("j1", "{cut"), ("j1", "[]"), ("j1", "")], "batch_id string, value string")
    judged = batches.judged_lines(lines, *tables(spark))
    assert sorted((r.reason, r.n) for r in batches.rejected(judged).groupBy("reason").agg(F.count("*").alias("n")).collect()) == [
        ("failed request", 2), ("malformed line", 3), ("unknown job", 1), ("unknown prompt", 1), ("unpriced model", 1)]
    good = {r.prompt_id: r for r in batches.accepted(judged).collect()}
    assert {k: (r.provider, r.response_text, r.input_tokens) for k, r in good.items()} == {"p1": ("openai", "said 1", 11), "p2": ("anthropic", "said 2", 22)}


def test_ingest_in_two_drains_keeps_each_key_once_and_counts_reasons(spark, tmp_path):
    src = tmp_path / "files"
    (src / "batch_id=j1").mkdir(parents=True)
    (src / "batch_id=j1" / "a.txt").write_text("\n".join([answer(1), answer(2), answer(2), "{cut"]))
    go = lambda: ingest.ingest(spark, str(src), *tables(spark), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "log"))
    counted = []
    for step in range(2):
        for q in go():
            q.awaitTermination()
            counted.append([p.observedMetrics for p in q.recentProgress if p.observedMetrics])
        if not step:
            (src / "j2.jsonl").write_text("\n".join([claude(3), claude(4, "errored")]))
            (src / "batch_id=j1" / "b.txt").write_text("\n".join([answer(1), answer(5)]))
    rows = R.read_results(spark, str(tmp_path / "out")).collect()
    assert sorted(r.prompt_id for r in rows) == ["p1", "p2", "p3", "p5"]
    assert all(r.result_id and r.run_id == "r1" and r.cost_usd > 0 for r in rows)
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert sorted(r.reason for r in bad) == ["failed request", "malformed line"]
    first = [m["ingest"] for m in counted[0] if "ingest" in m]
    assert sum(m["n_accepted"] for m in first) == 3 and sum(m["n_malformed_line"] for m in first) == 1


def calls_of(spark, rows):
    return spark.createDataFrame([(run, f"2024-01-01 00:{ts // 60:02d}:{ts % 60:02d}", rid, cost, est) for run, ts, rid, cost, est in rows],
                                 "run_id string, ts string, result_id string, cost_usd double, est_cost_gbp double").withColumn("ts", F.to_timestamp("ts"))


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("kept_ms", [caps.KEPT_MS, 1])
def test_cap_alerts_come_once_and_state_expires(spark, tmp_path, few_partitions, kept_ms):
    runs = spark.createDataFrame([(f"r{i}", 1.0) for i in range(40)], "run_id string, cost_cap_gbp double")
    src, log, out = (str(tmp_path / x) for x in ("calls", "log", "out"))

    def drain(rows):
        calls_of(spark, rows).coalesce(1).write.mode("append").parquet(src)
        q = caps.alerts(spark.readStream.schema("run_id string, ts timestamp, result_id string, cost_usd double, est_cost_gbp double").parquet(src), runs, out, log, fx=1.0, kept_ms=kept_ms)
        q.awaitTermination()
        found = sorted((r.run_id, r.result_id, r.spent_gbp) for r in spark.read.parquet(out).collect())
        return sum(s.numRowsTotal for s in q.recentProgress[-1].stateOperators), found

    many, alerts = drain([(f"r{i}", 5, "a", 0.25, 0.5) for i in range(40)] + [("r1", 7, "c", 0.5, 0.5), ("r1", 6, "b", 0.5, 0.25), ("r1", 8, "d", 9.0, 9.0)])
    assert many == 40 and alerts == [("r1", "c", 0.75)]
    rest, alerts = drain([("r1", 9, "e", 1.0, 0.5), ("r2", 9, "x", 0.25, 0.75), ("r2", 9, "y", 0.0, 0.75)])
    if kept_ms == 1:  # forgotten by then
        assert rest < many and alerts == [("r1", "c", 0.75)]
    else:  # x just reaches the cap; r1 has had its alert
        assert rest == many and alerts == [("r1", "c", 0.75), ("r2", "y", 0.5)]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_alerts_are_those_of_the_batch_form(spark, tmp_path, few_partitions):
    rng = random.Random(3)
    rows = [(f"r{rng.randrange(5)}", i, f"c{i:04d}", rng.randrange(8) / 8, rng.randrange(8) / 8) for i in range(600)]
    runs = spark.createDataFrame([(f"r{i}", 10.0 + i) for i in range(6)], "run_id string, cost_cap_gbp double")
    src, out = str(tmp_path / "calls"), str(tmp_path / "out")
    for part in (rows[:100], rows[100:350], rows[350:]):
        calls_of(spark, rng.sample(part, len(part))).write.mode("append").parquet(src)
        stream = spark.readStream.schema("run_id string, ts timestamp, result_id string, cost_usd double, est_cost_gbp double").parquet(src)
        caps.alerts(stream, runs, out, str(tmp_path / "log"), fx=1.0).awaitTermination()
    want = costs.first_refused(calls_of(spark, rows), runs, fx=1.0)
    key = lambda df: sorted((r.run_id, r.result_id, r.spent_gbp) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(want) and len(key(want)) == 5


@pytest.mark.parametrize("cap", [60.0, 1e9])
def test_the_calls_of_a_large_run_are_not_all_in_memory(cap):
    import weakref

    import numpy as np
    import pandas as pd

    rng, alive, most = np.random.default_rng(5), [], 0
    n = 40_000
    calls = pd.DataFrame({"run_id": "r", "ts": pd.to_datetime(rng.integers(0, 5000, n), unit="s"), "result_id": [f"c{i:05d}" for i in rng.permutation(n)],
                          "cost_usd": rng.integers(-1, 8, n) / 64, "est_cost_gbp": rng.integers(0, 8, n) / 64, "cost_cap_gbp": cap})
    calls.loc[rng.integers(0, n, 50), "result_id"] = None

    def frames():
        nonlocal most
        for at in range(0, n, 500):
            part = calls.iloc[at:at + 500].copy()
            alive.append(weakref.ref(part))
            most = max(most, sum(ref() is not None for ref in alive))
            yield part

    class Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    check = caps.CapCheck(1.0, 1000, chunk=3000)
    check.run = Value()
    found = [tuple(r) for out in check.handleInputRows(("r",), frames(), None) for r in out[["result_id", "spent_gbp"]].itertuples(index=False)]
    ordered_calls = calls.sort_values(["ts", "result_id"], kind="stable", ignore_index=True)
    before = ordered_calls["cost_usd"].cumsum() - ordered_calls["cost_usd"]
    over = np.flatnonzero(before + ordered_calls["est_cost_gbp"] > cap)
    assert found == ([(ordered_calls["result_id"][over[0]], before[over[0]])] if len(over) else [])
    assert len(over) > 0 or cap == 1e9
    assert check.run.kept == (calls["cost_usd"].sum(), cap == 60.0)
    assert most < 10
    assert list(check.handleInputRows(("r",), iter([calls]), None)) == [] or cap == 1e9


# ---- sessions of a hot key ---------------------------------------------------------------------------
def test_sessions_of_a_hot_key_are_spread_and_equal(spark):
    rows = spark.range(100_000).select(F.lit("hot").alias("k"), F.timestamp_seconds((F.col("id") * 3 + F.pmod(F.xxhash64("id"), F.lit(90))).cast("long")).alias("ts"), "id")
    rows = rows.where("id % 5000 > 200").unionByName(spark.range(50).select(F.lit("cold").alias("k"), F.timestamp_seconds(F.col("id") * 400).alias("ts"), "id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as rows of this size would be one task
    parts = windows.session_parts(rows, ["k"], 300).persist()
    dealt = parts.where("k = 'hot'").groupBy(F.spark_partition_id()).agg(F.sum("n_calls").alias("n"), F.count("*").alias("parts")).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(dealt) >= 4 and max(r.n for r in dealt) < 0.5 * sum(r.n for r in dealt) and sum(r.parts for r in dealt) < 2000
    key = lambda df: sorted((r.k, r.session_start, r.session_end, r.n_calls, r.n_warm) for r in df.collect())
    want = key(windows.warm_sessions(rows, ["k"], 300))
    assert key(windows.hot_sessions(parts, ["k"], 300)) == want and 15 < len(want) < 200


@pytest.mark.parametrize("seed", [1, 2])
def test_session_parts_of_any_share_give_the_same_sessions(spark, seed):
    rng = random.Random(seed)
    rows = spark.createDataFrame([(rng.choice("ab"), rng.randrange(40_000) / 4) for _ in range(300)], "k string, s double").select("k", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    key = lambda df: sorted((r.k, r.session_start, r.session_end, r.n_calls) for r in df.collect())
    want = key(windows.warm_sessions(rows, ["k"], 60))
    for bucket, salts in ((60, 1), (600, 3), (100_000, 8)):
        parts = windows.session_parts(rows, ["k"], 60, bucket_seconds=bucket, salts=salts)
        assert key(windows.hot_sessions(parts, ["k"], 60, bucket)) == want


# ---- frontier of raw points ---------------------------------------------------------------------------
def test_frontier_points_by_brute_force_over_ties_and_gaps(spark):
    rng = random.Random(6)
    rows = [(rng.choice("xy"), i, rng.choice([None, float("nan"), 1, 2, 3, 4, 5]), rng.choice([None, 1, 2, 3])) for i in range(150)] + [("z", 1000, 1.0, 1)] * 3
    points = spark.createDataFrame([(g, i, None if q is None else float(q), c) for g, i, q, c in rows], "g string, id int, q double, c int")
    known = [(g, i, q, c) for g, i, q, c in rows if q is not None and q == q and c is not None]
    want = []
    for g, i, q, c in known:
        over = [(-q2, c2, i2) for g2, i2, q2, c2 in known if g2 == g and q2 >= q and c2 <= c and (q2 > q or c2 < c)]
        want.append((g, i, not over, min(over)[2] if over else None))
    got = frontier.frontier_points(points, ["g"], ["id"], "q", "c", slices=7).collect()
    assert sorted(map(repr, [(r.g, r.id, r.pareto_optimal, r.dominated_by and r.dominated_by.id) for r in got])) == sorted(map(repr, want))


def test_one_group_is_scanned_in_several_tasks(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("g"), "id", F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = ordered.running_least(rows, ["g"], [F.col("id")], F.col("v"), "least", slices=8).persist()
    tasks = df.groupBy(F.spark_partition_id().alias("t")).count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 10_000
    want = rows.withColumn("least", F.min("v").over(Window.partitionBy("g").orderBy("id")))
    assert df.select("id", "least").exceptAll(want.select("id", "least")).isEmpty() and df.count() == 20_000


@pytest.mark.parametrize("slices", [1, 3, 50])
def test_running_values_along_named_columns_take_one_shuffle(spark, slices):
    rng = random.Random(slices)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, -0.0, 0.0, float("nan"), 7.0]), i, rng.choice([None, 1, 2, -3])) for i in range(400)] + [("hot", 1.0, i, 1) for i in range(400, 900)]
    df = spark.createDataFrame(rows, "g string, t double, id int, v int")
    window = Window.partitionBy("g").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    key = lambda d: sorted(map(str, d.select("g", "t", "id", "v", "s").collect()))
    total = ordered.running_total(df, ["g"], ["t", "id"], {"s": F.col("v")}, slices)
    assert key(total) == key(df.withColumn("s", F.sum("v").over(window)))
    assert key(ordered.running_least(df, ["g"], ["t", "id"], F.col("v"), "s", slices)) == key(df.withColumn("s", F.min("v").over(window)))
    plan = total._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Join" not in plan and "_slice" in plan
    none = df.where("id < 0")
    assert ordered.running_total(none, ["g"], ["t", "id"], {"s": F.col("v")}, slices).count() == 0


def test_jobs_of_a_share_go_through_one_call(spark, tmp_path, few_partitions):
    rng = random.Random(9)
    rows = [(f"j{i // 4}", rng.choice(["submitted", "in_progress", "completed", "failed"]), rng.randrange(9000)) for i in range(2000)] + [(None, "submitted", 5)]
    rows += [("last", "submitted", 90_000), ("last", "completed", 90_001)]
    events = spark.createDataFrame(rows, "batch_id string, status string, s long").select("batch_id", "status", F.timestamp_seconds("s").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = jobs.job_outcomes(stream, shares=3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(s.numRowsTotal for p in q.recentProgress for s in p.stateOperators) <= 3  # not a call and a row for each of 502 jobs
    key = lambda df: sorted(map(str, df.select("batch_id", "status", "submitted_at", "ended_at", "age_s").collect()))
    want = key(jobs.job_outcomes_batch(events, F.timestamp_seconds(F.lit(80_000))).where("NOT batch_id <=> 'last'"))  # which the watermark has not passed
    assert key(spark.read.parquet(str(tmp_path / "out"))) == want and len(want) == 501


def test_streamed_files_are_small(spark, sf):
    """The lines of the outputs repeat their keys; as plain text they are most of what the ingest has on disk."""
    out = entry.stream_queries._drained(session.configure(spark), sf, costs.pricing(spark), False, True)
    path = out.removeprefix("file:")
    files = [os.path.join(d, f) for d, _, names in os.walk(path + "/files") for f in names if f.startswith("part-")]
    assert files and all(f.endswith(".txt.gz") for f in files)
    stored = [f for _, _, names in os.walk(path + "/results") for f in names if f.startswith("part-")]
    assert stored and all(f.endswith(".zstd.parquet") for f in stored)


def test_result_key_is_what_the_stream_checks():
    assert set(K.RESULT_KEY) <= set(R.RESULT_FIELDS)


def test_marks_of_every_type_are_the_same_as_text_and_as_values(spark, monkeypatch):
    df = spark.range(40).selectExpr("id", "CAST(id AS INT) AS i", "id % 2 = 0 AS b", "concat('a''\\\\\\\\\\n é', id) AS s", "unhex(sha2(CAST(id AS STRING), 256)) AS x",
                                    "CASE id WHEN 3 THEN double('nan') WHEN 4 THEN double('-inf') ELSE id / 7 END AS d", "CAST(id / 7 AS DECIMAL(20, 6)) AS c", "CASE WHEN id % 3 > 0 THEN id END AS `n'\\\\`")
    found = []
    for plain in (ordered._PLAIN, set()):
        monkeypatch.setattr(ordered, "_PLAIN", plain)
        marks = ordered._marks(df, df.columns, 20)
        found.append(repr(spark.range(1).select(marks.alias("m")).first().m))
        assert spark.range(1).select(marks.alias("m")).schema["m"].dataType.elementType.simpleString() == df.schema.simpleString()
    assert found[0] == found[1]


def test_a_queue_shuffles_its_cases_once_and_has_every_place(spark):
    rows = [(p, m, lv, a, 0.5) for p in ("cs-1", "rag-2", None) for m in ("m1", None) for lv in ("compression", "batch") for a in (0.0, 0.5, None)] * 2
    cases = spark.createDataFrame(rows, "prompt_id string, model string, lever string, judge_a_score double, judge_b_score double")
    for mode in ("compression-first", "shuffle"):
        got = resolve.arbitration_queue(cases, mode, slices=3).collect()
        assert sorted(r.pos for r in got) == list(range(len(rows)))
        last = lambda v: (v is None, v)
        if mode == "shuffle":
            key = lambda r: hashlib.sha256("|".join(x for x in ("0", r.prompt_id, r.model, r.lever) if x is not None).encode()).hexdigest()
        else:
            key = lambda r: (r.lever != "compression", last(None if r.delta is None else -r.delta), last(r.prompt_id), last(r.model))
        order = [key(r) for r in sorted(got, key=lambda r: r.pos)]
        assert order == sorted(order)
    plan = resolve.arbitration_queue(cases, "shuffle")._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan  # places were joined back to the cases
