"""Operators against hand-made cases and brute force."""

import datetime as dt
import itertools
import json
import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gradeloom import constants as K
from gradeloom.functions import scores as S, text as T
from gradeloom.operators import audits, cells, costs, effects, frontier as P, judges, ordered, planning, resolve
from gradeloom.plans import work
from gradeloom.sources import batches, cases as CS, logs, prompts as PR, results as R
from gradeloom.streaming import jobs as SJ


@pytest.mark.parametrize("scores,flag,median", [
    ((0.9, 0.7), True, 0.8), ((0.7, 0.5), False, 0.6), ((0.7, 0.4), True, 0.55), ((None, 0.4), False, 0.4), ((None, None), False, None),
    ((0.5, 0.5, 0.8), True, 0.5), ((0.5, 0.6, 0.7), False, 0.6), ((0.1, None, 0.9), True, 0.5), ((None, None, 0.3), False, 0.3), ((None, None, None), False, None),
])
def test_agreement(spark, scores, flag, median):
    cols = [F.lit(s).cast("double") for s in scores]
    r = spark.range(1).select(S.is_disagreement(*cols).alias("d"), S.canonical_score(*cols).alias("c")).collect()[0]
    assert r["d"] == flag
    assert r["c"] == (None if median is None else pytest.approx(median))


@pytest.mark.parametrize("cap,spent,tier", [
    (300.0, 100.0, "full"), (300.0, 150.0, "60-subset"), (300.0, 200.0, "30-subset"), (300.0, 230.0, "operator-call"), (300.0, 270.0, "skip"),
    (5.0, 1.0, "full"), (5.0, 2.5, "60-subset"), (5.0, 3.5, "30-subset"), (5.0, 4.0, "operator-call"), (5.0, 4.5, "skip"), (0.0, 0.0, "skip")])
def test_budget_tier(spark, cap, spent, tier):
    assert spark.range(1).select(S.budget_tier(F.lit(cap), F.lit(spent)).alias("t")).collect()[0]["t"] == tier


def test_positions_are_deterministic_and_balanced(spark):
    g = spark.range(400).select(F.concat(F.lit("p-"), "id").alias("prompt_id"), F.lit("batch").alias("lever"))
    a = {r["prompt_id"]: r["position_to_model"] for r in judges.position_map(g).collect()}
    b = {r["prompt_id"]: r["position_to_model"] for r in judges.position_map(g, list(reversed(K.TEST_MODELS))).collect()}
    assert a == b and all(sorted(v.values()) == sorted(K.TEST_MODELS) for v in a.values())
    for label, model in itertools.product("ABCD", K.TEST_MODELS):
        assert 60 < sum(v[label] == model for v in a.values()) < 140
    with pytest.raises(ValueError):
        judges.position_map(g, ["one"])


def test_requests_are_blind(spark, sf):
    from gradeloom.catalog.grid import prompts, results

    hidden = [*K.TEST_MODELS, "claude", "gpt-", *K.LEVERS]
    bad = None
    for word in hidden:
        hit = F.contains(F.lower("message"), F.lit(word))
        bad = hit if bad is None else bad | hit
    df = judges.build_judge_requests(results(spark, sf), prompts(spark, sf))
    assert df.where(bad).count() == 0 and df.count() > 0


REPLIES = {
    '{"A": 0.5, "B": 1, "C": 0.0, "D": 1.0, "reasoning": {"A": "fine", "B": 3}}': None,
    '```json\n{"A": 0.5, "B": 1, "C": 0, "D": 1}\n```': None,
    'Scores: {"A": 0.5, "B": 1, "C": 0, "D": 1}': None,
    '{"A": 0.5, "B": 1, "C": 0}': "missing label D",
    '{"A": true, "B": 1, "C": 0, "D": 1}': "score not a number: A",
    '{"A": "0.5", "B": 1, "C": 0, "D": 1}': "score not a number: A",
    '{"A": 0.5, "B": 1.01, "C": 0, "D": 1}': "score out of range: B",
    '{"A": 0.5, "B": -0.1, "C": 0, "D": 1}': "score out of range: B",
    "no scores": "no JSON object found",
    '{"A": }': "json decode failed",
    '[{"A": 1}]': "missing label B",
}


def test_replies(spark):
    df = spark.createDataFrame([(t,) for t in REPLIES], "raw_text string")
    for r in judges.parse_reply(df).collect():
        assert r["parse_error"] == REPLIES[r["raw_text"]], r
        assert (r["scores"] is None) == (r["parse_error"] is not None)
    first = judges.parse_reply(df).first()
    assert first["scores"] == {"A": 0.5, "B": 1.0, "C": 0.0, "D": 1.0} and first["reasonings"]["A"] == "fine" and first["reasonings"]["B"] is None


def _cases(spark, rows):
    return spark.createDataFrame([(*r[:5], "", *(r[5:] or ("", "", ""))) for r in rows],
                                 "prompt_id string, model string, lever string, judge_a_score double, judge_b_score double, response_text string, human_score string, human_note string, arbitration_method string")


def test_auto_resolve_is_complementary_and_idempotent(spark):
    rows = [("cs-1", "m", "baseline", 0.7, 1.0), ("cs-2", "m", "baseline", 0.5, 0.8), ("cs-3", "m", "batch", 0.2, 0.9), ("cs-4", "m", "batch", 0.9, 0.5, "0.900", "n", "human")]
    c = _cases(spark, rows)
    limit = abs(0.7 - 1.0)
    once = resolve.auto_resolve(c, limit)
    got = {r["prompt_id"]: (r["human_score"], r["arbitration_method"]) for r in once.collect()}
    assert got == {"cs-1": ("0.850", K.AUTO_METHOD), "cs-2": ("0.650", K.AUTO_METHOD), "cs-3": ("", ""), "cs-4": ("0.900", "human")}
    assert [r["prompt_id"] for r in resolve.open_cases(c, limit).collect()] == ["cs-3"]
    assert sorted(map(tuple, resolve.auto_resolve(once, limit).collect())) == sorted(map(tuple, once.collect()))


def test_queue_modes_and_resume(spark):
    rng = random.Random(5)
    rows = [(f"{rng.choice(['cs', 'rag', 'rea', 'sum'])}-{i}", f"m{i % 3}", rng.choice(K.LEVERS), rng.randint(0, 20) / 20, rng.randint(0, 20) / 20) for i in range(200)]
    c = _cases(spark, rows)
    key = lambda r: (-abs(r[3] - r[4]), r[0], r[1])
    order = lambda df: [r["prompt_id"] for r in df.orderBy("pos").collect()]
    want = [r[0] for r in sorted(rows, key=lambda r: (r[2] != "compression", *key(r)))]
    queue = resolve.arbitration_queue(c, slices=7)
    assert order(queue) == want
    assert order(resolve.arbitration_queue(c, "cluster", cluster="rag")) == [r[0] for r in sorted((r for r in rows if r[0].startswith("rag")), key=key)]
    assert order(resolve.arbitration_queue(c, "by-category", categories=["sum"], slices=5)) == [r[0] for r in sorted(rows, key=lambda r: (not r[0].startswith("sum"), *key(r)))]
    a, b = order(resolve.arbitration_queue(c, "shuffle", seed=1)), order(resolve.arbitration_queue(c, "shuffle", seed=1))
    assert a == b and sorted(a) == sorted(want) and a != want
    done = queue.withColumn("human_score", F.when(F.col("pos") < 11, F.lit("0.5")).otherwise(F.lit("")))
    assert resolve.resume_position(done).collect()[0]["resume_at"] == 11
    assert resolve.resume_position(queue.withColumn("human_score", F.lit("1"))).collect()[0]["resume_at"] == 200


def test_running_total_and_ranks_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 4}", rng.randint(0, 40), i, float(rng.randint(0, 9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, id int, v double")
    got = ordered.running_total(df, ["g"], [F.col("t"), F.col("id")], {"s": F.col("v")}, slices=13)
    want, acc = {}, {}
    for g, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        acc[g] = acc.get(g, 0.0) + v
        want[i] = acc[g]
    assert {r["id"]: r["s"] for r in got.collect()} == want
    p = ordered.nearest_rank(df, "v", {"p50": F.floor(F.col("n") / 2), "p95": F.floor(F.col("n") * F.lit(0.95))}, ["g"], slices=5)
    med = {r["g"]: r["median"] for r in ordered.exact_median(df, "t", ["g"], slices=5).collect()}
    for r in p.collect():
        values = sorted(x[3] for x in rows if x[0] == r["g"])
        assert (r["p50"], r["p95"]) == (values[len(values) // 2], values[int(len(values) * 0.95)])
        assert med[r["g"]] == statistics.median(x[1] for x in rows if x[0] == r["g"])


def test_frontier_equals_pairwise_definition(spark):
    rng = random.Random(2)
    rows = [(f"c{i % 3}", f"m{i}", "l", rng.randint(0, 12) / 12, rng.randint(1, 12) / 100) for i in range(150)]
    df = spark.createDataFrame(rows, "task_category string, model string, lever string, mean_score double, mean_cost double")
    for r in P.frontier(df, ["task_category"]).collect():
        me = (r["mean_score"], r["mean_cost"])
        over = [(-q, c, m) for k, m, _, q, c in rows if k == r["task_category"] and q >= me[0] and c <= me[1] and (q > me[0] or c < me[1])]
        assert r["pareto_optimal"] == (not over)
        assert r["dominated_by_model"] == (min(over)[2] if over else None)


def test_warm_calls_equal_lag(spark):
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(("m", "hot") if i % 2 else (f"m{i % 5}", f"p{i % 7}")) + (base + dt.timedelta(seconds=rng.randint(0, 40000)), f"r{i}") for i in range(800)]
    df = spark.createDataFrame(rows, "model string, prompt_id string, ts timestamp, result_id string")
    warm, last = {}, {}
    for m, p, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        warm[i] = (m, p) in last and (t - last[(m, p)]).total_seconds() <= 300
        last[(m, p)] = t
    assert {r["result_id"]: r["warm"] for r in effects.warm_calls(df, 300).collect()} == warm


def test_cap_test_is_strict(spark):
    r = spark.range(1).select(costs.would_exceed(F.lit(9.0), F.lit(1.0), F.lit(10.0)).alias("a"), costs.would_exceed(F.lit(9.0), F.lit(1.01), F.lit(10.0)).alias("b")).collect()[0]
    assert (r["a"], r["b"]) == (False, True)


def test_read_prompts(spark, tmp_path):
    good = {"prompt_id": "cs-1", "task_category": "customer_support", "complexity": "easy", "input": {"system": "s", "user": "u"},
            "scoring": {"tier_1_deterministic": {"expected": {"amount": 249.0}}, "tier_2_judge": None}, "metadata": {"input_tokens_approx": 5}}
    bad = [
        ({**good, "prompt_id": ""}, "prompt_id"), ({**good, "task_category": "poetry"}, "task_category"), ({**good, "extra": 1}, "not an object, or unknown keys"),
        ({**good, "scoring": {}}, "at least one tier"), ({**good, "input": {"system": "", "user": "u"}}, "input"), ({**good, "metadata": {"input_tokens_approx": -1}}, "metadata"),
        ({**good, "scoring": {"tier_2_judge": {"criteria": ""}}}, "tier_2_judge"), ({**good, "complexity": 3}, "complexity"),
    ]
    (tmp_path / "a.json").write_text(json.dumps([good, *({**b, "prompt_id": b["prompt_id"] and f"cs-{i + 10}"} for i, (b, _) in enumerate(bad))]))
    (tmp_path / "b.json").write_text(json.dumps([{**good, "prompt_id": "dup"}, {**good, "prompt_id": "dup"}]))
    (tmp_path / "c.json").write_text("{not json")
    valid, rejected = PR.read_prompts(spark, str(tmp_path))
    rows = valid.withColumn("e", F.schema_of_variant("expected")).collect()
    assert [r["prompt_id"] for r in rows] == ["cs-1"] and "DECIMAL" in rows[0]["e"]
    reasons = [tuple(r["reasons"]) for r in rejected.collect()]
    assert sorted(reasons) == sorted([(x,) for _, x in bad] + [("duplicate prompt_id",)] * 2 + [("unreadable file",)])


def test_cases_round_trip_and_old_files(spark, tmp_path):
    pairs = spark.createDataFrame([("cs-1", "m", "batch", 0.7, 0.3, 'two\nlines, "quoted"'), ("cs-2", "m", "batch", 0.5, 0.5, "")],
                                  "prompt_id string, model string, lever string, judge_a_score double, judge_b_score double, response_text string")
    CS.write_cases(CS.disagreement_cases(pairs), str(tmp_path / "new"))
    old = tmp_path / "old.csv"
    old.write_text("prompt_id,model,lever,judge_a_score,judge_b_score,delta,tier_2_criteria,response_text,human_score\nrag-1,m,batch,0.7,1.0,0.300,c,r,\n")
    rows = {r["prompt_id"]: r for r in CS.read_cases(spark, str(tmp_path / "new"), str(old)).collect()}
    assert rows["cs-1"]["response_text"] == 'two\nlines, "quoted"' and rows["cs-1"]["human_score"] == ""
    assert rows["rag-1"]["delta"] == abs(0.7 - 1.0) and rows["rag-1"]["arbitration_method"] == ""
    assert set(rows) == {"cs-1", "rag-1"}
    scores = spark.createDataFrame([("cs-1", "m", "batch", " 0.65 ", "ok", 1), ("rag-1", "m", "batch", "1.2", "", 1)], "prompt_id string, model string, lever string, score string, note string, entered_at int")
    done = {r["prompt_id"]: (r["human_score"], r["arbitration_method"]) for r in resolve.apply_scores(CS.read_cases(spark, str(tmp_path / "new"), str(old)), scores).collect()}
    assert done == {"cs-1": ("0.650", "human"), "rag-1": ("", "")}
    CS.write_cases(CS.disagreement_cases(pairs.limit(0)), str(tmp_path / "none"))
    assert CS.read_cases(spark, str(tmp_path / "none")).count() == 0


def test_results_table_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "run-1", "p1", "m", "baseline", "h"), ("r2", "run-1", "p2", "m", "batch", "h")],
                                 "result_id string, run_id string, prompt_id string, model string, optimisation_lever string, config_hash string")
    path = str(tmp_path / "t")
    R.append_results(R.conform_results(rows), path)
    stored = R.read_results(spark, path, ["run-1"])
    assert stored.count() == 2 and stored.first()["run_attempt"] == 1 and stored.columns == list(R.RESULT_FIELDS)
    assert R.insert_new(stored, R.conform_results(rows.unionByName(rows))).count() == 0
    again = R.conform_results(rows.withColumn("run_id", F.lit("run-2")))
    assert R.insert_new(stored, again).count() == 2  # the skip rule is scoped to the run
    new = spark.createDataFrame([("r1", 0.5), ("r2", None)], "result_id string, judge_a_score double")
    up = R.coalesce_update(stored, new, ["result_id"], ["judge_a_score"])
    assert R.changed_count(up).first()["n_changed"] == 1
    second = R.coalesce_update(up.drop("changed"), new.withColumn("judge_a_score", F.lit(0.9)), ["result_id"], ["judge_a_score"], only_null=True)
    assert {r["result_id"]: r["judge_a_score"] for r in second.collect()} == {"r1": 0.5, "r2": 0.9}
    changed = up.where("optimisation_lever = 'baseline'")
    R.rewrite_runs(spark.createDataFrame(changed.collect(), changed.schema), path)
    assert {r["result_id"]: r["judge_a_score"] for r in R.read_results(spark, path).collect()} == {"r1": 0.5, "r2": None}


def test_batch_lines(spark, tmp_path):
    line = {"custom_id": "sum-015", "response": {"status_code": 200, "body": {"model": "gpt-5.4-mini-2026-03-17", "choices": [{"message": {"content": "text"}}],
            "usage": {"prompt_tokens": 1500, "completion_tokens": 100, "prompt_tokens_details": {"cached_tokens": 0}}}}}
    failed = {**line, "custom_id": "sum-016", "response": {"status_code": 500}}
    other = {**line, "custom_id": "unknown"}
    (tmp_path / "job-1.jsonl").write_text("\n".join(map(json.dumps, [line, failed, other])) + "\n\n")
    answers = batches.parse_lines(batches.read_lines(spark, str(tmp_path)), "openai")
    jobs = spark.createDataFrame([("job-1", "run-1", "gpt-5.4-mini-2026-03-17", "batch")], "batch_id string, run_id string, model string, lever string")
    prompts = spark.createDataFrame([("sum-015", "summarisation", "easy"), ("sum-016", "summarisation", "easy")], "prompt_id string, task_category string, complexity string")
    rows = batches.batch_results(answers, jobs, prompts, costs.pricing(spark)).collect()
    assert len(rows) == 1 and rows[0]["latency_ms"] == 0 and rows[0]["input_tokens"] == 1500
    assert rows[0]["cost_usd"] == pytest.approx((1500 * 0.75 + 100 * 4.5) / 1e6 / 2)


def test_phase_log(spark, tmp_path):
    logs.append_json(spark.createDataFrame([("run-1", "baseline", "start")], "run_id string, phase string, event string"), str(tmp_path / "log"))
    (tmp_path / "log" / "x.json").write_text("not json\n")
    rows = logs.read_phase_log(spark, str(tmp_path / "log")).collect()
    assert sorted((r["phase"], r["bad_line"]) for r in rows if r["phase"]) == [("baseline", None)] and any(r["bad_line"] == "not json" for r in rows)


def test_subset_and_work(spark):
    p = spark.createDataFrame([(f"{c[:3]}-{i}", c, K.COMPLEXITIES[i % 3]) for c in K.CATEGORIES for i in range(7)], "prompt_id string, task_category string, complexity string")
    got = planning.stratified_subset(p, 15).groupBy("task_category").count().collect()
    assert {r["count"] for r in got} == {3} and len(got) == 5
    with pytest.raises(ValueError):
        planning.stratified_subset(p, 16)
    none = spark.createDataFrame([], "run_id string, prompt_id string, model string, optimisation_lever string, error string")
    assert work.missing_work(none, p, "run-1", ["a", "b"], subset_size=15).count() == 35 * 2 * 3 + 15 * 2


def test_infer_keeps_failures_as_rows(spark):
    def call(pdf):
        raise RuntimeError("down")

    rows = work.infer(spark.range(3).withColumnRenamed("id", "prompt_id"), call, "prompt_id bigint, response_text string, error string").collect()
    assert len(rows) == 3 and all(r["error"] == "RuntimeError: down" for r in rows)


def test_job_outcomes_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", "submitted", 0), ("a", "completed", 900), ("b", "submitted", 10), ("b", "completed", 4000), ("c", "submitted", 20), ("d", "submitted", 50), ("d", "in_progress", 60),
            ("d", "failed", 1850), ("z", "submitted", 20000)]
    df = spark.createDataFrame([(b, s, t0 + dt.timedelta(seconds=x)) for b, s, x in rows], "batch_id string, status string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = SJ.job_outcomes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("batch_id", "status", "age_s").collect())
    twin = SJ.job_outcomes_batch(df, F.lit(t0 + dt.timedelta(seconds=19400)))
    assert got == sorted(tuple(r) for r in twin.select("batch_id", "status", "age_s").collect())
    assert got == [("a", "completed", 900), ("b", "timed_out", 1800), ("c", "timed_out", 1800), ("d", "failed", 1800)]


def test_small_text_helpers(spark):
    df = spark.createDataFrame([(0.0001, "gpt-9-2030-01-01", "ext-1"), (-0.0004, "claude-haiku-4-5", "rag-2"), (0.0123, "gpt-5.4-2026-03-05", "sum-3"), (-0.25, "other", "x")], "d double, m string, p string")
    rows = df.select(T.fmt_delta(F.col("d")).alias("d"), T.friendly_model(F.col("m")).alias("m"), T.provider_of(F.col("m")).alias("f"), T.category_of(F.col("p")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("0.000", "gpt-9", "OpenAI", "?"), ("0.000", "haiku", "Anthropic", "rag_qa"), ("+0.012", "gpt-5.4", "OpenAI", "summarisation"), ("-0.250", "other", "Other", "?")]
    h = spark.createDataFrame([("a", '{"x": 1, "y": 2}'), ("a", '{"y":2,"x":1}'), ("b", '{"y":2,"x":1}'), ("a", None)], "l string, c string").select(S.config_hash(F.col("l"), F.col("c")).alias("h")).collect()
    assert h[0] == h[1] and len({r["h"] for r in h}) == 3 and all(r["h"].startswith("sha256:") and len(r["h"]) == 23 for r in h)
    assert audits.histogram(spark.createDataFrame([(1.0,), (0.0,), (0.95,)], "s double"), "s").orderBy("bucket").collect()[9]["n"] == 2


def test_a_success_follows_a_stored_failure(spark):
    key = ["prompt_id", "model", "optimisation_lever", "config_hash", "run_attempt", "run_id"]
    row = lambda p, error, ts, text: (p, "m", "l", "h", 1, "r", error, ts, text)
    names = "prompt_id string, model string, optimisation_lever string, config_hash string, run_attempt int, run_id string, error string, ts int, response_text string"
    stored = spark.createDataFrame([row("a", "RateLimit", 1, None), row("b", None, 1, "kept"), row("c", "Timeout", 1, None)], names)
    batch = spark.createDataFrame([row("a", "RateLimit", 2, None), row("a", None, 3, "paid"), row("a", None, 4, "later"), row("b", None, 2, "again"), row("c", "Timeout", 2, None),
                                   row("d", "Timeout", 1, None), row("d", None, 2, "good")], names)
    assert set(key) == set(K.RESULT_KEY)
    new = R.insert_new(stored, batch)
    assert sorted((r.prompt_id, r.response_text) for r in new.collect()) == [("a", "paid"), ("d", "good")]
    assert R.insert_new(stored.unionByName(new), batch).count() == 0


def test_scores_without_a_rule_and_conflicts_keep_what_is_stored(spark):
    results = spark.createDataFrame(
        [("p1", "m", "l", "r1", 0, None, 0.4, 0.77), ("p2", "m", "l", "r1", 1, 0.1, 0.9, 0.66), ("p3", "m", "l", "r1", 1, 0.1, 0.9, None), ("p3", "m", "l", "r2", 1, 0.1, 0.9, 0.2), ("p4", "m", "l", "r1", 0, 0.2, 0.4, None)],
        "prompt_id string, model string, optimisation_lever string, run_id string, judge_disagreement_flag int, judge_a_score double, judge_b_score double, canonical_score double")
    cases = spark.createDataFrame([("p3", "m", "l", "r1", "0.500"), ("p3", "m", "l", "r2", "0.500"), ("p3", "m", "l", "r2", "0.700"), ("p9", "m", "l", "r1", "0.100")],
                                  "prompt_id string, model string, lever string, run_id string, human_score string")
    df, unmatched = resolve.populate_canonical(results, cases)
    assert sorted((r.prompt_id, r.run_id, round(r.canonical_score, 3)) for r in df.collect()) == [("p1", "r1", 0.77), ("p2", "r1", 0.66), ("p3", "r1", 0.5), ("p3", "r2", 0.2), ("p4", "r1", 0.3)]
    assert sorted((r.side, r.prompt_id, r.run_id) for r in unmatched.collect()) == [("cases", "p9", "r1"), ("conflict", "p3", "r2"), ("results", "p2", "r1")]
    bad = resolve.score_problems(cases.drop("run_id"), spark.createDataFrame([("p3", "m", "l", "1.5"), ("p3", "m", "l", "0.5"), ("p7", "m", "l", "0.5")], "prompt_id string, model string, lever string, score string"))
    assert sorted((r.prompt_id, r.reason) for r in bad.collect()) == [("p3", "invalid score"), ("p7", "unknown case")]


def test_rows_without_latency_still_count(spark):
    scores = spark.createDataFrame([("j", None, "down", 5.0), ("j", 10, None, 1.0), ("k", None, "down", 2.0)], "judge string, latency_ms bigint, judge_error string, cost_usd double")
    got = {r.judge: (r.n_scored, r.n_errors, r.cost_usd, r.p50_ms) for r in audits.judge_summary(scores).collect()}
    assert got == {"j": (2, 1, 6.0, 10), "k": (1, 1, 2.0, None)}


def test_free_calls_and_failed_baselines(spark):
    rows = spark.createDataFrame([("r", "p", "m", "baseline", 1, "a", None, 2.0, 10, 10, 5), ("r", "p", "m", "baseline", 2, "b", "Timeout", 0.0, 0, 0, 0), ("r", "p", "m", "caching", 1, "c", None, 1.0, 5, 10, 5)],
                                 "run_id string, prompt_id string, model string, optimisation_lever string, run_attempt int, result_id string, error string, cost_usd double, input_tokens int, output_tokens int, latency_ms int")
    assert [(x.cost_mult, x.input_mult) for x in cells.lever_ratios(rows).collect()] == [(0.5, 0.5)]
    prices = costs.pricing(spark, [("m", 1.0, 2.0, 0.1, 1.25)])
    calls = spark.createDataFrame([("m", 0, 0), ("m", 10, 0)], "model string, input_tokens int, output_tokens int")
    assert sorted((x.input_tokens, x.predicted_mult) for x in costs.predicted_cache_multiplier(calls, prices).collect()) == [(0, None), (10, 0.1)]
    free = spark.createDataFrame([("m", "a", 0.9, 0.0), ("n", "a", 0.5, 1.0)], "model string, lever string, mean_score double, mean_cost double")
    assert P.headline_scalars(free).first()["cost_share"] is None
    assert [x.cost_share for x in P.frontier_listing(free).collect()] == [None]


def test_one_id_in_two_files_is_rejected(spark, tmp_path):
    one = '[{"prompt_id": "p", "task_category": "extraction", "complexity": "easy", "input": {"system": "s", "user": "u"}, "scoring": {"tier_1_deterministic": {"expected": {"a": 1}}}, "metadata": {"input_tokens_approx": 1}}]'
    (tmp_path / "a.json").write_text(one)
    (tmp_path / "b.json").write_text(one)
    valid, rejected = PR.read_prompts(spark, str(tmp_path))
    assert valid.count() == 0 and [r.reasons for r in rejected.collect()] == [["duplicate prompt_id"]] * 2


def test_infer_loses_only_the_rows_that_raise(spark):
    def call(batch):
        if (batch["prompt_id"] == 1).any():
            raise RuntimeError("down")
        return batch.assign(price=Decimal("1.50"), error=None)

    rows = work.infer(spark.range(3).coalesce(1).withColumnRenamed("id", "prompt_id"), call, "prompt_id bigint,price decimal(10, 2),error string").collect()
    assert sorted((r.prompt_id, r.error) for r in rows) == [(0, None), (1, "RuntimeError: down"), (2, None)]


def test_job_state_is_freed_and_order_does_not_matter(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda b, s, x: (b, s, t0 + dt.timedelta(seconds=x))
    batches = [[at("a", "completed", 500), at("b", "in_progress", 550)], [at("a", "submitted", 0), at("b", "submitted", 100)], [at("z", "submitted", 8000)], [at("z", "completed", 8100)], [at("y", "submitted", 20000)], [at("x", "submitted", 40000)]]
    schema = "batch_id string, status string, ts timestamp"
    (tmp_path / "in").mkdir()
    q = SJ.job_outcomes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    kept = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        run.awaitTermination()
        kept.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r.batch_id, r.status, r.age_s) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    twin = SJ.job_outcomes_batch(every, F.lit(t0 + dt.timedelta(seconds=39400)))
    assert got == sorted((r.batch_id, r.status, r.age_s) for r in twin.collect())
    assert max(kept) >= 2 and kept[-1] <= 2


def test_a_run_filter_reaches_the_scan(spark, tmp_path):
    rows = R.conform_results(spark.createDataFrame([("r1", "a"), ("r2", "b")], "run_id string, prompt_id string").withColumn("optimisation_lever", F.lit("batch")))
    R.append_results(rows, str(tmp_path / "t"))
    plan = R.read_results(spark, str(tmp_path / "t"), ["r2"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [run_id" in plan or "PartitionFilters: [isnotnull(run_id" in plan
    updated = R.read_results(spark, str(tmp_path / "t")).withColumn("rubric_score", F.lit(1.0)).withColumn("changed", F.lit(True))
    R.rewrite_runs(updated.where("run_id = 'r2'"), str(tmp_path / "t"))
    assert sorted((r.run_id, r.rubric_score) for r in R.read_results(spark, str(tmp_path / "t")).collect()) == [("r1", None), ("r2", 1.0)]


def test_insert_moves_each_row_once_and_agrees_with_the_join(spark):
    rng = random.Random(4)
    key = [f"{p}|{m}" for p, m in itertools.product("abcdefgh", "xy")]
    row = lambda i: (f"r{i}", rng.choice([None, "2024-01-01", "2024-01-02"]), *rng.choice(key).split("|"), rng.choice(["l", None, "l"]), "h", 1, "run", rng.choice([None, "Timeout"]))
    schema = "result_id string, ts string, prompt_id string, model string, optimisation_lever string, config_hash string, run_attempt long, run_id string, error string"
    stored, batch = (spark.createDataFrame([row(f"{n}{i}") for i in range(40)], schema) for n in "sb")
    rows = lambda df: sorted(map(repr, df.collect()))
    for old, new in ((stored, batch), (stored.limit(0), batch), (stored, batch.where("error is not null")), (batch, batch)):
        assert rows(R.insert_new(old, new)) == rows(R.insert_joined(old, new).select(*batch.columns))
    plan = R.insert_new(stored, batch)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # the old form joined, and ordered what was left


def test_responses_of_a_group_move_once_and_the_latest_counts(spark):
    models = list(K.TEST_MODELS)
    row = lambda p, m, attempt, rid, text, error=None: ("run", p, "baseline", m, attempt, rid, text, error, "pass")
    rows = [row("p", m, 1, f"a{i}", f"old {i}") for i, m in enumerate(models)] + [row("p", models[0], 2, "b", "new"), row("p", models[0], 3, "c", "failed", "Timeout"), row("p", models[1], 1, "a1", "old 1"),
            row("q", models[0], 1, "d", "only"), row("q", models[1], 1, "e", "lost"), row("q", models[1], 2, "f", None), row("r", models[2], 1, "g", None), row("p", "another", 9, "z", "no")]
    df = spark.createDataFrame(rows, "run_id string, prompt_id string, optimisation_lever string, model string, run_attempt long, result_id string, response_text string, error string, tier_1_status string")
    got = {r.prompt_id: (r.n_models, {m: t for m, t in r.texts.items() if t}) for r in judges.group_responses(df).collect()}
    assert got == {"p": (4, {models[0]: "new"} | {m: f"old {i}" for i, m in enumerate(models) if i}), "q": (1, {models[0]: "only"})}
    plan = judges.group_responses(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 1  # ids and texts were shuffled apart, four times
