"""Sketches, key tables, run filters and updates: plans and errors."""

import os
import random
import uuid

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gradeloom import constants as K
from gradeloom.operators import audits, judges, sketches
from gradeloom.sources import keys, results as R


def rows_of(spark, n=4000, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(f"r{i % 4}", rng.choice("xy"), rng.choice([rng.randrange(100), 50, rng.randrange(100_000)]) if i % 9 else None) for i in range(n)], "run_id string, model string, ms long")


def worst_rank_error(values, found):
    values = sorted(values)
    worst = 0.0
    for rank, value in found.items():
        below, upto = sum(v < value for v in values) / len(values), sum(v <= value for v in values) / len(values)
        worst = max(worst, below - rank, rank - upto)
    return worst


def test_merged_sketches_are_as_exact_as_their_size(spark, tmp_path):
    rows = rows_of(spark)
    for run in range(4):
        sketches.append_sketches(sketches.sketch(rows.where(f"run_id = 'r{run}'"), "ms", ["run_id", "model"], 32), str(tmp_path / "s"))
    points = {f"p{i}": i / 20 for i in range(1, 20)}
    stored = sketches.quantiles(sketches.merged(spark.read.parquet(str(tmp_path / "s")), ["model"]), points, ["model"])
    whole = sketches.quantiles(sketches.sketch(rows, "ms", ["model"], 32), points, ["model"])
    for found in (stored, whole):
        for r in found.collect():
            values = [x.ms for x in rows.where(F.col("model") == r.model).collect() if x.ms is not None]
            assert r.n == len(values)
            assert worst_rank_error(values, {p: r[name] for name, p in points.items()}) <= sketches.rank_error(32)
    assert sketches.merged(sketches.sketch(rows.where("ms IS NULL"), "ms", ["model"]), ["model"]).count() == 0


def test_approximate_percentiles_at_low_accuracy(spark):
    rows = rows_of(spark, 20_000, 2).where("ms IS NOT NULL")
    for r in audits.approx_percentiles(rows, "ms", {"a": 0.1, "b": 0.5, "c": 0.9}, ["model"], 20).collect():
        values = [x.ms for x in rows.where(F.col("model") == r.model).collect()]
        assert 0 < worst_rank_error(values, {0.1: r.a, 0.5: r.b, 0.9: r.c}) + 1e-9 <= 1 / 20


def key_rows(spark, ids, error=None, run="r"):
    return spark.createDataFrame([(f"p{i}", "m", "l", "h", 1, run, error) for i in ids], "prompt_id string, model string, optimisation_lever string, config_hash string, run_attempt long, run_id string, error string")


def test_stored_keys_are_not_shuffled(spark, tmp_path):
    table = f"keys_{uuid.uuid4().hex}"
    keys.append_keys(key_rows(spark, range(500)), table, str(tmp_path / "k"), buckets=8)
    keys.append_keys(key_rows(spark, range(500, 600), "Timeout"), table, str(tmp_path / "k"), buckets=8)
    incoming = key_rows(spark, range(400, 700)).withColumns({"ts": F.lit(1), "result_id": F.lit("x")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    new = keys.new_rows(spark, incoming, table)
    plan = new._jdf.queryExecution().executedPlan().toString()
    got = sorted(int(r.prompt_id[1:]) for r in new.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert got == list(range(500, 700))  # known keys stay out, failed ones may be tried again
    stored = plan[plan.index("HashAggregate"):]  # the side of the key table
    assert "Bucketed: true" in stored and "Exchange" not in stored and plan.count("Exchange") >= 1
    spark.sql(f"DROP TABLE {table}")


def test_a_filter_on_runs_reads_their_partitions_only(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("r"), (F.col("id") % 8).cast("string")).alias("run_id"), F.lit("l").alias("optimisation_lever"), F.col("id").cast("string").alias("result_id"))
    R.append_results(R.conform_results(rows), str(tmp_path / "t"))
    spark.createDataFrame([(f"r{i}", i) for i in range(8)], "run_id string, cap int").write.parquet(str(tmp_path / "runs"))
    found = R.results_of_runs(spark, str(tmp_path / "t"), spark.read.parquet(str(tmp_path / "runs")).where("cap > 5"))
    assert found.count() == 100 and "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_one_update_counts_as_a_whole_and_copies_are_deleted(spark, tmp_path):
    R.append_results(R.conform_results(spark.createDataFrame([("a", "r", "l"), ("b", "r", "l")], "result_id string, run_id string, optimisation_lever string")), str(tmp_path / "t"))
    base = R.read_results(spark, str(tmp_path / "t"))
    news = spark.createDataFrame([("a", 0.9, "early", 1), ("a", 0.1, "zz late", 2), ("b", None, "only a reason", 1)], "result_id string, judge_a_score double, judge_a_reasoning string, at int")
    columns = ["judge_a_score", "judge_a_reasoning"]
    up = R.coalesce_update(base, news, ["result_id"], columns, latest=[F.col("at")])
    want = {"a": (0.1, "zz late"), "b": (None, "only a reason")}
    assert {r.result_id: (r.judge_a_score, r.judge_a_reasoning) for r in up.collect()} == want
    plain = R.coalesce_update(base, news, ["result_id"], columns)
    assert {r.result_id: (r.judge_a_score, r.judge_a_reasoning) for r in plain.collect()}["a"] == (0.9, "early")
    R.rewrite_runs(up, str(tmp_path / "t"))
    assert {r.result_id: (r.judge_a_score, r.judge_a_reasoning) for r in R.read_results(spark, str(tmp_path / "t")).collect()} == want
    assert not [x for x in os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if x.startswith("rewrite-")]


def test_sides_of_any_panel(spark):
    rows = [("r", f"p{g}", m, "l", "reasoning", None if g == 1 and m == K.TEST_MODELS[0] else 0.5, 0.5, None if g == 2 else 0.1) for g in range(3) for m in K.TEST_MODELS] + [("r", "p9", K.TEST_MODELS[0], "l", "reasoning", None, None, None)]
    df = spark.createDataFrame(rows, "run_id string, prompt_id string, model string, optimisation_lever string, task_category string, judge_a_score double, judge_b_score double, judge_x_score double")
    got = {r.prompt_id: (r.missing, r.skip) for r in judges.missing_panel_sides(df, ["a", "b", "x"]).collect()}
    assert got == {"p1": (["a"], ["b", "x"]), "p2": (["x"], ["a", "b"])}


def test_stored_rows_are_written_unsorted_and_compressed(spark, tmp_path):
    rows = spark.range(600).select(F.concat(F.lit("r"), F.pmod("id", F.lit(3)).cast("string")).alias("run_id"), F.lit("batch").alias("optimisation_lever"), F.col("id").cast("string").alias("prompt_id")).coalesce(1)
    R.append_results(R.conform_results(rows), str(tmp_path / "t"))
    files = list((tmp_path / "t").rglob("*.parquet"))
    assert len(files) == 3
    for f in files:
        assert pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD"
    assert 3 <= int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) <= 64  # 0: whole rows are sorted by folder
    assert R.read_results(spark, str(tmp_path / "t")).count() == 600


def test_cases_are_written_once_for_scores_and_their_targets(spark, sf, monkeypatch):
    from gradeloom.catalog import upkeep_queries as Q

    made = []
    monkeypatch.setattr(Q, "pairs", lambda *a, real=Q.pairs: made.append(a) or real(*a))
    plan = Q.human_scores(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "raw_text" not in plan and "orders" not in plan  # replies were parsed three times
    assert Q.human_scores(spark, sf).count() > 0


def test_hash_joins_are_bound_to_what_all_tasks_can_hold(spark):
    assert spark.conf.get("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold") == "16MB"


def test_prompts_are_dealt_out_before_they_become_replies(spark, sf):
    from gradeloom.catalog import judge_queries as Q

    plan = Q.replies(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate") < plan.index("RepartitionByExpression")  # one row group was one task
