"""No side of a join is broadcast for a size that the planner only guessed."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gradeloom import constants as K
from gradeloom.operators import costs, judges
from gradeloom.sources import batches


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["coverage_gap", "gap_by_lever", "guarded_score_update", "judge_requests", "latest_score_update", "shuffled_queue", "insert_after_failures",
                                  "insert_new_results", "first_breach", "fresh_over_stored_scores", "lever_effects", "lever_ratios"])
def test_a_grown_side_is_not_broadcast_by_its_file_size(spark, sf, name):
    """The grid has 16 rows for each order, which the size of its file does not tell."""
    assert "BroadcastExchange" not in plan(entry.queries()[name](spark, sf))


def test_prices_are_sent_to_the_calls(spark, sf):
    found = plan(entry.queries()["call_costs"](spark, sf))
    assert "BroadcastHashJoin" in found and "BuildRight" in found and "BuildLeft" not in found


def test_lines_are_shuffled_for_their_prompts_only(spark):
    lines = spark.createDataFrame([("job-1", "{}")], "batch_id string, value string")
    jobs = spark.createDataFrame([("job-1", "run-1", K.TEST_MODELS[0], "batch")], "batch_id string, run_id string, model string, lever string")
    prompts = spark.createDataFrame([("p", "reasoning", "easy")], "prompt_id string, task_category string, complexity string")
    prices = costs.pricing(spark)
    for df in (batches.judged_lines(lines, jobs, prompts, prices), batches.batch_rejects(lines, "openai", jobs, prompts, prices),
               batches.batch_results(batches.parse_lines(lines, "openai"), jobs, prompts, prices)):
        found = plan(df.select("*", F.lit(1)))
        assert "hashpartitioning(batch_id" not in found and "hashpartitioning(model" not in found


def test_the_judge_audit_parses_replies_once(spark, sf):
    assert "parse_json" not in plan(entry.queries()["judge_audit_table"](spark, sf))


def test_reply_labels_are_read_without_lambdas(spark):
    """Expressions inside lambdas are interpreted row by row; a reply of each kind still gets its reason."""
    raw = ['{"A": 1, "B": 0.5, "C": 0, "D": 1e-1, "reasoning": {"A": "x", "C": 5}}', '{"A": true, "B": 1, "C": 1, "D": 1}', '{"A": 1, "B": 1.5, "C": 1, "D": 1}',
           '{"A": 1, "B": 1, "C": "0.5", "D": 1}', '{"A": 1, "B": 1, "C": null, "D": 1}', '{"A": 1}', "none", '{"A": 1, "B" 1}']
    df = judges.parse_reply(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw_text string"))
    assert "lambdafunction(named_struct" not in plan(df) and "lambda p" not in plan(df) and "_seen" not in plan(df)
    rows = {r.i: r for r in df.collect()}
    assert rows[0].scores == {"A": 1.0, "B": 0.5, "C": 0.0, "D": 0.1} and rows[0].reasonings == {"A": "x", "B": None, "C": None, "D": None}
    assert [rows[i].parse_error for i in range(8)] == [None, "score not a number: A", "score out of range: B", "score not a number: C", "score not a number: C",
                                                       "missing label B", "no JSON object found", "json decode failed"]
