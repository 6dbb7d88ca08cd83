"""Sources and sinks, written and read back; typed equality; planned work; ordered output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom import constants as K
from gradeloom.catalog import SQL, query
from gradeloom.catalog.cost_queries import runs_of
from gradeloom.catalog.grid import grid_sql, prompts, results, table, wide
from gradeloom.catalog.judge_queries import JUDGES, PAIRS, REPLIES, _BIAS, pairs, scores
from gradeloom.catalog.plan_queries import _LOG, _grid_jobs, output_lines, partial, phase_log
from gradeloom.functions import jsonvalues as J
from gradeloom.operators import audits, costs, judges, planning
from gradeloom.plans import audit
from gradeloom.session import ensure_checkpoint_dir
from gradeloom.sources import batches, cases as case_files_io, logs, prompts as prompt_source, results as R


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint directory, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# ---- prompt files --------------------------------------------------------------------------------
def prompt_objects(spark, sf) -> DataFrame:
    """Prompt objects as JSON text; every fiftieth has a fault, and every hundredth id comes twice."""
    p = prompts(spark, sf)
    fault = F.pmod(F.xxhash64("prompt_id"), F.lit(50))
    tiers = F.struct(F.when(F.col("expected").isNotNull(), F.struct(F.parse_json("expected").alias("expected"))).alias("tier_1_deterministic"),
                     F.when(F.col("criteria").isNotNull(), F.struct("criteria")).alias("tier_2_judge"))
    body = F.struct("prompt_id", F.when(F.col("prompt_id").endswith("77"), F.lit("unheard_of")).otherwise(F.col("task_category")).alias("task_category"), "complexity",
                    F.struct(F.col("system_text").alias("system"), F.col("user_text").alias("user")).alias("input"), tiers.alias("scoring"),
                    F.struct(F.length("user_text").alias("input_tokens_approx")).alias("metadata"))
    copies = F.when(F.col("prompt_id").endswith("99"), F.lit(2)).otherwise(F.lit(1))
    return p.select(F.to_json(body).alias("value"), F.explode(F.sequence(F.lit(1), copies)).alias("copy"), fault.alias("fault"))


#: Most prompts of a file that one task reads, and of one that is read in byte ranges.
PER_FILE, PER_ARRAY = 10_000, 500_000


def files_for(spark, sf, most: int) -> int:
    """Files among which the prompts are dealt, so that none grows with the table."""
    return max(1, -(-prompts(spark, sf).count() // most))


def written_prompts(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two sets of array files with about PER_FILE prompts each at most: second copies lie in files of their own."""
    path = folder(spark, "prompts")
    objects = prompt_objects(spark, sf)
    part = F.pmod(F.xxhash64("value"), F.lit(max(16, files_for(spark, sf, PER_FILE)))).alias("part")
    files = objects.groupBy("copy", part).agg(F.array_join(F.collect_list("value"), ",\n").alias("v"))
    files.select(F.concat(F.lit("["), "v", F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return prompt_source.read_prompts(spark, path)


@query("prompt_files", grid_sql(
    "SELECT prompt_id, task_category, complexity, system_text, user_text, criteria, CAST(length(user_text) AS BIGINT) AS input_tokens_approx FROM prompts "
    "WHERE NOT ends_with(prompt_id, '77') AND NOT ends_with(prompt_id, '99')"))
def prompt_files(spark, sf):
    return written_prompts(spark, sf)[0].select("prompt_id", "task_category", "complexity", "system_text", "user_text", "criteria", "input_tokens_approx")


@query("prompt_rejects", grid_sql(
    "SELECT prompt_id, 'task_category' AS reasons, CAST(1 AS BIGINT) AS n FROM prompts WHERE ends_with(prompt_id, '77') UNION ALL "
    "SELECT prompt_id, 'duplicate prompt_id', CAST(2 AS BIGINT) FROM prompts WHERE ends_with(prompt_id, '99')"))
def prompt_rejects(spark, sf):
    return written_prompts(spark, sf)[1].groupBy("prompt_id", F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


def arrays(objects: DataFrame, path: str, files: int) -> None:
    """Write JSON texts as arrays, one to a file, item by item; the last item of the first file is no prompt."""
    import pyarrow as pa
    from pyspark import TaskContext

    def joined(parts):
        before = "["
        for batch in parts:
            if batch.num_rows:
                items = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([before + items[0], *["," + x for x in items[1:]]])], ["value"])
                before = ","
        if TaskContext.get().partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([before + '{"prompt_id": 1}]'])], ["value"])
        elif before == ",":  # a file without items would be a faulty one
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    objects.select("value").repartition(files).mapInArrow(joined, "value string").write.option("lineSep", " ").text(path)


def ranged_prompts(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All prompt objects in files without line breaks, one up to PER_ARRAY prompts, read in byte ranges."""
    path = folder(spark, "prompt-array")
    arrays(prompt_objects(spark, sf), path, files_for(spark, sf, PER_ARRAY))
    return prompt_source.read_prompts(spark, path, ranges=True)


@query("prompt_file_ranges", SQL["prompt_files"])
def prompt_file_ranges(spark, sf):
    return ranged_prompts(spark, sf)[0].select("prompt_id", "task_category", "complexity", "system_text", "user_text", "criteria", "input_tokens_approx")


@query("prompt_range_rejects", SQL["prompt_rejects"] + " UNION ALL SELECT '1', 'prompt_id,task_category,complexity,input,scoring,at least one tier,metadata', CAST(1 AS BIGINT)")
def prompt_range_rejects(spark, sf):
    return ranged_prompts(spark, sf)[1].groupBy("prompt_id", F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


# ---- cases, logs, tables -------------------------------------------------------------------------
@query("case_files", grid_sql(
    "SELECT prompt_id, model, lever, printf('%.3f', fa) AS a, printf('%.3f', fb) AS b FROM (SELECT *, a AS fa, b AS fb FROM pairs) WHERE dis", REPLIES, PAIRS))
def case_files(spark, sf):
    """Flagged pairs (FIL-8) written as case files and read back."""
    path = folder(spark, "cases")
    case_files_io.write_cases(case_files_io.disagreement_cases(pairs(spark, sf)), path)
    rows = case_files_io.read_cases(spark, path)
    return rows.select("prompt_id", "model", "lever", F.format_string("%.3f", "judge_a_score").alias("a"), F.format_string("%.3f", "judge_b_score").alias("b"))


@query("case_file_ranges", SQL["case_files"])
def case_file_ranges(spark, sf):
    """The same cases as one file up to PER_ARRAY prompts, with notes of several lines, read in byte ranges."""
    path = folder(spark, "case-file")
    notes = F.concat(F.lit('said "'), "prompt_id", F.lit('",\nand more'))
    case_files_io.write_cases(case_files_io.disagreement_cases(pairs(spark, sf)).withColumn("human_note", notes).repartition(files_for(spark, sf, PER_ARRAY)), path)
    rows = case_files_io.read_cases(spark, path, ranges=True).where(F.col("human_note") == notes)
    return rows.select("prompt_id", "model", "lever", F.format_string("%.3f", "judge_a_score").alias("a"), F.format_string("%.3f", "judge_b_score").alias("b"))


@query("phase_log_round_trip", "WITH " + _LOG + " SELECT run_id, phase, event, count(*) AS n, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM log GROUP BY 1, 2, 3")
def phase_log_round_trip(spark, sf):
    path = folder(spark, "phases")
    logs.append_json(phase_log(spark, sf), path)
    rows = logs.read_phase_log(spark, path).where("bad_line IS NULL")
    return rows.groupBy("run_id", "phase", "event").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("position_log_round_trip", grid_sql(
    "SELECT prompt_id, lever, CAST('0x' || substr(sha256(prompt_id || '|' || lever), 1, 8) AS BIGINT) AS seed, CAST(4 AS BIGINT) AS n_slots, CAST(4 AS BIGINT) AS n_models "
    "FROM (SELECT DISTINCT prompt_id, optimisation_lever AS lever FROM results)"))
def position_log_round_trip(spark, sf):
    path = folder(spark, "positions")
    groups = results(spark, sf).select("prompt_id", F.col("optimisation_lever").alias("lever")).distinct()
    logs.append_json(judges.position_map(groups).withColumns({"run_id": F.lit("run-1"), "ts": F.lit("2024-01-01 00:00:00").cast("timestamp")}), path)
    at = F.col("position_to_model")
    return logs.read_position_log(spark, path).select("prompt_id", "lever", "seed", F.size(at).cast("long").alias("n_slots"),
                                                      F.size(F.array_distinct(F.map_values(at))).cast("long").alias("n_models"))


@query("published_csv", grid_sql(
    "SELECT model, optimisation_lever AS lever, count(*) AS n_rows, round(avg(cost_usd), 7) AS mean_cost_usd, count(*) FILTER (WHERE tier_1_status = 'pass') AS n_pass FROM results GROUP BY 1, 2"))
def published_csv(spark, sf):
    """A table with NULLs as CSV with n/a, read back with types."""
    path = folder(spark, "csv")
    cells = results(spark, sf).groupBy("model", F.col("optimisation_lever").alias("lever")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("cost_usd").alias("mean_cost_usd"), F.nullif(F.count_if(F.col("tier_1_status") == "pass"), F.lit(0)).alias("n_pass"))
    logs.write_csv(cells.withColumn("n_pass", logs.n_a("n_pass")), path)
    rows = logs.read_csv(spark, path, "model string, lever string, n_rows bigint, mean_cost_usd double, n_pass bigint")
    return rows.fillna(0, ["n_pass"]).withColumn("mean_cost_usd", F.round("mean_cost_usd", 7))


def stored_results(spark, sf) -> str:
    path = folder(spark, "results")
    R.append_results(R.conform_results(results(spark, sf)), path)
    return path


@query("pruned_results", grid_sql("SELECT run_id, optimisation_lever, count(*) AS n, round(sum(cost_usd), 6) AS cost_usd FROM results WHERE run_id IN ('run-1', 'run-3') GROUP BY 1, 2"))
def pruned_results(spark, sf):
    """Two runs of the stored table; only their partitions are read."""
    rows = R.read_results(spark, stored_results(spark, sf), ["run-1", "run-3"])
    return rows.groupBy("run_id", "optimisation_lever").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query("insert_after_failures", grid_sql(
    "SELECT optimisation_lever, count(*) AS n, count(*) AS n_ok FROM (SELECT *, output_tokens * 7 + input_tokens AS h FROM results) WHERE h % 11 = 0 OR h % 7 = 0 GROUP BY 1"))
def insert_after_failures(spark, sf):
    """Stored calls, some of which failed (h % 7 = 0) or are missing (h % 11 = 0); the batch has a failed and a good row of each."""
    rows = results(spark, sf).select("result_id", "ts", *K.RESULT_KEY, F.lit(None).cast("string").alias("error"), (F.col("output_tokens") * 7 + F.col("input_tokens")).alias("h"))
    failed = rows.withColumn("error", F.lit("RateLimitError")).withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 HOUR"))
    stored = rows.where("h % 11 <> 0").withColumn("error", F.when(F.col("h") % 7 == 0, F.lit("Timeout")))
    new = R.insert_new(stored, failed.unionByName(rows))
    return new.groupBy("optimisation_lever").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNull()).alias("n_ok"))


# ---- batch rejects -------------------------------------------------------------------------------
@query("batch_output_rejects", grid_sql(
    "SELECT provider, reason, count(*) AS n FROM (SELECT provider, CASE WHEN h1 % 41 = 0 THEN 'malformed line' WHEN h2 % 31 = 0 THEN 'failed request' "
    "WHEN h1 % 29 = 0 THEN 'unknown prompt' WHEN provider = 'openai' THEN 'unpriced model' END AS reason FROM wide WHERE lever = 'batch') WHERE reason IS NOT NULL GROUP BY 1, 2"))
def batch_output_rejects(spark, sf):
    """Lines that give no result row, by reason; here one in forty-one is cut off and one provider has no prices."""
    parts = []
    for provider in ("openai", "anthropic"):
        lines = output_lines(spark, sf, provider, broken=True)
        prices = costs.pricing(spark).where(F.lit(provider) == "anthropic")
        parts.append(batches.batch_rejects(lines, provider, _grid_jobs(spark), prompts(spark, sf), prices).groupBy(F.lit(provider).alias("provider"), "reason").agg(F.count(F.lit(1)).alias("n")))
    return parts[0].unionByName(parts[1])


# ---- typed equality ------------------------------------------------------------------------------
#: Pairs of JSON values with k for a number and w for a word of the row: got, expected, equal.
_EQUALITY = [
    ("[[[\"w\", \"x\"]]]", "[[[\"X\", \"W\"]]]", True), ("[[[k.001]]]", "[[[k.0]]]", True), ("[[[[\"X w\"]]]]", "[[[[\" x  W\"]]]]", True),
    ("[[[[[k]]]], k]", "[k, [[[[k]]]]]", True), ("{\"q\": k00.0}", "{\"q\": ke2}", True), ("{\"q\": k}", "{\"q\": k.0}", True), ("{\"q\": true}", "{\"q\": 1}", True),
    ("{\"q\": [1, 2]}", "{\"q\": [2, 1]}", False), ("{\"q\": \"W\"}", "{\"q\": \"w\"}", False), ("[k, k, 1]", "[k, 1, 1]", False), ("[[k], [k]]", "[[k]]", False),
    ("k", "k.0", True), ("k.0", "k", False), ("k.5", "k", False), ("true", "1", False), ("null", "null", True), ("\"null\"", "null", False), ("[null, [true]]", "[[true], null]", True),
    ("[[[[[\"a\"], \"w\"]]]]", "[[[[\"w\", [\"a\"]]]]]", True), ("[[[1]], [[k]]]", "[[[k]], [[2]]]", False), ("[{\"a\": k.0}, [[k]]]", "[[[k]], {\"a\": k}]", True), ("[]", "[]", True), ("{}", "[]", False),
]


@query("typed_equality", "SELECT i AS pair, e AS equal, count(*) AS n FROM orders CROSS JOIN (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {str(e).lower()})" for i, (_, _, e) in enumerate(_EQUALITY)) + ") AS t(i, e) GROUP BY 1, 2")
def typed_equality(spark, sf):
    """JSON values of one to five list levels, objects, numbers, booleans and repeated items, filled from every order."""
    cases = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("pair"), F.lit(g).alias("got"), F.lit(e).alias("want")) for i, (g, e, _) in enumerate(_EQUALITY)])).alias("c")
    # files of few row groups are read in few tasks: the keys are dealt out before each becomes many pairs
    keys = table(spark, sf, "orders").select("o_orderkey").repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    rows = keys.select("o_orderkey", cases).select("o_orderkey", "c.*")
    fill = lambda c: F.replace(F.replace(F.col(c), F.lit("k"), (F.col("o_orderkey") % 900 + 3).cast("string")), F.lit("w"), F.lit("v"))
    up = lambda c: F.replace(fill(c), F.lit("W"), F.lit("V"))
    obj = lambda c: F.try_parse_json(F.concat(F.lit('{"f": '), up(c), F.lit("}")))
    return J.with_json_equal(rows, obj("got"), obj("want"), "equal").groupBy("pair", "equal").agg(F.count(F.lit(1)).alias("n"))


# ---- work, spend, judges, order ------------------------------------------------------------------
@query("next_attempt_planned", grid_sql(
    "SELECT optimisation_lever, next_attempt, count(*) AS n FROM (SELECT optimisation_lever, CASE WHEN (output_tokens * 7 + input_tokens) % 23 = 0 THEN 1 ELSE 2 END AS next_attempt FROM results) GROUP BY 1, 2"))
def next_attempt_planned(spark, sf):
    rows = results(spark, sf)
    return planning.next_attempt(partial(rows), rows).groupBy("optimisation_lever", F.col("next_attempt").cast("int").alias("next_attempt")).agg(F.count(F.lit(1)).alias("n"))


@query("first_refused_call", grid_sql(
    "SELECT run_id, result_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, result_id) AS r FROM (SELECT run_id, ts, result_id, "
    "coalesce(sum(cost_usd) OVER (PARTITION BY run_id ORDER BY ts, result_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / CAST(1.27 AS DOUBLE) + est > CAST(0.5 AS DOUBLE) AS refused "
    "FROM (SELECT *, CAST(0.001 AS DOUBLE) + CAST(input_tokens AS DOUBLE) / CAST(1000000 AS DOUBLE) AS est FROM results)) WHERE refused) WHERE r = 1"))
def first_refused_call(spark, sf):
    """The first call of each run whose estimate on top of the spend so far is over the cap."""
    calls = results(spark, sf).withColumn("est_cost_gbp", F.lit(0.001) + F.col("input_tokens").cast("double") / F.lit(1000000.0))
    caps = runs_of(results(spark, sf)).select("run_id").withColumn("cost_cap_gbp", F.lit(0.5))
    return costs.first_refused(calls, caps).select("run_id", "result_id")


_PANEL = ["judge-a", "judge-b", "judge-c"]


@query("judge_panel", grid_sql(
    "SELECT coalesce(list_max(list_transform(l, lambda v: abs(v - mid))) > CAST(0.2 AS DOUBLE), false) AS is_disagreement, count(*) AS n, round(sum(mid), 6) AS median_score FROM "
    "(SELECT l, list_aggregate(l, 'median') AS mid FROM (SELECT [judge_a_score, judge_b_score, CAST(output_tokens % 21 AS DOUBLE) / 20] AS l FROM results "
    "WHERE judge_a_score IS NOT NULL AND judge_b_score IS NOT NULL AND output_tokens % 3 <> 0)) GROUP BY 1"))
def judge_panel(spark, sf):
    """Three judges side by side, by the rule for three: flagged when any is far from the median."""
    rows = results(spark, sf).where("judge_a_score IS NOT NULL AND judge_b_score IS NOT NULL AND output_tokens % 3 <> 0")
    third = (F.col("output_tokens") % 21).cast("double") / 20
    said = F.explode(F.array(*[F.struct(F.lit(j).alias("judge"), s.alias("score")) for j, s in zip(_PANEL, (F.col("judge_a_score"), F.col("judge_b_score"), third))])).alias("s")
    long = rows.select("run_id", "prompt_id", "model", F.col("optimisation_lever").alias("lever"), said).select("run_id", "prompt_id", "model", "lever", "s.*").withColumn("reasoning", F.lit(None).cast("string"))
    return judges.pair_and_flag(long, *_PANEL).groupBy("is_disagreement").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("median_score"), 6).alias("median_score"))


@query("costliest_calls", grid_sql("SELECT result_id, cost_usd, row_number() OVER (ORDER BY cost_usd DESC, result_id) AS pos FROM results ORDER BY cost_usd DESC, result_id LIMIT 25"))
def costliest_calls(spark, sf):
    """A top-k report with its order as a column."""
    return audits.top_rows(results(spark, sf).select("result_id", "cost_usd"), [F.desc("cost_usd"), F.col("result_id")], 25)


def _unpivot(audit_name: str, subject: str, measures: list[str], body: str) -> str:
    """Rows (audit, subject, measure, value) of a query, as ``judge_audit`` lays them out."""
    values = ", ".join(f"CAST({m if m.isidentifier() and m != 'n' else chr(34) + m + chr(34)} AS DOUBLE)" for m in measures)
    names = ", ".join(f"'{m}'" for m in measures)
    return f"SELECT '{audit_name}' AS audit, {subject} AS subject, unnest([{names}]) AS measure, unnest([{values}]) AS value FROM ({body})"


_AUDIT = " UNION ALL ".join([
    _unpivot("summary", "judge", ["n_errors", "cost_usd", "n_scored", "p50_ms", "p95_ms", "cost_gbp"], (
        "SELECT judge, count(*) AS n_scored, count(judge_error) AS n_errors, sum(cost_usd) AS cost_usd, sum(cost_usd) / CAST(1.27 AS DOUBLE) AS cost_gbp, max(latency_ms) FILTER (WHERE rn = cnt // 2) AS p50_ms, "
        "max(latency_ms) FILTER (WHERE rn = CAST(floor(cnt * CAST(0.95 AS DOUBLE)) AS BIGINT)) AS p95_ms FROM (SELECT *, row_number() OVER (PARTITION BY judge ORDER BY latency_ms) - 1 AS rn, count(*) OVER (PARTITION BY judge) AS cnt FROM long) GROUP BY 1")),
    _unpivot("range", "'all'", ["n", "n_in_range", "min_score", "max_score", "mean_score"],
             "SELECT count(*) AS n, count(*) FILTER (WHERE score BETWEEN 0 AND 1) AS n_in_range, min(score) AS min_score, max(score) AS max_score, avg(score) AS mean_score FROM long WHERE score IS NOT NULL"),
    _unpivot("buckets", "bucket", ["n", "pct"], (
        "SELECT bucket, n, 100.0::DOUBLE * n / sum(n) OVER () AS pct FROM (SELECT CASE WHEN score = 1 THEN '1.00' WHEN score >= CAST(0.8 AS DOUBLE) THEN '0.80–0.99' WHEN score >= CAST(0.6 AS DOUBLE) THEN '0.60–0.79' "
        "WHEN score >= CAST(0.4 AS DOUBLE) THEN '0.40–0.59' WHEN score >= CAST(0.2 AS DOUBLE) THEN '0.20–0.39' ELSE '0.00–0.19' END AS bucket, count(*) AS n FROM long WHERE score IS NOT NULL GROUP BY 1)")),
    _unpivot("disagreement", "'all'", ["n_pairs", "n_complete", "n_disagree", "disagree_pct"],
             "SELECT count(*) AS n_pairs, count(delta) AS n_complete, count(*) FILTER (WHERE dis) AS n_disagree, 100.0::DOUBLE * count(*) FILTER (WHERE dis) / count(delta) AS disagree_pct FROM pairs"),
    _unpivot("calibration", "family", ["mean_a", "n_a", "mean_b", "n_b", "delta", "flagged"], (
        "SELECT *, mean_a - mean_b AS delta, abs(mean_a - mean_b) > CAST(0.05 AS DOUBLE) AS flagged FROM (SELECT CASE WHEN model LIKE 'claude%' THEN 'Anthropic' ELSE 'OpenAI' END AS family, "
        "avg(a) AS mean_a, count(a) AS n_a, avg(b) AS mean_b, count(b) AS n_b FROM pairs GROUP BY 1)")),
    _unpivot("occupancy", "model", [*K.POSITION_LABELS, "n_calls", "expected"], "SELECT model, " + ", ".join(f"count(*) FILTER (WHERE label = '{x}') AS \"{x}\"" for x in K.POSITION_LABELS)
             + ", count(*) AS n_calls, count(*) / CAST(4 AS DOUBLE) AS expected FROM slots WHERE (prompt_id, lever) IN (SELECT (prompt_id, lever) FROM long) GROUP BY model"),
    _unpivot("position_bias", "judge || '/' || model || '/' || position", ["n", "slot_mean", "row_mean", "deviation", "flagged"], (
        "SELECT *, slot_mean - row_mean AS deviation, abs(slot_mean - row_mean) > CAST(0.03 AS DOUBLE) AS flagged FROM (SELECT *, avg(slot_mean) OVER (PARTITION BY judge, model) AS row_mean FROM slot)")),
])


@query("judge_audit_table", grid_sql("SELECT audit, subject, measure, round(value, 6) AS value FROM (" + _AUDIT + ")", REPLIES, PAIRS, _BIAS))
def judge_audit_table(spark, sf):
    """The whole judge audit as one table.  Replies are parsed once: every audit reads the scores that this wrote."""
    path = folder(spark, "scores")
    scores(spark, sf).write.parquet(path)
    said = spark.read.parquet(path)
    df = audit.judge_audit(said, judges.pair_and_flag(said, *JUDGES), judges.position_map(said.select("prompt_id", "lever").distinct()))
    return df.withColumn("value", F.round("value", 6))


@query("approx_latency", grid_sql(
    "SELECT model, count(*) AS n, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms FROM results WHERE optimisation_lever <> 'batch' GROUP BY 1"))
def approx_latency(spark, sf):
    """The sketch at an accuracy beyond the rows compared, where it is exact."""
    rows = results(spark, sf).where("optimisation_lever <> 'batch'")
    return audits.approx_percentiles(rows, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, ["model"], 1_000_000)
