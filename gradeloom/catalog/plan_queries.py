"""Work planning, sources, updates, gates and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom import constants as K
from gradeloom.catalog import query
from gradeloom.catalog.cell_queries import r9
from gradeloom.catalog.cost_queries import PRICES_SQL, runs_of
from gradeloom.catalog.grid import grid_sql, prompts, results, table, wide
from gradeloom.functions import scores as S
from gradeloom.operators import audits, costs, gates, planning
from gradeloom.plans import audit, work
from gradeloom.session import ensure_checkpoint_dir
from gradeloom.sources import batches, results as R
from gradeloom.streaming import jobs as SJ, windows as SW


def partial(rows: DataFrame) -> DataFrame:
    """The grid with gaps: one call in twenty-three was never made."""
    return rows.where("(output_tokens * 7 + input_tokens) % 23 <> 0")


_PARTIAL = "partial AS (SELECT * FROM results WHERE (output_tokens * 7 + input_tokens) % 23 <> 0)"


@query("coverage_gap", grid_sql("SELECT optimisation_lever AS lever, model, count(*) AS n FROM results WHERE (output_tokens * 7 + input_tokens) % 23 = 0 GROUP BY 1, 2"))
def coverage_gap(spark, sf):
    gap = planning.coverage_gap(partial(results(spark, sf)), prompts(spark, sf))
    return gap.groupBy("lever", "model").agg(F.count(F.lit(1)).alias("n"))


@query("gap_by_lever", grid_sql("SELECT optimisation_lever AS lever, count(*) AS n_missing FROM results WHERE (output_tokens * 7 + input_tokens) % 23 = 0 GROUP BY 1"))
def gap_by_lever(spark, sf):
    return planning.gap_by_lever(planning.coverage_gap(partial(results(spark, sf)), prompts(spark, sf)))


@query("work_not_done", grid_sql(
    "SELECT run_id, optimisation_lever, count(*) AS n FROM results WHERE error IS NOT NULL OR (output_tokens * 7 + input_tokens) % 23 = 0 GROUP BY 1, 2"))
def work_not_done(spark, sf):
    rows = results(spark, sf)
    return planning.not_done(rows.select(*K.RESULT_KEY), partial(rows)).groupBy("run_id", "optimisation_lever").agg(F.count(F.lit(1)).alias("n"))


@query("missing_work", grid_sql(
    "SELECT lever, count(*) AS n FROM (SELECT optimisation_lever AS lever, prompt_id FROM results WHERE run_id = 'run-1' AND (error IS NOT NULL OR (output_tokens * 7 + input_tokens) % 23 = 0)) "
    "WHERE lever <> 'compression' OR prompt_id IN (SELECT prompt_id FROM (SELECT prompt_id, row_number() OVER (PARTITION BY task_category ORDER BY CASE complexity WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, prompt_id) AS r "
    "FROM prompts WHERE prompt_id IN (SELECT prompt_id FROM results WHERE run_id = 'run-1')) WHERE r <= 60) GROUP BY 1"))
def missing_work(spark, sf):
    rows, mine = partial(results(spark, sf)), results(spark, sf).where("run_id = 'run-1'").select("prompt_id").distinct()
    todo = work.missing_work(rows, prompts(spark, sf).join(mine, "prompt_id", "left_semi"), "run-1", subset_size=300)
    return todo.groupBy("lever").agg(F.count(F.lit(1)).alias("n"))


@query("next_attempt", grid_sql("SELECT model, optimisation_lever, next_attempt, count(*) AS n FROM (SELECT prompt_id, model, optimisation_lever, max(1 + (h2 % 3)) + 1 AS next_attempt FROM (SELECT *, lever AS optimisation_lever FROM wide) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3"))
def next_attempt(spark, sf):
    rows = wide(spark, sf).selectExpr("prompt_id", "model", "lever AS optimisation_lever", "'h' AS config_hash", "explode(sequence(1L, 1 + h2 % 3)) AS run_attempt")
    return planning.next_attempt(rows).groupBy("model", "optimisation_lever", "next_attempt").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_subset", grid_sql(
    "SELECT prompt_id, task_category, complexity FROM (SELECT *, row_number() OVER (PARTITION BY task_category ORDER BY CASE complexity WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, prompt_id) AS r FROM prompts) WHERE r <= 12"))
def stratified_subset(spark, sf):
    return planning.stratified_subset(prompts(spark, sf), 60).select("prompt_id", "task_category", "complexity")


def batch_jobs(spark, sf) -> DataFrame:
    """Line items as batch jobs: order -> run, part -> provider and model, flags -> status."""
    return table(spark, sf, "lineitem").selectExpr(
        "'job-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_extendedprice * 100 AS BIGINT) AS batch_id",
        "'run-' || l_orderkey % 50 AS run_id", "CASE WHEN l_partkey % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider", "'m-' || l_partkey % 4 AS model", "'batch' AS lever",
        "CASE l_linenumber % 4 WHEN 0 THEN 'submitted' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'in_progress' END AS status",
        "CAST(l_shipdate AS TIMESTAMP) AS submitted_at", "'[\"p-' || l_partkey || '\", \"p-' || l_suppkey || '\"]' AS prompt_ids")


_JOBS = (
    "WITH jobs AS (SELECT 'job-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(floor(l_extendedprice * 100) AS BIGINT) AS batch_id, 'run-' || l_orderkey % 50 AS run_id, "
    "CASE WHEN l_partkey % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider, 'm-' || l_partkey % 4 AS model, CASE l_linenumber % 4 WHEN 0 THEN 'submitted' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'in_progress' END AS status, "
    "l_shipdate AS submitted_at, l_partkey, l_suppkey FROM lineitem) ")


@query("latest_jobs", _JOBS + "SELECT run_id, provider, model, batch_id, status FROM (SELECT *, row_number() OVER (PARTITION BY run_id, provider, model ORDER BY submitted_at DESC, batch_id DESC) AS r FROM jobs "
       "WHERE status IN ('submitted', 'in_progress', 'completed')) WHERE r = 1")
def latest_jobs(spark, sf):
    return planning.latest_jobs(batch_jobs(spark, sf)).select("run_id", "provider", "model", "batch_id", "status")


@query("timed_out_jobs", _JOBS + "SELECT run_id, status, count(*) AS n FROM jobs WHERE status IN ('submitted', 'in_progress') AND epoch(TIMESTAMP '2000-01-01 00:00:00') - epoch(submitted_at) > 1800 GROUP BY 1, 2")
def timed_out_jobs(spark, sf):
    return planning.timed_out_jobs(batch_jobs(spark, sf), F.lit("2000-01-01 00:00:00").cast("timestamp")).groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("job_prompts", _JOBS + "SELECT prompt_id, count(*) AS n FROM (SELECT 'p-' || l_partkey AS prompt_id FROM jobs UNION ALL SELECT 'p-' || l_suppkey FROM jobs) GROUP BY 1")
def job_prompts(spark, sf):
    return batches.job_prompts(batch_jobs(spark, sf)).groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n"))


# ---- sources -------------------------------------------------------------------------------------
def output_lines(spark, sf, provider: str, broken: bool = False) -> DataFrame:
    """Batch output lines of a provider, written from the grid's batch rows; ``broken`` cuts off some of them."""
    df = wide(spark, sf).where(F.col("lever") == "batch").where(F.col("provider") == provider)
    cid = F.expr("CASE WHEN h1 % 29 = 0 THEN 'unknown' ELSE prompt_id END").alias("custom_id")
    if provider == "openai":
        line = F.struct(cid, F.expr(
            "named_struct('status_code', CASE WHEN h2 % 31 = 0 THEN 500 ELSE 200 END, 'body', named_struct('model', model || '-x', 'choices', CASE WHEN h2 % 37 = 1 THEN NULL ELSE array(named_struct("
            "'message', named_struct('content', response_text))) END, 'usage', named_struct('prompt_tokens', input_tokens + h1 % 50, 'completion_tokens', output_tokens, "
            "'prompt_tokens_details', CASE WHEN h1 % 2 = 0 THEN named_struct('cached_tokens', h1 % 50) END)))").alias("response"))
    else:
        line = F.struct(cid, F.expr(
            "named_struct('type', CASE WHEN h2 % 31 = 0 THEN 'errored' ELSE 'succeeded' END, 'message', named_struct('model', model || '-x', 'content', array("
            "named_struct('type', 'text', 'text', response_text), named_struct('type', 'thinking', 'text', 'hidden'), named_struct('type', 'text', 'text', '!')), "
            "'usage', named_struct('input_tokens', input_tokens, 'output_tokens', output_tokens, 'cache_read_input_tokens', h1 % 50)))").alias("result"))
    text = F.when(F.lit(broken) & (F.col("h1") % 41 == 0), F.substring(F.to_json(line), 1, 20)).otherwise(F.to_json(line))
    return df.select(F.concat_ws("-", F.lit("job"), "model").alias("batch_id"), text.alias("value"))


def _grid_jobs(spark) -> DataFrame:
    return spark.createDataFrame([(f"job-{m}", "run-1", m, "batch") for m in K.TEST_MODELS], "batch_id string, run_id string, model string, lever string")


_BATCH_COLS = ("SELECT model, provider, count(*) AS n, CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(cached) AS BIGINT) AS cached_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, "
               "CAST(sum(length(txt)) AS BIGINT) AS n_chars, round(sum((tin * in_rate + cached * in_rate * CAST(0.1 AS DOUBLE) + output_tokens * out_rate) / CAST(1000000 AS DOUBLE) * CAST(0.5 AS DOUBLE)), 6) AS cost_usd FROM ")


@query("batch_output_ingest", grid_sql(
    _BATCH_COLS + "(SELECT *, CASE WHEN provider = 'openai' AND h1 % 2 <> 0 THEN input_tokens + h1 % 50 ELSE input_tokens END AS tin, CASE WHEN provider = 'openai' AND h1 % 2 <> 0 THEN 0 ELSE h1 % 50 END AS cached, "
    "CASE WHEN provider = 'anthropic' THEN response_text || '!' WHEN h2 % 37 = 1 THEN '' ELSE response_text END AS txt FROM wide WHERE lever = 'batch' AND h1 % 29 <> 0 AND h2 % 31 <> 0) GROUP BY 1, 2"))
def batch_output_ingest(spark, sf):
    parsed = [batches.parse_lines(output_lines(spark, sf, p), p) for p in ("openai", "anthropic")]
    rows = batches.batch_results(parsed[0].unionByName(parsed[1]), _grid_jobs(spark), prompts(spark, sf), costs.pricing(spark))
    return rows.groupBy("model", "provider").agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.length("response_text")).alias("n_chars"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query("batch_requests", grid_sql(
    "SELECT prompt_id AS custom_id, system_text AS system, user_text AS user_message, 'gpt-5.4-mini' AS model, CAST(512 AS BIGINT) AS max_tokens FROM prompts"))
def batch_requests(spark, sf):
    line = F.col("value")
    get = lambda p: F.get_json_object(line, p)
    return batches.batch_requests(prompts(spark, sf), "gpt-5.4-mini", "openai", 512).select(
        get("$.custom_id").alias("custom_id"), get("$.body.messages[0].content").alias("system"), get("$.body.messages[1].content").alias("user_message"),
        get("$.body.model").alias("model"), get("$.body.max_completion_tokens").cast("long").alias("max_tokens"))


@query("insert_new_results", grid_sql(
    "SELECT optimisation_lever, count(*) AS n FROM results WHERE (output_tokens * 7 + input_tokens) % 23 = 0 GROUP BY 1"))
def insert_new_results(spark, sf):
    rows = results(spark, sf).select("result_id", *K.RESULT_KEY, "cost_usd", "output_tokens", "input_tokens")
    twice = rows.unionByName(rows)
    return R.insert_new(partial(rows), twice).groupBy("optimisation_lever").agg(F.count(F.lit(1)).alias("n"))


@query("guarded_score_update", grid_sql(
    "SELECT task_category, count(*) AS n, count(*) FILTER (WHERE judge_a_score IS NULL AND (output_tokens * 7 + input_tokens) % 23 <> 0) AS n_changed, "
    "round(sum(coalesce(judge_a_score, CASE WHEN (output_tokens * 7 + input_tokens) % 23 <> 0 THEN CAST(0.25 AS DOUBLE) END)), 6) AS total FROM results GROUP BY 1"))
def guarded_score_update(spark, sf):
    rows = results(spark, sf)
    new = partial(rows).select("result_id", F.lit(0.25).alias("judge_a_score"))
    df = R.coalesce_update(rows, new, ["result_id"], ["judge_a_score"], only_null=True)
    return df.groupBy("task_category").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("n_changed"), F.round(F.sum("judge_a_score"), 6).alias("total"))


@query("partial_status_update", _JOBS + "SELECT new_status AS status, count(*) AS n, count(*) FILTER (WHERE new_status <> status) AS n_changed FROM (SELECT *, CASE WHEN status = 'submitted' AND l_partkey % 3 = 0 THEN 'completed' ELSE status END AS new_status "
       "FROM (SELECT DISTINCT * FROM jobs)) GROUP BY 1")
def partial_status_update(spark, sf):
    base = batch_jobs(spark, sf).distinct()
    part = F.split("batch_id", "-")[3].cast("long")
    news = base.where(F.col("status") == "submitted").select("batch_id", F.when(part % 3 == 0, F.lit("completed")).alias("status")).distinct()
    df = R.coalesce_update(base, news, ["batch_id"], ["status"])
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("n_changed"))


@query("config_hashes", grid_sql(
    "SELECT lever, count(*) AS n, count(DISTINCT optimisation_config) + CASE WHEN count(*) > count(optimisation_config) THEN 1 ELSE 0 END AS n_hashes FROM wide GROUP BY 1"))
def config_hashes(spark, sf):
    df = wide(spark, sf).select("lever", S.config_hash(F.col("lever"), F.col("optimisation_config")).alias("h"))
    return df.groupBy("lever").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("n_hashes"))


@query("uniform_usage", grid_sql(
    "SELECT provider, CAST(sum(CASE WHEN provider = 'openai' THEN input_tokens - cached_tokens ELSE input_tokens END) AS BIGINT) AS input_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, "
    "CAST(sum(CASE WHEN provider = 'openai' THEN 0 ELSE 3 END) AS BIGINT) AS created FROM results GROUP BY 1"))
def uniform_usage(spark, sf):
    u = batches.usage_normalised(F.col("provider"), F.col("input_tokens"), F.col("output_tokens"), F.col("cached_tokens"), F.lit(3))
    return results(spark, sf).select("provider", u.alias("u")).groupBy("provider").agg(
        F.sum("u.input_tokens").alias("input_tokens"), F.sum("u.cached_tokens").alias("cached_tokens"), F.sum("u.cache_creation_tokens").cast("long").alias("created"))


# ---- gates and logs -------------------------------------------------------------------------------
def phase_log(spark, sf) -> DataFrame:
    """Events as a phase log: user -> run, type -> phase and event."""
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("run-"), (F.col("user_id") % 20).cast("string")).alias("run_id"),
        F.element_at(F.array(*map(F.lit, K.EXPECTED_PHASES)), (F.col("event_id") % (F.col("user_id") % 20 + 1) % 9 + 1).cast("int")).alias("phase"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("progress")).alias("event"))


_LOG = ("log AS (SELECT ts, 'run-' || CAST(user_id % 20 AS STRING) AS run_id, ([" + ", ".join(f"'{p}'" for p in K.EXPECTED_PHASES) + "])[CAST(event_id % (user_id % 20 + 1) % 9 + 1 AS INT)] AS phase, "
        "CASE WHEN event_type = 'error' THEN 'error' ELSE 'progress' END AS event FROM events)")


@query("phase_log_audit", "WITH " + _LOG + " SELECT run_id, count(*) AS n_events, count(*) FILTER (WHERE event = 'error') AS n_errors, string_agg(DISTINCT phase, ',' ORDER BY phase) AS phases, "
       "array_to_string(list_sort(list_filter([" + ", ".join(f"'{p}'" for p in K.EXPECTED_PHASES) + "], lambda p: NOT list_contains(list(phase), p))), ',') AS missing_phases FROM log GROUP BY 1")
def phase_log_audit(spark, sf):
    return gates.phase_log_audit(phase_log(spark, sf)).select("run_id", "n_events", "n_errors", F.array_join("phases", ",").alias("phases"), F.array_join("missing_phases", ",").alias("missing_phases"))


@query("critical_gaps", grid_sql("SELECT run_id, count(*) AS n_rows, count(error) AS n_errors, count(*) FILTER (WHERE judge_a_score IS NULL) AS n_null_critical, CAST(0 AS BIGINT) AS n_config_missing FROM results GROUP BY 1"))
def critical_gaps(spark, sf):
    return gates.critical_gaps(results(spark, sf), ["result_id", "run_id", "response_text", "cost_usd", "judge_a_score"])


@query("run_quality_gates", grid_sql(
    "SELECT run_id, unnest(['rows', 'batch jobs', 'no errors', 'no gaps', 'cache writes', 'cache reads', 'compressions', 'spend']) AS \"check\", "
    "unnest([n >= 30, run_id = 'run-1', errors = 0, true, true, true, n_un = 0, run_id <> 'run-2']) AS ok, unnest([CAST(n AS VARCHAR), CASE WHEN run_id = 'run-1' THEN '4' ELSE '0' END, CAST(errors AS VARCHAR), '0', '0/0', '0/0', "
    "CAST(n_comp - n_un AS VARCHAR) || '/' || CAST(n_comp AS VARCHAR), CASE WHEN run_id = 'run-2' THEN '0.010000' ELSE '0.000000' END]) AS detail FROM (SELECT run_id, count(*) AS n, count(error) AS errors, "
    "count(*) FILTER (WHERE optimisation_lever = 'compression') AS n_comp, count(*) FILTER (WHERE optimisation_lever = 'compression' AND optimisation_config LIKE '%unavailable%') AS n_un FROM results GROUP BY run_id) "
    "UNION ALL SELECT run_id, unnest(['log errors', 'log phases']), unnest([e = 0, missing = '']), unnest([CAST(e AS VARCHAR), missing]) FROM (SELECT run_id, count(*) FILTER (WHERE event = 'error') AS e, "
    "array_to_string(list_sort(list_filter([" + ", ".join(f"'{p}'" for p in K.EXPECTED_PHASES) + "], lambda p: NOT list_contains(list(phase), p))), ',') AS missing FROM log GROUP BY 1)", _LOG))
def run_quality_gates(spark, sf):
    rows = results(spark, sf).withColumn("model_version", F.col("model"))
    return audit.run_quality_gates(rows, runs_of(rows), _grid_jobs(spark), phase_log(spark, sf))


@query("sweep_summary", grid_sql(
    "SELECT model, optimisation_lever, count(*) FILTER (WHERE error IS NULL AND input_tokens % 5 <> 0) AS n_ran, count(*) FILTER (WHERE input_tokens % 5 = 0) AS n_skipped, count(error) AS n_errored, "
    "CAST(sum(latency_ms) AS BIGINT) AS sum_latency_ms, round(CAST(sum(latency_ms) AS DOUBLE) / greatest(max(latency_ms), 1), 9) AS speed_up FROM results GROUP BY 1, 2"))
def sweep_summary(spark, sf):
    df = results(spark, sf).withColumn("skipped", F.col("input_tokens") % 5 == 0)
    return r9(audits.sweep_summary(df, ["model", "optimisation_lever"], F.col("latency_ms")).drop("wall_ms"), "speed_up")


@query("exact_median_latency", grid_sql("SELECT model, median(latency_ms) AS median, count(*) AS n FROM results WHERE optimisation_lever <> 'batch' GROUP BY 1"))
def exact_median_latency(spark, sf):
    return audits.median_of(results(spark, sf).where("optimisation_lever <> 'batch'"), "latency_ms", ["model"])


@query("inferred_responses", grid_sql("SELECT prompt_id, 'echo ' || user_text AS response_text, length(user_text) // 4 AS output_tokens, CAST(NULL AS VARCHAR) AS error FROM prompts"))
def inferred_responses(spark, sf):
    """A user callable over planned work, Arrow batch by Arrow batch."""
    def echo(batch):
        out = batch[["prompt_id"]].copy()
        out["response_text"] = "echo " + batch["user_text"]
        out["output_tokens"] = batch["user_text"].str.len() // 4
        out["error"] = None
        return out

    return work.infer(prompts(spark, sf), echo, "prompt_id string, response_text string, output_tokens bigint, error string")


# ---- streams ---------------------------------------------------------------------------------------
def _folder(spark) -> str:
    """A fresh folder under the checkpoint directory every executor can reach."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"


def _event_stream(spark, sf) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _drain(df: DataFrame) -> DataFrame:
    """Run an append-mode stream over what is there, into Parquet, and read that back."""
    spark, out = df.sparkSession, _folder(df.sparkSession)
    q = df.writeStream.format("parquet").option("path", out + "/data").option("checkpointLocation", out + "/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out + "/data")


_US = "CAST(epoch_us({c}) AS BIGINT)"


@query("stream_phase_counts",
       "SELECT w AS window_start_us, event_type AS phase, n AS n_events, e AS n_errors FROM (SELECT epoch_us(time_bucket(INTERVAL 10 MINUTE, ts)) AS w, event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e "
       "FROM events GROUP BY 1, 2) WHERE w + 600000000 <= (SELECT epoch_us(max(ts)) FROM events) - 600000000")
def stream_phase_counts(spark, sf):
    log = _event_stream(spark, sf).select("ts", F.col("event_type").alias("phase"), F.col("event_type").alias("event"))
    df = _drain(SW.phase_counts(log))
    return df.select(F.unix_micros("window_start").alias("window_start_us"), "phase", "n_events", "n_errors")


@query("stream_warm_sessions",
       "SELECT user_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_calls, CAST(sum(n - 1) AS BIGINT) AS n_warm FROM (SELECT user_id, s, count(*) AS n, max(ts) AS last FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s "
       "FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2) "
       "WHERE last + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1")
def stream_warm_sessions(spark, sf):
    df = _drain(SW.warm_sessions(_event_stream(spark, sf), ["user_id"], 7200))
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_calls").alias("n_calls"), F.sum("n_warm").alias("n_warm"))


@query("stream_rolling_cells",
       "SELECT model, lever, count(*) AS n_windows, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(p) AS BIGINT) AS n_pass FROM (SELECT 'm-' || CAST(user_id % 4 AS STRING) AS model, event_type AS lever, w, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS p "
       "FROM (SELECT *, unnest([epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) - 0, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) - 21600000000]) AS w FROM events) GROUP BY 1, 2, 3) "
       "WHERE w + 43200000000 <= (SELECT epoch_us(max(ts)) FROM events) - 600000000 GROUP BY 1, 2")
def stream_rolling_cells(spark, sf):
    rows = _event_stream(spark, sf).select(
        "ts", F.concat(F.lit("m-"), (F.col("user_id") % 4).cast("string")).alias("model"), F.col("event_type").alias("optimisation_lever"),
        F.when(F.col("event_id") % 3 == 0, F.lit("pass")).otherwise(F.lit("fail_format")).alias("tier_1_status"), F.col("value").alias("cost_usd"))
    df = _drain(SW.rolling_cells(rows, "12 hours", "6 hours"))
    return df.groupBy("model", "lever").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n_rows").alias("n_rows"), F.sum("n_pass").alias("n_pass"))


@query("stream_spend_alerts",
       "SELECT run_id FROM (SELECT 'run-' || CAST(user_id AS STRING) AS run_id, sum(value) AS v FROM events GROUP BY 1) WHERE v / CAST(1.27 AS DOUBLE) > 2500")
def stream_spend_alerts(spark, sf):
    out = _folder(spark)
    calls = _event_stream(spark, sf).select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), F.col("value").alias("cost_usd"))
    caps = table(spark, sf, "events").select(F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id")).distinct().withColumn("cost_cap_gbp", F.lit(2500.0))
    SJ.breach_alerts(SW.spend_by_run(calls, caps), out + "/alerts", out + "/log").awaitTermination()
    return spark.read.parquet(out + "/alerts").select("run_id")


@query("stream_results_once",
       "SELECT optimisation_lever, n, n AS n_keys FROM (SELECT 'l-' || event_type AS optimisation_lever, count(DISTINCT user_id * 100 + event_id % 50) AS n FROM events GROUP BY 1)")
def stream_results_once(spark, sf):
    """Two passes over the same stream leave every key once."""
    out = _folder(spark)
    rows = _event_stream(spark, sf).select(
        F.concat_ws("-", F.lit("p"), F.col("user_id").cast("string"), (F.col("event_id") % 50).cast("string")).alias("prompt_id"), F.lit("m").alias("model"),
        F.concat(F.lit("l-"), "event_type").alias("optimisation_lever"), F.lit("h").alias("config_hash"), F.lit("run-1").alias("run_id"),
        F.lit(1).cast("long").alias("run_attempt"), F.col("value").alias("cost_usd"))
    for i in range(2):
        SJ.stream_results(rows, out + "/results", f"{out}/log{i}").awaitTermination()
    df = R.read_results(spark, out + "/results", ["run-1"])
    return df.groupBy("optimisation_lever").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("prompt_id").alias("n_keys"))


@query("stream_job_outcomes",
       "WITH j AS (SELECT CAST(event_id // 3 AS STRING) AS batch_id, ts, CASE event_id % 3 WHEN 0 THEN 'submitted' WHEN 1 THEN 'in_progress' ELSE CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'cancelled' END END AS status FROM events), "
       "g AS (SELECT batch_id, min(ts) AS s, min(ts) FILTER (WHERE status IN ('completed', 'cancelled')) AS e, arg_min(status, ts) FILTER (WHERE status IN ('completed', 'cancelled')) AS st FROM j GROUP BY 1) "
       "SELECT CASE WHEN e <= s + INTERVAL 30 MINUTE THEN st ELSE 'timed_out' END AS status, count(*) AS n FROM g WHERE CASE WHEN e <= s + INTERVAL 30 MINUTE THEN e ELSE s + INTERVAL 30 MINUTE END < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1")
def stream_job_outcomes(spark, sf):
    status = F.when(F.col("event_id") % 3 == 0, F.lit("submitted")).when(F.col("event_id") % 3 == 1, F.lit("in_progress")).otherwise(
        F.when(F.col("event_id") % 2 == 0, F.lit("completed")).otherwise(F.lit("cancelled")))
    events = _event_stream(spark, sf).select(F.floor(F.col("event_id") / 3).cast("string").alias("batch_id"), status.alias("status"), "ts")
    return _drain(SJ.job_outcomes(events)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("job_outcomes_batch",
       "WITH j AS (SELECT CAST(event_id // 3 AS STRING) AS batch_id, ts, CASE event_id % 3 WHEN 0 THEN 'submitted' WHEN 1 THEN 'in_progress' ELSE 'completed' END AS status FROM events), "
       "g AS (SELECT batch_id, min(ts) AS s, min(ts) FILTER (WHERE status = 'completed') AS e FROM j GROUP BY 1) "
       "SELECT CASE WHEN e <= s + INTERVAL 30 MINUTE THEN 'completed' ELSE 'timed_out' END AS status, count(*) AS n FROM g WHERE e <= s + INTERVAL 30 MINUTE OR s + INTERVAL 30 MINUTE < TIMESTAMP '2024-02-01 00:00:00' GROUP BY 1")
def job_outcomes_batch(spark, sf):
    status = F.element_at(F.array(F.lit("submitted"), F.lit("in_progress"), F.lit("completed")), (F.col("event_id") % 3 + 1).cast("int"))
    events = table(spark, sf, "events").select(F.floor(F.col("event_id") / 3).cast("string").alias("batch_id"), status.alias("status"), "ts")
    return SJ.job_outcomes_batch(events, F.lit("2024-02-01 00:00:00").cast("timestamp")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
