"""Judge panel, disagreement, canonical scores and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom import constants as K
from gradeloom.catalog import query
from gradeloom.catalog.cell_queries import r9
from gradeloom.catalog.grid import LEVERS, PROMPT_COLUMNS, _prompt_frame, grid_sql, prompts, results, table
from gradeloom.functions import scores as S
from gradeloom.operators import audits, judges, resolve

_MODEL_VALUES = ", ".join(f"('{m}')" for m in K.TEST_MODELS)
POSITIONS_SQL = (
    "slots AS (SELECT prompt_id, ok, li, lever, m AS model, substr('ABCD', CAST(row_number() OVER (PARTITION BY prompt_id, lever ORDER BY "
    "sha256(prompt_id || '|' || lever || '|' || m)) AS INT), 1) AS label FROM (SELECT prompt_id, ok, li, lever FROM wide WHERE mi = 0) "
    f"CROSS JOIN (VALUES {_MODEL_VALUES}) AS t(m))")


def groups(spark, sf, parts: int | None = None) -> DataFrame:
    """(prompt, lever) groups of the grid, from prompts dealt out in ``parts`` if given."""
    levers = F.array(*[F.struct(F.lit(i).cast("long").alias("li"), F.lit(lv).alias("lever")) for i, lv in LEVERS])
    frame = _prompt_frame(spark, sf)
    frame = frame.select("ok", "prompt_id", "task_category").repartition(parts, "ok") if parts else frame
    return frame.withColumn("_l", F.explode(levers)).select("*", "_l.*").drop("_l")


@query("position_map", grid_sql(
    "SELECT prompt_id, lever, ('0x' || substr(sha256(prompt_id || '|' || lever), 1, 8))::BIGINT AS seed, string_agg(label || '=' || model, ',' ORDER BY label) AS slots "
    "FROM slots GROUP BY prompt_id, lever", POSITIONS_SQL))
def position_map(spark, sf):
    df = judges.position_map(groups(spark, sf).select("prompt_id", "lever"))
    text = F.array_join(F.transform(F.map_entries("position_to_model"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return df.select("prompt_id", "lever", "seed", text.alias("slots"))


@query("slot_occupancy", grid_sql(
    "SELECT model, " + ", ".join(f"count(*) FILTER (WHERE label = '{x}') AS \"{x}\"" for x in K.POSITION_LABELS)
    + ", count(*) AS n_calls, count(*) / CAST(4 AS DOUBLE) AS expected FROM slots GROUP BY model", POSITIONS_SQL))
def slot_occupancy(spark, sf):
    return audits.slot_occupancy(judges.position_map(groups(spark, sf).select("prompt_id", "lever")))


_JUDGEABLE = "error IS NULL AND tier_1_status <> 'compression_unavailable'"


@query("complete_groups", grid_sql(
    "SELECT lever, complete, count(*) AS n FROM (SELECT run_id, prompt_id, optimisation_lever AS lever, count(DISTINCT model) = 4 AS complete "
    f"FROM results WHERE {_JUDGEABLE} GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def complete_groups(spark, sf):
    return judges.complete_groups(results(spark, sf)).groupBy("lever", "complete").agg(F.count(F.lit(1)).alias("n"))


_CLOSING = K.JUDGE_SECTIONS["closing"].replace("\n", "' || chr(10) || '")
_NL2 = "chr(10) || chr(10)"
_REQUESTS = (
    "texts AS (SELECT r.prompt_id, r.optimisation_lever AS lever, r.run_id, string_agg('--- Response ' || label || ' ---' || chr(10) || response_text, " + _NL2
    + f" ORDER BY label) AS body FROM results r JOIN slots s ON r.prompt_id = s.prompt_id AND r.optimisation_lever = s.lever AND r.model = s.model WHERE {_JUDGEABLE} "
    "GROUP BY 1, 2, 3 HAVING count(*) = 4), requests AS (SELECT t.run_id, t.prompt_id, t.lever, '=== TASK PROMPT ===' || " + _NL2
    + " || '[system]' || chr(10) || system_text || " + _NL2 + " || '[user]' || chr(10) || user_text || " + _NL2
    + " || CASE WHEN task_category IN ('rag_qa', 'reasoning') THEN '=== REFERENCE ANSWER ===' || " + _NL2 + " || 'Reference answer (canonical): ''' || want || '''' || " + _NL2
    + " ELSE '' END || '=== EVALUATION CRITERIA ===' || " + _NL2 + " || criteria || " + _NL2 + " || '=== CANDIDATE RESPONSES ===' || " + _NL2 + " || body || " + _NL2
    + f" || '{_CLOSING}' AS message FROM texts t JOIN p_2 USING (prompt_id) WHERE criteria IS NOT NULL)")


@query("judge_requests", grid_sql("SELECT run_id, prompt_id, lever, sha256(message) AS digest, length(message) AS n_chars FROM requests", POSITIONS_SQL, _REQUESTS))
def judge_requests(spark, sf):
    df = judges.build_judge_requests(results(spark, sf), prompts(spark, sf))
    return df.select("run_id", "prompt_id", "lever", F.sha2("message", 256).alias("digest"), F.length("message").cast("long").alias("n_chars"))


# ---- judge replies: two calls per (prompt, lever), texts written by rule --------------------------
JUDGES = ["judge-one", "judge-two"]
_PCT = "(ok * 31 + li * 17 + {k} * 7 + ji * 3 + ok % 7 * ji) % 21 * 5"
_NUM = "CASE WHEN {p} = 100 THEN '1.00' ELSE '0.' || lpad(CAST({p} AS STRING), 2, '0') END"
REPLY_RULES = [
    {f"p{k}": _PCT.format(k=k) for k in range(4)},
    {"rk": "(ok + ji * 3 + li) % 12", **{f"t{k}": _NUM.format(p=f"p{k}") for k in range(4)}},
    {"plain": "'{\"A\": ' || t0 || ', \"B\": ' || t1 || ', \"C\": ' || t2 || ', \"D\": ' || t3 || ', \"reasoning\": {\"A\": \"covers it\", \"C\": 5}}'"},
    {
        "raw_text": "CASE rk WHEN 1 THEN '```json' || chr(10) || plain || chr(10) || '```' WHEN 2 THEN 'Here are the scores: ' || plain || ' Done.' "
                    "WHEN 3 THEN '{\"A\": 0.5, \"B\": 0.5, \"C\": 1}' WHEN 4 THEN '{\"A\": 0.5, \"B\": 1.5, \"C\": 1, \"D\": 0}' "
                    "WHEN 5 THEN '{\"A\": true, \"B\": 0.5, \"C\": 1, \"D\": 0}' WHEN 6 THEN substr(plain, 1, 20) "
                    "WHEN 7 THEN '{\"A\": 0.5, \"B\": 0.5, \"C\": \"0.5\", \"D\": 0}' WHEN 8 THEN '{\"A\": 0.5, \"B\" 0.5}' ELSE plain END",
        "problem": "CASE rk WHEN 3 THEN 'missing label D' WHEN 4 THEN 'score out of range: B' WHEN 5 THEN 'score not a number: A' "
                   "WHEN 6 THEN 'no JSON object found' WHEN 7 THEN 'score not a number: C' WHEN 8 THEN 'json decode failed' END",
        "call_error": "CASE WHEN (ok * 13 + li * 5 + ji) % 211 = 0 THEN 'Timeout' END",
        "latency_ms": "500 + (ok * 37 + li * 11 + ji * 101) % 9000",
        "cost_usd": "CAST(ok % 700 + 300 AS DOUBLE) / 100000",
        "run_id": "'run-' || CAST(ok % 4 AS STRING)",
    },
]


def replies(spark, sf) -> DataFrame:
    """Judge calls with their raw reply texts."""
    both = F.array(*[F.struct(F.lit(i).cast("long").alias("ji"), F.lit(j).alias("judge")) for i, j in enumerate(JUDGES)])
    # files of few row groups are read in few tasks: prompts are dealt out before each becomes many replies
    dealt = groups(spark, sf, 4 * spark.sparkContext.defaultParallelism)
    placed = judges.position_map(dealt.where("task_category <> 'extraction'"))  # once for all judges
    df = placed.withColumn("_j", F.explode(both)).select("*", "_j.*").drop("_j")
    for rules in REPLY_RULES:
        df = df.withColumns({c: F.expr(e) for c, e in rules.items()})
    return df.select("run_id", "prompt_id", "lever", "judge", "raw_text", "call_error", "latency_ms", "cost_usd", "seed", "position_to_model")


def _reply_sql() -> str:
    out, prev = [], ("(SELECT p.*, li, lever, ji, judge FROM p_2 p CROSS JOIN (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in LEVERS) + ") AS l(li, lever) "
                     "CROSS JOIN (VALUES (0, 'judge-one'), (1, 'judge-two')) AS j(ji, judge) WHERE task_category <> 'extraction')")
    for i, rules in enumerate(REPLY_RULES):
        out.append(f"r_{i} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in rules.items()) + f" FROM {prev})")
        prev = f"r_{i}"
    out.append(
        "long AS (SELECT r.run_id, r.prompt_id, s.model, r.lever, r.judge, s.label AS position, CASE WHEN call_error IS NULL AND problem IS NULL THEN "
        "CAST(CASE s.label WHEN 'A' THEN p0 WHEN 'B' THEN p1 WHEN 'C' THEN p2 ELSE p3 END AS DOUBLE) / 100 END AS score, "
        "CASE WHEN call_error IS NULL AND problem IS NULL AND s.label = 'A' THEN 'covers it' END AS reasoning, coalesce(call_error, problem) AS judge_error, "
        "CASE WHEN call_error IS NULL THEN cost_usd / 4 ELSE 0.0 END AS cost_usd, CASE WHEN call_error IS NULL THEN latency_ms ELSE 0 END AS latency_ms "
        f"FROM {prev} r JOIN slots s ON r.prompt_id = s.prompt_id AND r.lever = s.lever)")
    return ",\n".join([POSITIONS_SQL, *out])


REPLIES = _reply_sql()
PAIRS = (
    "pairs AS (SELECT *, abs(a - b) AS delta, coalesce(abs(a - b) > CAST(0.2 AS DOUBLE), false) AS dis, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END AS mid "
    "FROM (SELECT run_id, prompt_id, model, lever, max(CASE WHEN judge = 'judge-one' THEN score END) AS a, max(CASE WHEN judge = 'judge-two' THEN score END) AS b FROM long GROUP BY 1, 2, 3, 4))")


def scores(spark, sf) -> DataFrame:
    return judges.explode_judge_replies(replies(spark, sf))


def pairs(spark, sf) -> DataFrame:
    return judges.pair_and_flag(scores(spark, sf), *JUDGES)


@query("judge_replies", grid_sql(
    "SELECT judge, position, judge_error, count(*) AS n, count(score) AS n_scores, round(sum(score), 6) AS total, count(reasoning) AS n_reasons, round(sum(cost_usd), 9) AS cost_usd, "
    "CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM long GROUP BY 1, 2, 3", REPLIES))
def judge_replies(spark, sf):
    return scores(spark, sf).groupBy("judge", "position", "judge_error").agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scores"), F.round(F.sum("score"), 6).alias("total"), F.count("reasoning").alias("n_reasons"),
        F.round(F.sum("cost_usd"), 9).alias("cost_usd"), F.sum("latency_ms").alias("latency_ms"))


@query("judge_pairs", grid_sql(
    "SELECT model, lever, dis AS is_disagreement, count(*) AS n, round(sum(delta), 6) AS delta, round(sum(mid), 6) AS median_score FROM pairs GROUP BY 1, 2, 3", REPLIES, PAIRS))
def judge_pairs(spark, sf):
    return pairs(spark, sf).groupBy("model", "lever", "is_disagreement").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("delta"), 6).alias("delta"), F.round(F.sum("median_score"), 6).alias("median_score"))


@query("fresh_over_stored_scores", grid_sql(
    "SELECT model, lever, count(*) FILTER (WHERE abs(fa - fb) > CAST(0.2 AS DOUBLE)) AS n_flagged, round(sum(fa), 6) AS sum_a, round(sum(fb), 6) AS sum_b FROM (SELECT p.model, p.lever, "
    "coalesce(p.a, r.judge_a_score) AS fa, coalesce(p.b, r.judge_b_score) AS fb FROM pairs p LEFT JOIN results r ON p.prompt_id = r.prompt_id AND p.model = r.model "
    "AND p.lever = r.optimisation_lever AND p.run_id = r.run_id) GROUP BY 1, 2", REPLIES, PAIRS))
def fresh_over_stored_scores(spark, sf):
    stored = results(spark, sf).select("run_id", "prompt_id", "model", F.col("optimisation_lever").alias("lever"), "judge_a_score", "judge_b_score",
                                       F.lit(None).cast("string").alias("judge_a_reasoning"), F.lit(None).cast("string").alias("judge_b_reasoning"))
    df = judges.pair_and_flag(scores(spark, sf), *JUDGES, stored=stored)
    return df.groupBy("model", "lever").agg(F.count_if("is_disagreement").alias("n_flagged"), F.round(F.sum("judge_a_score"), 6).alias("sum_a"),
                                            F.round(F.sum("judge_b_score"), 6).alias("sum_b"))


@query("three_judge_agreement", """
WITH s AS (SELECT doc_id, lang, CASE WHEN doc_id % 11 <> 0 THEN CAST(n_chars % 21 AS DOUBLE) / 20 END AS a, CASE WHEN doc_id % 7 <> 0 THEN CAST((n_chars + doc_id) % 21 AS DOUBLE) / 20 END AS b,
 CASE WHEN doc_id % 5 <> 0 THEN CAST((n_chars * 3 + doc_id) % 21 AS DOUBLE) / 20 END AS c FROM documents),
l AS (SELECT doc_id, lang, v FROM s CROSS JOIN LATERAL (VALUES (a), (b), (c)) AS t(v) WHERE v IS NOT NULL),
m AS (SELECT doc_id, lang, count(*) AS n, median(v) AS med, max(v) - min(v) AS gap FROM l GROUP BY 1, 2),
d AS (SELECT m.doc_id, m.lang, med, CASE WHEN n < 2 THEN false WHEN n = 2 THEN gap > CAST(0.2 AS DOUBLE) ELSE (SELECT bool_or(abs(l.v - m.med) > CAST(0.2 AS DOUBLE)) FROM l WHERE l.doc_id = m.doc_id) END AS dis FROM m)
SELECT s.lang, count(*) AS n, count(*) FILTER (WHERE coalesce(dis, false)) AS n_disagree, count(med) AS n_scored, round(sum(med), 9) AS total FROM s LEFT JOIN d USING (doc_id) GROUP BY 1""")
def three_judge_agreement(spark, sf):
    rule = "CASE WHEN doc_id % {d} <> 0 THEN CAST(({e}) % 21 AS DOUBLE) / 20 END"
    s = [F.expr(rule.format(d=d, e=e)) for d, e in ((11, "n_chars"), (7, "n_chars + doc_id"), (5, "n_chars * 3 + doc_id"))]
    df = table(spark, sf, "documents").select("lang", S.is_disagreement(*s).alias("dis"), S.canonical_score(*s).alias("med"))
    return r9(df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("dis").alias("n_disagree"), F.count("med").alias("n_scored"), F.sum("med").alias("total")), "total")


@query("label_agreement", """
SELECT lang, count(*) AS n, count(*) FILTER (WHERE abs(q - CAST(1 - toxic AS DOUBLE)) > CAST(0.2 AS DOUBLE)) AS n_disagree, round(avg((q + 1 - toxic) / 2), 9) AS mean_score FROM
 (SELECT lang, CAST(quality AS DOUBLE) AS q, toxic FROM labels JOIN documents USING (doc_id)) GROUP BY 1""")
def label_agreement(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    q, t = F.col("quality").cast("double"), (1 - F.col("toxic")).cast("double")
    return r9(df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(S.is_disagreement(q, t)).alias("n_disagree"),
                                     F.avg(S.canonical_score(q, t)).alias("mean_score")), "mean_score")


# ---- cases --------------------------------------------------------------------------------------
def open_cases(spark, sf) -> DataFrame:
    """Case rows of the grid's flagged measurements; every seventh is already scored by a person."""
    done = (F.xxhash64("prompt_id") * 0 + F.length("response_text")) % 7 == 0
    return results(spark, sf).where(F.col("judge_disagreement_flag") == 1).select(
        "prompt_id", "model", F.col("optimisation_lever").alias("lever"), "judge_a_score", "judge_b_score", "response_text",
        F.when(done, F.lit("0.500")).otherwise(F.lit("")).alias("human_score"), F.lit("").alias("human_note"),
        F.when(done, F.lit("human")).otherwise(F.lit("")).alias("arbitration_method"))


CASES = (
    "cases AS (SELECT prompt_id, model, optimisation_lever AS lever, task_category, abs(judge_a_score - judge_b_score) AS delta, (judge_a_score + judge_b_score) / 2 AS mid, "
    "length(response_text) % 7 = 0 AS done FROM results WHERE judge_disagreement_flag = 1), "
    "resolved AS (SELECT *, CASE WHEN done THEN 'human' WHEN delta <= CAST(0.3 AS DOUBLE) THEN 'median_canonical_auto' ELSE '' END AS method, "
    "CASE WHEN done THEN 0.5 WHEN delta <= CAST(0.3 AS DOUBLE) THEN floor(mid * 1000 + CAST(0.5 AS DOUBLE)) / 1000 END AS human FROM cases)")


@query("auto_resolve", grid_sql(
    "SELECT method AS arbitration_method, lever, count(*) AS n, round(sum(human), 6) AS total FROM resolved GROUP BY 1, 2", CASES))
def auto_resolve(spark, sf):
    df = resolve.auto_resolve(open_cases(spark, sf))
    return df.groupBy("arbitration_method", "lever").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("human_score").try_cast("double")), 6).alias("total"))


@query("open_case_count", grid_sql("SELECT lever, count(*) AS n FROM resolved WHERE method = '' GROUP BY 1", CASES))
def open_case_count(spark, sf):
    return resolve.open_cases(open_cases(spark, sf)).groupBy("lever").agg(F.count(F.lit(1)).alias("n"))


@query("arbitration_methods", grid_sql("SELECT method AS arbitration_method, count(*) AS n FROM resolved GROUP BY 1", CASES))
def arbitration_methods(spark, sf):
    return audits.method_counts(resolve.auto_resolve(open_cases(spark, sf)))


_ORDER = "delta DESC, prompt_id, model, lever"


@query("arbitration_queue", grid_sql(
    f"SELECT prompt_id, model, lever, row_number() OVER (ORDER BY CASE WHEN lever = 'compression' THEN 0 ELSE 1 END, {_ORDER}) - 1 AS pos FROM cases", CASES))
def arbitration_queue(spark, sf):
    return resolve.arbitration_queue(open_cases(spark, sf)).select("prompt_id", "model", "lever", "pos")


@query("arbitration_by_category", grid_sql(
    f"SELECT prompt_id, model, lever, row_number() OVER (ORDER BY CASE task_category WHEN 'rag_qa' THEN 1 WHEN 'summarisation' THEN 2 ELSE 3 END, {_ORDER}) - 1 AS pos FROM cases", CASES))
def arbitration_by_category(spark, sf):
    return resolve.arbitration_queue(open_cases(spark, sf), "by-category", categories=["rag", "sum"]).select("prompt_id", "model", "lever", "pos")


@query("arbitration_cluster", grid_sql(
    f"SELECT prompt_id, model, lever, row_number() OVER (ORDER BY {_ORDER}) - 1 AS pos FROM cases WHERE task_category = 'rag_qa' AND lever = 'compression'", CASES))
def arbitration_cluster(spark, sf):
    return resolve.arbitration_queue(open_cases(spark, sf), "cluster", cluster="rag-compression").select("prompt_id", "model", "lever", "pos")


@query("shuffled_queue", grid_sql(
    "SELECT prompt_id, model, lever, row_number() OVER (ORDER BY sha256('7|' || prompt_id || '|' || model || '|' || lever)) - 1 AS pos FROM cases", CASES))
def shuffled_queue(spark, sf):
    return resolve.arbitration_queue(open_cases(spark, sf), "shuffle", seed=7).select("prompt_id", "model", "lever", "pos")


@query("resume_position", grid_sql(
    f"SELECT coalesce(min(pos) FILTER (WHERE NOT done), count(*)) AS resume_at FROM (SELECT done, row_number() OVER (ORDER BY CASE WHEN lever = 'compression' THEN 0 ELSE 1 END, {_ORDER}) - 1 AS pos FROM cases)", CASES))
def resume_position(spark, sf):
    return resolve.resume_position(resolve.arbitration_queue(open_cases(spark, sf)))


_CANON = ("canon AS (SELECT r.*, CASE WHEN judge_disagreement_flag = 0 THEN (judge_a_score + judge_b_score) / 2 ELSE coalesce(human, canonical_score) END AS score FROM results r LEFT JOIN resolved c "
          "ON r.prompt_id = c.prompt_id AND r.model = c.model AND r.optimisation_lever = c.lever)")


@query("canonical_scores", grid_sql(
    "SELECT task_category, optimisation_lever AS lever, judge_disagreement_flag AS flag, count(*) AS n, count(score) AS n_scored, round(sum(score), 6) AS total FROM canon GROUP BY 1, 2, 3", CASES, _CANON))
def canonical_scores(spark, sf):
    df, _ = resolve.populate_canonical(results(spark, sf), resolve.auto_resolve(open_cases(spark, sf)))
    return df.groupBy("task_category", F.col("optimisation_lever").alias("lever"), F.col("judge_disagreement_flag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), F.count("canonical_score").alias("n_scored"), F.round(F.sum("canonical_score"), 6).alias("total"))


@query("canonical_unmatched", grid_sql(
    "SELECT 'results' AS side, lever, count(*) AS n FROM resolved WHERE human IS NULL GROUP BY 2 UNION ALL "
    "SELECT 'cases', lever, count(*) FROM resolved WHERE human IS NOT NULL AND model LIKE 'gpt-5.4-mini%' GROUP BY 2",
    CASES))
def canonical_unmatched(spark, sf):
    """Open cases have no score yet; cases of one model have no flagged rows here."""
    cases = resolve.auto_resolve(open_cases(spark, sf))
    rows = results(spark, sf)
    without = rows.withColumn("judge_disagreement_flag", F.when(F.col("model") == "gpt-5.4-mini-2026-03-17", F.lit(0)).otherwise(F.col("judge_disagreement_flag")))
    _, missing = resolve.populate_canonical(without, cases)
    _, open_only = resolve.populate_canonical(rows, cases)
    n = lambda df, side: df.where(F.col("side") == side).groupBy("side", "lever").agg(F.count(F.lit(1)).alias("n"))
    return n(open_only, "results").unionByName(n(missing, "cases"))


@query("canonical_check", grid_sql(
    "SELECT count(*) AS n_total, count(*) FILTER (WHERE judge_a_score IS NOT NULL AND judge_b_score IS NOT NULL) AS n_tier2, count(*) FILTER (WHERE judge_a_score IS NOT NULL "
    "AND judge_b_score IS NOT NULL AND canonical_score IS NULL) AS n_tier2_null, count(canonical_score) AS n_populated, count(*) FILTER (WHERE canonical_score IS NULL) AS n_left_null FROM results"))
def canonical_check(spark, sf):
    return audits.canonical_check(results(spark, sf))


_STATS = ("count(*) AS n, min(canonical_score) AS min_score, max(canonical_score) AS max_score, round(avg(canonical_score), 9) AS mean_score, round(median(canonical_score), 9) AS median, "
          "round(stddev_samp(canonical_score), 9) AS stdev")


@query("canonical_stats", grid_sql(
    f"SELECT 'all' AS part, {_STATS} FROM results WHERE canonical_score IS NOT NULL UNION ALL SELECT CASE judge_disagreement_flag WHEN 1 THEN 'disagreement' ELSE 'agreement' END, "
    f"{_STATS} FROM results WHERE canonical_score IS NOT NULL GROUP BY judge_disagreement_flag"))
def canonical_stats(spark, sf):
    return r9(audits.canonical_stats(results(spark, sf)), "mean_score", "median", "stdev")


@query("score_histogram", grid_sql(
    "SELECT bucket, bucket / CAST(10 AS DOUBLE) AS low, (bucket + 1) / CAST(10 AS DOUBLE) AS high, n FROM (SELECT r.range AS bucket, count(b) AS n FROM range(10) r LEFT JOIN "
    "(SELECT least(CAST(floor(canonical_score * 10) AS BIGINT), 9) AS b FROM results WHERE canonical_score IS NOT NULL) ON b = r.range GROUP BY 1)"))
def score_histogram(spark, sf):
    return audits.histogram(results(spark, sf), "canonical_score")


# ---- audits of the judges ------------------------------------------------------------------------
@query("judge_summary", grid_sql(
    "SELECT judge, count(*) AS n_scored, count(judge_error) AS n_errors, round(sum(cost_usd), 6) AS cost_usd, round(sum(cost_usd) / CAST(1.27 AS DOUBLE), 6) AS cost_gbp, "
    "max(latency_ms) FILTER (WHERE rn = n // 2) AS p50_ms, max(latency_ms) FILTER (WHERE rn = CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT)) AS p95_ms FROM (SELECT *, "
    "row_number() OVER (PARTITION BY judge ORDER BY latency_ms) - 1 AS rn, count(*) OVER (PARTITION BY judge) AS n FROM long) GROUP BY 1", REPLIES))
def judge_summary(spark, sf):
    df = audits.judge_summary(scores(spark, sf))
    return df.select("judge", "n_scored", "n_errors", F.round("cost_usd", 6).alias("cost_usd"), F.round("cost_gbp", 6).alias("cost_gbp"), "p50_ms", "p95_ms")


@query("score_range", grid_sql(
    "SELECT count(*) AS n, count(*) FILTER (WHERE score BETWEEN 0 AND 1) AS n_in_range, min(score) AS min_score, max(score) AS max_score, round(avg(score), 9) AS mean_score FROM long WHERE score IS NOT NULL", REPLIES))
def score_range(spark, sf):
    return r9(audits.score_range(scores(spark, sf)), "mean_score")


@query("score_buckets", grid_sql(
    "SELECT bucket, n, round(100.0::DOUBLE * n / sum(n) OVER (), 9) AS pct FROM (SELECT CASE WHEN score = 1 THEN '1.00' WHEN score >= CAST(0.8 AS DOUBLE) THEN '0.80–0.99' "
    "WHEN score >= CAST(0.6 AS DOUBLE) THEN '0.60–0.79' WHEN score >= CAST(0.4 AS DOUBLE) THEN '0.40–0.59' WHEN score >= CAST(0.2 AS DOUBLE) THEN '0.20–0.39' ELSE '0.00–0.19' END AS bucket, count(*) AS n "
    "FROM long WHERE score IS NOT NULL GROUP BY 1)", REPLIES))
def score_buckets(spark, sf):
    return r9(audits.score_buckets(scores(spark, sf)), "pct")


@query("disagreement_summary", grid_sql(
    "SELECT count(*) AS n_pairs, count(delta) AS n_complete, count(*) FILTER (WHERE dis) AS n_disagree, round(100.0::DOUBLE * count(*) FILTER (WHERE dis) / count(delta), 9) AS disagree_pct FROM pairs", REPLIES, PAIRS))
def disagreement_summary(spark, sf):
    return r9(audits.disagreement_summary(pairs(spark, sf)), "disagree_pct")


@query("calibration", grid_sql(
    "SELECT family, round(ma, 9) AS mean_a, n_a, round(mb, 9) AS mean_b, n_b, round(ma - mb, 9) AS delta, abs(ma - mb) > CAST(0.05 AS DOUBLE) AS flagged FROM (SELECT CASE WHEN model LIKE 'claude%' THEN 'Anthropic' "
    "ELSE 'OpenAI' END AS family, avg(a) AS ma, count(a) AS n_a, avg(b) AS mb, count(b) AS n_b FROM pairs GROUP BY 1)", REPLIES, PAIRS))
def calibration(spark, sf):
    return r9(audits.calibration(pairs(spark, sf)), "mean_a", "mean_b", "delta")


_BIAS = (
    "slot AS (SELECT judge, model, position, avg(score) AS slot_mean, count(*) AS n FROM long WHERE score IS NOT NULL GROUP BY 1, 2, 3 UNION ALL "
    "SELECT 'pooled', model, position, avg(score), count(*) FROM long WHERE score IS NOT NULL GROUP BY 2, 3)")


@query("position_bias", grid_sql(
    "SELECT judge, model, position, n, round(slot_mean, 9) AS slot_mean, round(row_mean, 9) AS row_mean, round(slot_mean - row_mean, 9) AS deviation, abs(slot_mean - row_mean) > CAST(0.03 AS DOUBLE) AS flagged "
    "FROM (SELECT *, avg(slot_mean) OVER (PARTITION BY judge, model) AS row_mean FROM slot)", REPLIES, _BIAS))
def position_bias(spark, sf):
    return r9(audits.position_bias(scores(spark, sf)), "slot_mean", "row_mean", "deviation")


@query("missing_judge_sides", grid_sql(
    "SELECT missing_a, missing_b, skip_a, skip_b, count(*) AS n FROM (SELECT bool_or(judge_a_score IS NULL) AS missing_a, bool_or(judge_b_score IS NULL) AS missing_b, NOT bool_or(judge_a_score IS NULL) AS skip_a, "
    "NOT bool_or(judge_b_score IS NULL) AS skip_b FROM results WHERE task_category <> 'extraction' GROUP BY run_id, prompt_id, optimisation_lever HAVING count(DISTINCT model) >= 4) WHERE missing_a OR missing_b GROUP BY 1, 2, 3, 4"))
def missing_judge_sides(spark, sf):
    return judges.missing_sides(results(spark, sf)).groupBy("missing_a", "missing_b", "skip_a", "skip_b").agg(F.count(F.lit(1)).alias("n"))


@query("flagged_groups", grid_sql("SELECT lever, count(*) AS n FROM (SELECT DISTINCT run_id, prompt_id, optimisation_lever AS lever FROM results WHERE judge_disagreement_flag = 1) GROUP BY 1"))
def flagged_groups(spark, sf):
    return judges.flagged_groups(results(spark, sf)).groupBy("lever").agg(F.count(F.lit(1)).alias("n"))


@query("spot_check", grid_sql(
    "SELECT prompt_id, model, optimisation_lever, canonical_score, (judge_a_score + judge_b_score) / 2 AS expected_score, abs(canonical_score - (judge_a_score + judge_b_score) / 2) < CAST(1e-9 AS DOUBLE) AS ok "
    "FROM results WHERE judge_disagreement_flag = 0 AND judge_a_score IS NOT NULL AND judge_b_score IS NOT NULL ORDER BY sha256('3|' || result_id), result_id LIMIT 5"))
def spot_check(spark, sf):
    """Five rows in the order of a seeded hash."""
    return audits.spot_check(results(spark, sf), 5, seed=3).select("prompt_id", "model", "optimisation_lever", "canonical_score", "expected_score", "ok")
