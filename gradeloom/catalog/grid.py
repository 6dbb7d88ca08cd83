"""Measurement grid derived from the ``orders`` table: every order is a prompt, answered by four
models under four levers.

The column rules below are plain SQL expressions that Spark and DuckDB read alike, so the
DataFrame and the SQL twin are built from the same text.  ``outcome`` is the known answer of
the scorer for the response the rules write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom import constants as K

MODELS = [(i, m, "anthropic" if m.startswith("claude") else "openai") for i, m in enumerate(K.TEST_MODELS)]
LEVERS = list(enumerate(K.LEVERS))
_RATE = {m: (i, o) for m, i, o, _, _ in K.PRICES}


def _case(column: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


# ---- one row per order: the prompt ---------------------------------------------------------------
PROMPT_RULES = {
    "ok": "o_orderkey",
    "task_category": "CASE o_orderpriority WHEN '1-URGENT' THEN 'customer_support' WHEN '2-HIGH' THEN 'rag_qa' "
                     "WHEN '3-MEDIUM' THEN 'reasoning' WHEN '4-NOT SPECIFIED' THEN 'summarisation' "
                     "ELSE 'extraction' END",
    "complexity": "CASE o_orderstatus WHEN 'O' THEN 'easy' WHEN 'F' THEN 'medium' ELSE 'hard' END",
    "in0": "200 + CAST(floor(o_totalprice) AS BIGINT) % 3000",
}
PROMPT_MORE = [
    {
        "prompt_id": _case("task_category", {
            "customer_support": "'cs-'", "rag_qa": "'rag-'", "reasoning": "'rea-'", "summarisation": "'sum-'",
        }, "'ext-'") + " || CAST(ok AS STRING)",
        "label": "CASE ok % 5 WHEN 0 THEN 'billing' WHEN 1 THEN 'technical' WHEN 2 THEN 'feature_request' "
                 "WHEN 3 THEN 'complaint' ELSE 'other' END",
        "num": "CAST(ok % 900 + 100 AS STRING)",
        "hour": "ok % 12",
        "minute": "lpad(CAST(ok % 60 AS STRING), 2, '0')",
    },
    {
        # the answer a prompt expects, and an equal answer written differently
        "want": "CASE task_category WHEN 'customer_support' THEN label "
                "WHEN 'rag_qa' THEN CASE WHEN ok % 4 = 0 THEN 'A pool size of ' || num || "
                "' connections that degraded for six hours' ELSE 'Code ' || num END "
                "WHEN 'reasoning' THEN CASE ok % 4 WHEN 0 THEN '£' || num || '.00' "
                "WHEN 1 THEN CAST(hour + 12 AS STRING) || ':' || minute WHEN 2 THEN 'Eligible' "
                "ELSE 'Greendot, £' || num || '.50' END ELSE 'Customer ' || num END",
        "said": "CASE task_category WHEN 'customer_support' THEN label "
                "WHEN 'rag_qa' THEN 'The answer is  code ' || num || ', as stated.' "
                "WHEN 'reasoning' THEN CASE ok % 4 WHEN 0 THEN num || ' gbp' "
                "WHEN 1 THEN CASE WHEN hour = 0 THEN '12' ELSE CAST(hour AS STRING) END || ':' || minute || ' PM' "
                "WHEN 2 THEN 'eligible.' ELSE ' greendot , £' || num || '.5' END ELSE ' customer  ' || num END",
    },
    {
        "expected": "CASE task_category WHEN 'customer_support' THEN '{\"category\": \"' || want || '\"}' "
                    "WHEN 'rag_qa' THEN '{\"answer\": \"' || want || '\", \"supporting_sentences\": [' || "
                    "CAST(ok % 9 + 2 AS STRING) || ', 1]}' "
                    "WHEN 'reasoning' THEN '{\"final_answer\": \"' || want || '\"}' "
                    "WHEN 'extraction' THEN '{\"name\": \"' || want || '\", \"amount\": ' || num || '.5, \"seats\": 6, "
                    "\"active\": true, \"tags\": [\"a\", \"b\"]}' END",
        "criteria": "CASE WHEN task_category <> 'extraction' THEN 'Covers ' || want || ' without promises.' END",
        "system_text": "'You answer ' || task_category || ' tasks.'",
        "user_text": "'Task ' || CAST(ok AS STRING) || ': please handle case ' || num || '.'",
    },
]

# ---- one row per (prompt, model, lever): the measurement -----------------------------------------
MEASURE_RULES = [
    {
        "h1": "(ok * 7919 + mi * 104729 + li * 1299709) % 1009",
        "h2": "(ok * 6101 + mi * 15485863 + li * 32452843) % 1013",
    },
    {
        "kind": "h2 % 10",
        "output_tokens": "CASE WHEN lever = 'output_cap' THEN least(50 + h1 % 400, 200) ELSE 50 + h1 % 400 END",
        "original_tokens": "in0",
        "compressed_tokens": "CASE WHEN h1 % 37 = 0 THEN in0 + h1 % 5 ELSE CAST(floor(in0 * 55 / 100) AS BIGINT) END",
        "cached_tokens": "CASE WHEN lever = 'baseline' AND h2 % 97 = 0 THEN 1024 ELSE 0 END",
        "latency_ms": "CASE WHEN lever = 'batch' THEN 0 ELSE 300 + (h2 * 7) % 5000 END",
        "error": "CASE WHEN h1 % 251 = 0 THEN 'RateLimitError' END",
        "judge_a_score": "CASE WHEN task_category <> 'extraction' AND h1 % 199 <> 0 "
                         "THEN CAST(h1 % 21 AS DOUBLE) / 20 END",
        "judge_b_score": "CASE WHEN task_category <> 'extraction' AND h2 % 193 <> 0 "
                         "THEN CAST(greatest(0, least(20, h1 % 21 + h2 % 13 - 6)) AS DOUBLE) / 20 END",
    },
    {
        "input_tokens": "CASE WHEN lever = 'compression' THEN compressed_tokens ELSE in0 END",
        "optimisation_config": "CASE WHEN lever = 'compression' THEN '{\"original_input_tokens\": ' || "
                               "CAST(original_tokens AS STRING) || ', \"compressed_input_tokens\": ' || "
                               "CAST(compressed_tokens AS STRING) || CASE WHEN compressed_tokens >= original_tokens "
                               "THEN ', \"compression_status\": \"unavailable\"}' ELSE '}' END "
                               "WHEN h1 % 101 = 1 THEN '{\"experimental_comparison\": true}' END",
        "good": "CASE task_category WHEN 'customer_support' THEN '{\"category\": \"' || said || "
                "'\", \"reply\": \"We will look into it.\"}' "
                "WHEN 'rag_qa' THEN '{\"answer\": \"' || said || '\", \"supporting_sentences\": [1, ' || "
                "CAST(ok % 9 + 2 AS STRING) || ']}' "
                "WHEN 'reasoning' THEN '{\"reasoning\": \"worked out\", \"final_answer\": \"' || said || '\"}' "
                "ELSE '{\"name\": \"' || said || '\", \"amount\": ' || num || '.50, \"seats\": 6, \"active\": true, "
                "\"tags\": [\"B\", \"a\"]}' END",
        "wrong": "CASE task_category WHEN 'customer_support' THEN '{\"category\": \"unknown_label\"}' "
                 "WHEN 'rag_qa' THEN '{\"answer\": \"' || said || '\", \"supporting_sentences\": [77]}' "
                 "WHEN 'reasoning' THEN '{\"final_answer\": \"£1.00 or so\"}' "
                 "ELSE '{\"name\": \"Nobody\", \"amount\": ' || num || '.50, \"seats\": 6, \"active\": true, "
                 "\"tags\": [\"a\", \"a\"]}' END",
        "shapeless": "CASE task_category WHEN 'customer_support' THEN '{\"label\": \"' || said || '\"}' "
                     "WHEN 'rag_qa' THEN '{\"answer\": \"' || said || '\", \"supporting_sentences\": [\"1\"]}' "
                     "WHEN 'reasoning' THEN '{\"final_answer\": 12}' "
                     "ELSE '{\"name\": \"' || said || '\", \"amount\": ' || num || '.50, \"seats\": 6, \"active\": 1, "
                     "\"tags\": [\"a\", \"b\"]}' END",
    },
    {
        "response_text": "CASE WHEN task_category = 'summarisation' THEN CASE WHEN kind = 0 THEN ' ' ELSE '' END || "
                         "'Summary of case ' || num || '.' || chr(10) || 'Second line.' ELSE "
                         "CASE kind WHEN 0 THEN good "
                         "WHEN 1 THEN '```json' || chr(10) || good || chr(10) || '```' "
                         "WHEN 2 THEN 'Step 1: think.' || chr(10) || good "
                         "WHEN 3 THEN '{\"result\": ' || good || '}' "
                         "WHEN 4 THEN wrong WHEN 5 THEN shapeless "
                         "WHEN 6 THEN substr(good, 1, CAST(length(good) AS INT) - 2) "
                         "WHEN 7 THEN '  ' || good || chr(10) "
                         "WHEN 8 THEN translate(good, '\"', '“') "
                         "ELSE good || '}' END END",
        "outcome": "CASE WHEN error IS NOT NULL THEN 'error' "
                   "WHEN lever = 'compression' AND compressed_tokens >= original_tokens THEN 'compression_unavailable' "
                   "WHEN task_category = 'summarisation' THEN 'not_applicable' "
                   "WHEN kind = 4 THEN 'fail_content' WHEN kind = 5 THEN 'fail_schema' "
                   "WHEN kind IN (6, 9) THEN CASE WHEN lever = 'output_cap' AND output_tokens >= 200 "
                   "THEN 'truncated' ELSE 'fail_format' END ELSE 'pass' END",
        "in_rate": "CAST(" + _case("model", {m: _RATE[m][0] for m in K.TEST_MODELS}) + " AS DOUBLE)",
        "out_rate": "CAST(" + _case("model", {m: _RATE[m][1] for m in K.TEST_MODELS}) + " AS DOUBLE)",
    },
    {
        "result_id": "prompt_id || '|' || model || '|' || lever",
        "run_id": "'run-' || CAST(ok % 4 AS STRING)",
        "cost_usd": "(input_tokens * in_rate + cached_tokens * in_rate * CAST(0.1 AS DOUBLE) + output_tokens * out_rate) "
                    "/ CAST(1000000 AS DOUBLE) * CASE WHEN lever = 'batch' THEN CAST(0.5 AS DOUBLE) "
                    "ELSE CAST(1 AS DOUBLE) END",
        "flag": "CASE WHEN abs(judge_a_score - judge_b_score) > CAST(0.2 AS DOUBLE) THEN 1 ELSE 0 END",
    },
    {
        # both judges agree: their mean; otherwise the midpoint as arbitration stores it
        "canonical_score": "CASE WHEN flag = 0 THEN (judge_a_score + judge_b_score) / 2 ELSE "
                           "floor((judge_a_score + judge_b_score) / 2 * 1000 + CAST(0.5 AS DOUBLE)) / 1000 END",
    },
]

RESULT_COLUMNS = {
    "result_id": "result_id", "run_id": "run_id", "ts": "ts", "run_attempt": "CAST(1 AS BIGINT)",
    "prompt_id": "prompt_id", "task_category": "task_category", "complexity": "complexity", "model": "model",
    "provider": "provider", "optimisation_lever": "lever", "optimisation_config": "optimisation_config",
    "config_hash": "'h-' || lever", "input_tokens": "CAST(input_tokens AS BIGINT)",
    "output_tokens": "CAST(output_tokens AS BIGINT)", "cached_tokens": "CAST(cached_tokens AS BIGINT)",
    "cache_creation_tokens": "CAST(0 AS BIGINT)", "latency_ms": "CAST(latency_ms AS BIGINT)", "cost_usd": "cost_usd",
    "response_text": "response_text", "judge_a_score": "judge_a_score", "judge_b_score": "judge_b_score",
    "judge_disagreement_flag": "CAST(flag AS BIGINT)", "canonical_score": "canonical_score",
    "tier_1_status": "outcome", "error": "error",
}
PROMPT_COLUMNS = ["prompt_id", "task_category", "complexity", "system_text", "user_text", "expected", "criteria"]


# ---- Spark side ----------------------------------------------------------------------------------
#: Folders of grids that ``store`` has written, by folder of the given tables.
_STORED: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Read one of the given tables."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def store(spark: SparkSession, sf: str, path: str) -> None:
    """Write the grid once; queries over ``sf`` then read it instead of deriving it from the orders each time."""
    parts = spark.sparkContext.defaultParallelism
    _STORED.pop(sf, None)
    _prompt_frame(spark, sf).repartition(4 * parts).write.parquet(f"{path}/frame")
    wide(spark, sf).repartition(4 * parts).write.parquet(f"{path}/wide")
    _STORED[sf] = path


def _prompt_frame(spark: SparkSession, sf: str) -> DataFrame:
    if sf in _STORED:
        return spark.read.parquet(f"{_STORED[sf]}/frame")
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
    df = df.selectExpr(
        *[f"{e} AS {c}" for c, e in PROMPT_RULES.items()], "CAST(o_orderdate AS TIMESTAMP) AS ts")
    for rules in PROMPT_MORE:
        df = df.withColumns({c: F.expr(e) for c, e in rules.items()})
    return df


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return _prompt_frame(spark, sf).select(*PROMPT_COLUMNS)


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule column of the measurement grid."""
    if sf in _STORED:
        return spark.read.parquet(f"{_STORED[sf]}/wide")
    models = F.array(*[F.struct(F.lit(i).cast("long").alias("mi"), F.lit(m).alias("model"), F.lit(p).alias("provider"))
                       for i, m, p in MODELS])
    levers = F.array(*[F.struct(F.lit(i).cast("long").alias("li"), F.lit(lv).alias("lever")) for i, lv in LEVERS])
    df = _prompt_frame(spark, sf).withColumn("_m", F.explode(models)).withColumn("_l", F.explode(levers))
    df = df.select("*", "_m.*", "_l.*").drop("_m", "_l")
    for rules in MEASURE_RULES:
        df = df.withColumns({c: F.expr(e) for c, e in rules.items()})
    return df


def results(spark: SparkSession, sf: str) -> DataFrame:
    """The measurement table, one row per (prompt, model, lever)."""
    return wide(spark, sf).selectExpr(*[f"{e} AS {c}" for c, e in RESULT_COLUMNS.items()])


# ---- SQL side ------------------------------------------------------------------------------------
def _layers(first: str, source: str, layers: list[dict]) -> str:
    out, prev = [], source
    for i, rules in enumerate(layers):
        name = f"{first}{i}"
        out.append(f"{name} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in rules.items()) + f" FROM {prev})")
        prev = name
    return ",\n".join(out), prev


def _sql() -> str:
    base = "p_base AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in PROMPT_RULES.items()) + ", o_orderdate AS ts FROM orders)"
    p_layers, p_last = _layers("p_", "p_base", PROMPT_MORE)
    prompts_cte = f"prompts AS (SELECT {', '.join(PROMPT_COLUMNS)} FROM {p_last})"
    models = ", ".join(f"({i}, '{m}', '{p}')" for i, m, p in MODELS)
    levers = ", ".join(f"({i}, '{lv}')" for i, lv in LEVERS)
    grid = (f"grid AS (SELECT * FROM {p_last} CROSS JOIN (VALUES {models}) AS m(mi, model, provider) "
            f"CROSS JOIN (VALUES {levers}) AS l(li, lever))")
    g_layers, g_last = _layers("g_", "grid", MEASURE_RULES)
    res = "results AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RESULT_COLUMNS.items()) + f" FROM {g_last})"
    return "WITH " + ",\n".join([base, p_layers, prompts_cte, grid, g_layers, f"wide AS (SELECT * FROM {g_last})", res])


GRID_SQL = _sql()


def grid_sql(body: str, *ctes: str) -> str:
    """SQL text over the CTEs ``prompts``, ``wide`` and ``results``, plus any further CTEs."""
    return GRID_SQL + "".join(",\n" + c for c in ctes) + "\n" + body
