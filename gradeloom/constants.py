"""Values fixed by the evaluation method.  Pass your own where a function takes a parameter."""

# ---- fixed values: categories, levers, statuses -------------------------------------------------
CATEGORIES = ["customer_support", "rag_qa", "extraction", "summarisation", "reasoning"]
JUDGED_CATEGORIES = ["customer_support", "rag_qa", "reasoning", "summarisation"]
COMPLEXITIES = ["easy", "medium", "hard"]
LEVERS = ["baseline", "batch", "compression", "output_cap"]
STATUSES = [
    "pass", "fail_format", "fail_schema", "fail_content",
    "truncated", "compression_unavailable", "error", "not_applicable",
]
APPLICABLE_STATUSES = ["pass", "fail_format", "fail_content", "truncated"]
FAILURE_STATUSES = ["fail_format", "fail_schema", "fail_content", "truncated"]
LIVE_JOB_STATUSES = ["submitted", "in_progress", "completed"]
OPEN_JOB_STATUSES = ["submitted", "in_progress"]
PREFIX_CATEGORY = {"cs": "customer_support", "rag": "rag_qa", "rea": "reasoning", "sum": "summarisation"}
GLOBAL_LEVER_ORDER = ["baseline", "batch", "output_cap", "compression"]
EXPECTED_PHASES = [
    "day_7", "batch_submit", "baseline", "caching", "output_cap",
    "day_8", "batch_retrieve", "compression_decide", "compression_run",
]
POSITION_LABELS = ["A", "B", "C", "D"]

# ---- fixed values: models and prices (USD per million tokens) -----------------------------------
TEST_MODELS = ["claude-sonnet-4-6", "claude-haiku-4-5", "gpt-5.4-2026-03-05", "gpt-5.4-mini-2026-03-17"]
# model, input, output, cache read multiplier, cache creation multiplier
PRICES = [
    ("claude-sonnet-4-6", 3.00, 15.00, 0.10, 1.25),
    ("claude-haiku-4-5", 1.00, 5.00, 0.10, 1.25),
    ("gpt-5.4", 2.50, 15.00, 0.10, 1.00),
    ("gpt-5.4-2026-03-05", 2.50, 15.00, 0.10, 1.00),
    ("gpt-5.4-mini", 0.75, 4.50, 0.10, 1.00),
    ("gpt-5.4-mini-2026-03-17", 0.75, 4.50, 0.10, 1.00),
    ("claude-opus-4-6", 15.00, 75.00, 0.10, 1.25),
    ("mistral-large-2512", 2.00, 6.00, 1.00, 1.00),
    ("gemini-2.5-pro", 1.25, 10.00, 0.10, 1.00),
    ("gpt-5.5", 5.00, 30.00, 0.10, 1.00),
]
CACHE_MIN_TOKENS = {
    "claude-sonnet-4-6": 2048, "claude-haiku-4-5": 4096, "claude-opus-4-6": 4096,
    "gpt-5.4": 1024, "gpt-5.4-2026-03-05": 1024, "gpt-5.4-mini": 1024, "gpt-5.4-mini-2026-03-17": 1024,
}
CACHE_MIN_TOKENS_DEFAULT = 1_000_000
OUTPUT_TOKEN_ESTIMATES = {
    "customer_support": 200, "extraction": 300, "rag_qa": 200, "summarisation": 400, "reasoning": 600,
}
OUTPUT_TOKEN_ESTIMATE_DEFAULT = 500
GBP_USD_RATE = 1.27
BATCH_DISCOUNT = 0.5
PROVIDER_BY_PREFIX = {"claude": "Anthropic", "gpt": "OpenAI"}
PROVIDER_DEFAULT = "Other"
FRIENDLY_NAMES = {
    "claude-sonnet-4-6": "sonnet", "claude-haiku-4-5": "haiku",
    "gpt-5.4-2026-03-05": "gpt-5.4", "gpt-5.4-mini-2026-03-17": "gpt-5.4-mini",
}

# ---- fixed values: thresholds -------------------------------------------------------------------
OUTPUT_CAP_TOKENS = 200
SHORT_ANSWER_WORDS = 3
PHRASAL_ANSWER_WORDS = 7
FLOAT_TOLERANCE = 0.005
DISAGREEMENT_THRESHOLD = 0.2
AUTO_RESOLVE_DELTA = 0.3
NEAR_BEST_FRACTION = 0.90
SELF_BIAS_FLAG = 0.05
POSITION_BIAS_FLAG = 0.03
SPEND_TOLERANCE_GBP = 0.001
JOB_TIMEOUT_SECONDS = 1800
CACHE_LIFETIME_SECONDS = 300
# headroom share of the cap that must be exceeded -> tier, subset size (None: all prompts)
BUDGET_TIERS = [(0.60, "full", None), (0.40, "60-subset", 60), (0.27, "30-subset", 30), (0.13, "operator-call", 15)]
BUDGET_TIER_DEFAULT = "skip"

# ---- fixed values: text rules -------------------------------------------------------------------
SUPPORT_LABELS = ["billing", "technical", "feature_request", "complaint", "other"]
UNWRAP_KEYS = ["result", "output", "response", "data"]
FENCE_PATTERN = r"(?s)^```(?:json|JSON|json5)?\s*\n(.*?)\n```\s*$"
JUDGE_FENCE_PATTERN = r"(?s)^```(?:json|JSON)?\s*\n(.*?)\n```\s*$"
TIME_PATTERN = r"^\s*(\d{1,2}):(\d{2})(?::\d{2})?\s*(am|pm|AM|PM)?\s*$"
CURRENCY_PATTERN = r"^\s*([£$€])?\s*(-?\d[\d,]*(?:\.\d+)?)\s*([A-Za-z]{3})?\s*$"
CURRENCY_SYMBOLS = {"GBP": "£", "USD": "$", "EUR": "€"}
SMART_QUOTES, PLAIN_QUOTES = "“”‘’", "\"\"''"
DATE_SUFFIX_PATTERN = r"-\d{4}-\d{2}-\d{2}$"
# every character a whitespace strip removes
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NEWLINE_MARK = "⏎"
JUDGE_SECTIONS = {
    "task": "=== TASK PROMPT ===",
    "reference": "=== REFERENCE ANSWER ===",
    "criteria": "=== EVALUATION CRITERIA ===",
    "candidates": "=== CANDIDATE RESPONSES ===",
    "closing": (
        "=== YOUR TASK ===\nScore each of A, B, C, D on the 0.0–1.0 scale against the criteria. "
        "Output the JSON object as specified."
    ),
}
REFERENCE_FIELD = {"rag_qa": "answer", "reasoning": "final_answer"}
CASE_COLUMNS = [
    "prompt_id", "model", "lever", "judge_a_score", "judge_b_score", "delta", "tier_2_criteria",
    "response_text", "human_score", "judge_a_reasoning", "judge_b_reasoning", "human_note", "arbitration_method",
]
AUTO_METHOD = "median_canonical_auto"
RESULT_KEY = ["prompt_id", "model", "optimisation_lever", "config_hash", "run_attempt", "run_id"]
