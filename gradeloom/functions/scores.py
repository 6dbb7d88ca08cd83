"""Judge-score arithmetic, money and hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from gradeloom import constants as K


def _present(scores: list[Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*[s.cast("double") for s in scores])))


def _median(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    upper = F.try_element_at(sorted_values, F.floor(n / 2).cast("int") + 1)
    lower = F.try_element_at(sorted_values, F.floor((n - 1) / 2).cast("int") + 1)
    return F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, upper).otherwise((lower + upper) / 2)


def canonical_score(*scores: Column) -> Column:
    """Median of the scores that exist, NULL if none does."""
    return _median(_present(list(scores)))


def is_disagreement(*scores: Column, threshold: float = K.DISAGREEMENT_THRESHOLD) -> Column:
    """Two scores: gap above the threshold.  Three or more: any score that far from the median."""
    limit = F.lit(float(threshold))
    if len(scores) == 2:
        a, b = (s.cast("double") for s in scores)
        return F.coalesce(F.abs(a - b) > limit, F.lit(False))
    values = _present(list(scores))
    middle = _median(values)
    two = F.abs(F.try_element_at(values, F.lit(1)) - F.try_element_at(values, F.lit(2))) > limit
    many = F.exists(values, lambda s: F.abs(s - middle) > limit)
    return F.when(F.size(values) < 2, F.lit(False)).when(F.size(values) == 2, two).otherwise(many)


def mean_of_both(a: Column, b: Column) -> Column:
    """Mean of a pair; NULL if either is missing."""
    return (a + b) / F.lit(2.0)


def token_cost(in_rate: Column, out_rate: Column, read_mult: Column, create_mult: Column,
               input_tokens: Column, output_tokens: Column, cached_tokens: Column, created_tokens: Column,
               is_batch: Column) -> Column:
    """USD of one call; ``input_tokens`` excludes cached ones."""
    parts = [
        input_tokens * in_rate,
        cached_tokens * in_rate * read_mult,
        created_tokens * in_rate * create_mult,
        output_tokens * out_rate,
    ]
    base = reduce(lambda x, y: x + y, parts) / F.lit(1_000_000.0)
    return base * F.when(is_batch, F.lit(K.BATCH_DISCOUNT)).otherwise(F.lit(1.0))


def to_gbp(usd: Column, rate: float = K.GBP_USD_RATE) -> Column:
    return usd / F.lit(float(rate))


def input_token_estimate(text: Column) -> Column:
    """Four characters a token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def output_token_estimate(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.OUTPUT_TOKEN_ESTIMATES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, category), F.lit(K.OUTPUT_TOKEN_ESTIMATE_DEFAULT)).cast("long")


def cache_min_tokens(model: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.CACHE_MIN_TOKENS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, model), F.lit(K.CACHE_MIN_TOKENS_DEFAULT)).cast("long")


def position_seed(prompt_id: Column, lever: Column) -> Column:
    """First 32 bits of sha256 of ``prompt_id|lever``."""
    digest = F.sha2(F.concat_ws("|", prompt_id, lever), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def config_hash(lever: Column, config: Column) -> Column:
    """Stable key of a lever and its configuration (JSON text or NULL).

    The configuration is parsed and rewritten first, so key order and spacing do not matter.  One
    that is no JSON counts as the text it is.
    """
    body = F.coalesce(F.to_json(F.try_parse_json(config)), config, F.lit("{}"))
    payload = F.concat(F.lit('{"config": '), body, F.lit(', "lever": "'), lever, F.lit('"}'))
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(payload, 256), 1, 16))


def valid_score(text: Column) -> Column:
    """Score text as a number in [0, 1], else NULL."""
    value = F.btrim(text, F.lit(K.WHITESPACE)).try_cast("double")
    return F.when(value.between(0.0, 1.0), value)


def budget_tier(cap: Column, spent: Column) -> Column:
    """Tier by the share of the cap that is left."""
    share = F.when(cap > 0, (cap - spent) / cap).otherwise(F.lit(0.0))
    out = None
    for floor, tier, _ in K.BUDGET_TIERS:
        out = F.when(share > floor, F.lit(tier)) if out is None else out.when(share > floor, F.lit(tier))
    return out.otherwise(F.lit(K.BUDGET_TIER_DEFAULT))


def budget_tier_size(tier: Column) -> Column:
    out = F.lit(None).cast("long")
    for _, name, size in K.BUDGET_TIERS:
        out = F.when(tier == name, F.lit(size).cast("long")).otherwise(out)
    return F.when(tier == K.BUDGET_TIER_DEFAULT, F.lit(0).cast("long")).otherwise(out)


def annotate_config(config: Column, model: Column) -> Column:
    """Add the default reasoning effort to the configuration of models whose family has one."""
    base = F.coalesce(F.from_json(config, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    extra = F.create_map(F.lit("reasoning_effort"), F.lit("medium").cast("variant"))
    kept = F.map_filter(base, lambda k, v: k != "reasoning_effort")
    return F.when(model.startswith("gpt-5.4"), F.to_json(F.map_concat(kept, extra))).otherwise(config)


def count_reference_model(model: Column, default: str = "claude-sonnet-4-6") -> Column:
    """Model whose tokenizer counts the tokens: the model itself for one family, else a fixed one."""
    return F.when(model.startswith("claude-"), model).otherwise(F.lit(default))
