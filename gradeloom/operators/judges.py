"""Judge panel: blind positions, requests, replies, paired scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom import constants as K
from gradeloom.functions import jsonvalues as J, scores as S, text as T
from gradeloom.operators.cells import judgeable
from gradeloom.session import pinned

GROUP = ["run_id", "prompt_id", "lever"]


def _slots(prompt_id: Column, lever: Column, models: list[str]) -> Column:
    """Models in blind order: by the hash of (prompt, lever, model), so input order cannot matter."""
    keyed = F.array(*[
        F.struct(F.sha2(F.concat_ws("|", prompt_id, lever, F.lit(m)), 256).alias("h"), F.lit(m).alias("m"))
        for m in sorted(models)])
    return F.transform(F.array_sort(keyed), lambda x: x["m"])


def position_map(groups: DataFrame, models: list[str] = K.TEST_MODELS) -> DataFrame:
    """Add ``seed`` and ``position_to_model`` (label -> model) to (prompt_id, lever) groups.

    Deterministic, the same for every judge, independent of the order of ``models``, balanced
    over prompts.
    """
    if len(models) != len(K.POSITION_LABELS):
        raise ValueError(f"exactly {len(K.POSITION_LABELS)} models are needed, got {len(models)}")
    labels = F.array(*map(F.lit, K.POSITION_LABELS))
    return groups.withColumns({
        "seed": S.position_seed(F.col("prompt_id"), F.col("lever")),
        "position_to_model": F.map_from_arrays(labels, _slots(F.col("prompt_id"), F.col("lever"), models)),
    })


def group_responses(results: DataFrame, models: list[str] = K.TEST_MODELS) -> DataFrame:
    """One row per (run, prompt, lever) with ``texts`` (model -> latest judge-able response) and ``n_models``.

    Rows move once, to their run and prompt, so that those of a prompt stay together on the way; they are
    sorted once, each model's latest first, and the groups are taken from that order.
    """
    df = judgeable(results).withColumnRenamed("optimisation_lever", "lever").where(F.col("model").isin(models))
    rows = df.select(*GROUP, "model", "run_attempt", "result_id", "response_text").repartition("run_id", "prompt_id")
    latest = Window.partitionBy(*GROUP, "model").orderBy(F.desc("run_attempt"), F.desc("result_id"))
    won = rows.withColumn("_r", F.rank().over(latest)).where("_r = 1")
    said = won.groupBy(*GROUP).agg(*[F.max(F.when(F.col("model") == m, F.col("response_text"))).alias(f"_t{i}") for i, m in enumerate(models)])
    found = [F.col(f"_t{i}") for i in range(len(models))]
    n = sum((t.isNotNull().cast("int") for t in found[1:]), found[0].isNotNull().cast("int"))
    return said.select(*GROUP, F.map_from_arrays(F.array(*map(F.lit, models)), F.array(*found)).alias("texts"), n.alias("n_models")).where("n_models > 0")


def complete_groups(results: DataFrame, models: list[str] = K.TEST_MODELS) -> DataFrame:
    """(run, prompt, lever) groups with ``n_models`` and ``complete``."""
    df = judgeable(results).where(F.col("model").isin(models))
    return (df.groupBy("run_id", "prompt_id", F.col("optimisation_lever").alias("lever"))
            .agg(F.count_distinct("model").alias("n_models"))
            .withColumn("complete", F.col("n_models") == len(models)))


def reference_block(category: Column, expected: Column) -> Column:
    """Reference answer shown to judges in the categories that have one."""
    out = F.lit(None).cast("string")
    for name, key in K.REFERENCE_FIELD.items():
        answer = J.field(expected, f"$.{key}", "string")
        out = F.when(category == name, F.concat(F.lit("Reference answer (canonical): '"), answer, F.lit("'"))).otherwise(out)
    return out


def build_judge_requests(results: DataFrame, prompts: DataFrame, models: list[str] = K.TEST_MODELS) -> DataFrame:
    """One blind message per complete (run, prompt, lever) group.

    Sections come in a fixed order and neither model nor lever names appear in them.
    """
    groups = group_responses(results, models).where(F.col("n_models") == len(models))
    criteria = prompts.where(F.col("criteria").isNotNull()).select(
        "prompt_id", "system_text", "user_text", "criteria",
        reference_block(F.col("task_category"), J.as_variant(prompts, "expected")).alias("reference"))
    df = position_map(groups.join(criteria, "prompt_id"), models)
    s = K.JUDGE_SECTIONS
    answers = [
        F.concat(F.lit(f"--- Response {label} ---\n"),
                 F.try_element_at(F.col("texts"), F.try_element_at(F.col("position_to_model"), F.lit(label))))
        for label in K.POSITION_LABELS]
    message = F.concat_ws(
        "\n\n", F.lit(s["task"]), F.concat(F.lit("[system]\n"), F.col("system_text")),
        F.concat(F.lit("[user]\n"), F.col("user_text")),
        F.when(F.col("reference").isNotNull(), F.lit(s["reference"])), F.col("reference"),
        F.lit(s["criteria"]), F.col("criteria"), F.lit(s["candidates"]), *answers, F.lit(s["closing"]))
    return df.select(*GROUP, "seed", "position_to_model", message.alias("message"))


def parse_reply(df: DataFrame, raw: str = "raw_text", labels: list[str] = K.POSITION_LABELS) -> DataFrame:
    """Add ``scores`` (label -> score), ``reasonings`` (label -> text) and ``parse_error`` to judge replies."""
    body = T.outer_braces(T.unfence(T.strip(F.col(raw)), K.JUDGE_FENCE_PATTERN))
    df = df.withColumn("_body", body)
    df = df.withColumn("_doc", J.document(F.col("_body")))
    # label by label instead of over an array: expressions inside lambdas are interpreted, not compiled
    said = [(x, f"_v{i}", f"_r{i}") for i, x in enumerate(labels)]
    df = df.withColumns({c: J.field(F.col("_doc"), f"$.{x}") for x, c, _ in said} | {c: J.field(F.col("_doc"), f"$.reasoning.{x}") for x, _, c in said})

    def problem(x: str, v: Column) -> Column:
        return (F.when(v.isNull(), F.lit(f"missing label {x}")).when(~J.is_number(v), F.lit(f"score not a number: {x}"))
                .when(~v.try_cast("double").between(0.0, 1.0), F.lit(f"score out of range: {x}")))

    error = (F.when(F.col("_body").isNull(), F.lit("no JSON object found"))
             .when(F.col("_doc").isNull(), F.lit("json decode failed"))
             .otherwise(F.coalesce(*[problem(x, F.col(v)) for x, v, _ in said])))
    score = F.array(*[F.col(v).try_cast("double") for _, v, _ in said])
    reasoning = F.array(*[F.when(J.is_text(F.col(r)), F.col(r).try_cast("string")) for _, _, r in said])
    gone = {"_body", "_doc", "parse_error", *[c for _, *own in said for c in own]}
    keep = [c for c in df.columns if c not in gone]
    df = df.withColumn("parse_error", error)
    good, names = F.col("parse_error").isNull(), F.array(*map(F.lit, labels))
    return pinned(df, keep, parse_error=F.col("parse_error"), scores=F.when(good, F.map_from_arrays(names, score)), reasonings=F.when(good, F.map_from_arrays(names, reasoning)))


def explode_judge_replies(replies: DataFrame, labels: list[str] = K.POSITION_LABELS) -> DataFrame:
    """Call level to row level: one row per label, error rows kept, the call's cost shared equally.

    ``replies`` carries run_id, prompt_id, lever, judge, raw_text, position_to_model, cost_usd,
    latency_ms and ``call_error`` (NULL for a call that returned).
    """
    df = parse_reply(replies, labels=labels)
    failed = F.col("call_error").isNotNull()
    df = df.withColumn("judge_error", F.coalesce(F.col("call_error"), F.col("parse_error")))
    df = df.withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    at = lambda c: F.when(~failed, F.try_element_at(F.col(c), F.col("label")))
    share = F.when(failed, F.lit(0.0)).otherwise(F.col("cost_usd") / F.lit(float(len(labels))))
    return df.select(
        "run_id", "prompt_id", F.try_element_at(F.col("position_to_model"), F.col("label")).alias("model"), "lever",
        "judge", F.col("label").alias("position"), at("scores").alias("score"), at("reasonings").alias("reasoning"),
        "judge_error", share.alias("cost_usd"), F.when(failed, F.lit(0).cast("long")).otherwise(F.col("latency_ms")).alias("latency_ms"))


def pair_and_flag(scores: DataFrame, *panel: str, stored: DataFrame | None = None) -> DataFrame:
    """Two or more judges side by side (a, b, c, ...) per (run, prompt, model, lever), with gap, flag and median.

    The gap is between the highest and the lowest score, NULL with fewer than two; the flag
    follows the rule for two, or for three and more.

    With ``stored`` rows (same key, judge_*_score / judge_*_reasoning), fresh values win and a
    missing fresh value keeps the stored one; the flag is computed from what results.
    """
    key = ["run_id", "prompt_id", "model", "lever"]
    one = lambda c, j: F.max(F.when(F.col("judge") == j, F.col(c)))
    sides = dict(zip("abcdefghij"[:len(panel)], panel, strict=True))
    df = scores.groupBy(*key).agg(*[one(c, j).alias(f"judge_{s}_{c}") for c in ("score", "reasoning") for s, j in sides.items()])
    if stored is not None:
        cols = [f"judge_{s}_{c}" for c in ("score", "reasoning") for s in sides]
        old = stored.select(*key, *[F.col(c).alias(f"_old_{c}") for c in cols])
        df = df.join(old, key, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_old_{c}")) for c in cols})
        df = df.drop(*[f"_old_{c}" for c in cols])
    return with_agreement(df, list(sides))


def with_agreement(df: DataFrame, sides: list[str] = ("a", "b")) -> DataFrame:
    said = [F.col(f"judge_{s}_score") for s in sides]
    if len(said) == 2:
        gap = F.abs(said[0] - said[1])
    else:
        gap = F.when(F.size(F.array_compact(F.array(*said))) > 1, F.greatest(*said) - F.least(*said))
    return df.withColumns({"delta": gap, "is_disagreement": S.is_disagreement(*said), "median_score": S.canonical_score(*said)})


def missing_sides(results: DataFrame, models: list[str] = K.TEST_MODELS) -> DataFrame:
    """Complete (run, prompt, lever) groups in which a judge has not scored every row, and which side can be skipped."""
    df = results.where(F.col("task_category").isin(K.JUDGED_CATEGORIES))
    out = df.groupBy("run_id", "prompt_id", F.col("optimisation_lever").alias("lever")).agg(
        F.count_distinct("model").alias("n_models"),
        F.bool_or(F.col("judge_a_score").isNull()).alias("missing_a"),
        F.bool_or(F.col("judge_b_score").isNull()).alias("missing_b"))
    out = out.where((F.col("n_models") >= len(models)) & (F.col("missing_a") | F.col("missing_b")))
    return out.select("run_id", "prompt_id", "lever", "missing_a", "missing_b",
                      (~F.col("missing_a")).alias("skip_a"), (~F.col("missing_b")).alias("skip_b"))


def missing_panel_sides(results: DataFrame, sides: list[str], models: list[str] = K.TEST_MODELS) -> DataFrame:
    """``missing_sides`` for a panel of any judges: complete groups with the ``sides`` that have not scored every row, and those to skip."""
    df = results.where(F.col("task_category").isin(K.JUDGED_CATEGORIES))
    gaps = [F.bool_or(F.col(f"judge_{s}_score").isNull()).alias(f"_{s}") for s in sides]
    out = df.groupBy("run_id", "prompt_id", F.col("optimisation_lever").alias("lever")).agg(F.count_distinct("model").alias("n_models"), *gaps)
    listed = lambda missing: F.array_compact(F.array(*[F.when(F.col(f"_{s}") == missing, F.lit(s)) for s in sides]))
    out = out.where(F.col("n_models") >= len(models)).select("run_id", "prompt_id", "lever", listed(True).alias("missing"), listed(False).alias("skip"))
    return out.where(F.size("missing") > 0)


def flagged_groups(results: DataFrame) -> DataFrame:
    """Distinct (run, prompt, lever) groups with a flagged row."""
    return (results.where(F.col("judge_disagreement_flag") == 1)
            .select("run_id", "prompt_id", F.col("optimisation_lever").alias("lever")).distinct())
