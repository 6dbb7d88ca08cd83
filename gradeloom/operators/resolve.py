"""Disagreement cases: automatic resolution, arbitration order, canonical scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import constants as K
from gradeloom.functions import scores as S, text as T
from gradeloom.operators.ordered import position

CASE_KEY = ["prompt_id", "model", "lever"]


def with_delta(cases: DataFrame) -> DataFrame:
    """Gap from the raw scores; the three-decimal text of the file loses the boundary."""
    return cases.withColumn("delta", F.abs(F.col("judge_a_score") - F.col("judge_b_score")))


def is_scored(cases_score: Column) -> Column:
    return F.coalesce(T.strip(cases_score) != "", F.lit(False))


def auto_resolve(cases: DataFrame, min_delta: float = K.AUTO_RESOLVE_DELTA) -> DataFrame:
    """Give unresolved cases at or below the threshold the midpoint of both scores.

    Every other unresolved case is left for ``open_cases`` with the same threshold, so the two
    cover all cases.  Running it again changes nothing.
    """
    df = with_delta(cases)
    unresolved = F.coalesce(F.col("arbitration_method"), F.lit("")) == ""
    take = unresolved & (F.col("delta") <= F.lit(float(min_delta)))
    middle = (F.col("judge_a_score") + F.col("judge_b_score")) / F.lit(2.0)
    note = F.format_string(f"AUTO: median canonical (|Δ|=%.3f ≤ {min_delta} threshold)", F.col("delta"))
    return df.withColumns({
        "human_score": F.when(take, F.format_string("%.3f", middle)).otherwise(F.col("human_score")),
        "human_note": F.when(take, note).otherwise(F.col("human_note")),
        "arbitration_method": F.when(take, F.lit(K.AUTO_METHOD)).otherwise(F.col("arbitration_method")),
    })


def open_cases(cases: DataFrame, min_delta: float = K.AUTO_RESOLVE_DELTA) -> DataFrame:
    """Unresolved cases above the threshold."""
    df = with_delta(cases)
    return df.where((F.coalesce(F.col("arbitration_method"), F.lit("")) == "") & (F.col("delta") > F.lit(float(min_delta))))


def in_cluster(cluster: str) -> Column:
    """Case predicate of a cluster name: a lever, a category prefix, or ``prefix-lever``."""
    category = T.category_of(F.col("prompt_id"))
    name = lambda c: F.lit(K.PREFIX_CATEGORY.get(c, c))
    if "-" in cluster:
        prefix, lever = cluster.split("-", 1)
        return (category == name(prefix)) & (F.col("lever") == lever)
    if cluster in K.LEVERS:
        return F.col("lever") == cluster
    return category == name(cluster)


def arbitration_queue(cases: DataFrame, mode: str = "compression-first", cluster: str | None = None,
                      categories: list[str] | None = None, seed: int = 0, slices: int | None = None) -> DataFrame:
    """Cases with their 0-based visiting position ``pos``.

    Modes: ``compression-first``, ``cluster`` (only matching cases), ``by-category`` (listed
    categories first) and ``shuffle`` (a seeded order).  Within a block the widest gap comes
    first, then prompt and model.
    """
    df = with_delta(cases)
    if mode == "shuffle":
        return _queued(df, [F.unhex(F.sha2(F.concat_ws("|", F.lit(str(seed)), *CASE_KEY), 256))], slices)  # the order of the digits is that of the bytes
    widest = -F.col("delta")
    if mode == "cluster":
        return _queued(df.where(in_cluster(cluster)), [widest], slices)
    if mode == "by-category":
        names = [K.PREFIX_CATEGORY.get(c, c) for c in categories]
        rank = F.array_position(F.array(*map(F.lit, names)), T.category_of(F.col("prompt_id")))
        block = F.when(rank > 0, rank).otherwise(F.lit(len(names) + 1))
    elif mode == "compression-first":
        block = F.when(F.col("lever") == "compression", F.lit(0)).otherwise(F.lit(1))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return _queued(df, [block, widest], slices)


def _queued(df: DataFrame, order: list[Column], slices: int | None) -> DataFrame:
    """Add ``pos`` along ``order`` (NULLs last), then the case's key.

    Cases are shuffled once, to the slice of their place; ``df`` must give the same rows each time it is read.
    Cases that share a key and place follow each other.
    """
    keys = {}
    for i, c in enumerate([*order, *map(F.col, CASE_KEY)]):
        keys |= {f"_z{i}": c.isNull(), f"_o{i}": c}
    return position(df.withColumns(keys), [], list(keys), slices=slices).select(*df.columns, "pos")


def resume_position(queue: DataFrame) -> DataFrame:
    """First unscored position of a queue, or its length when all are scored."""
    first = F.min(F.when(~is_scored(F.col("human_score")), F.col("pos")))
    return queue.agg(F.coalesce(first, F.count(F.lit(1))).alias("resume_at"))


def apply_scores(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """Enter human scores (prompt_id, model, lever, score text, note) into cases; see ``score_problems`` for those that can't be."""
    new = (scores.withColumn("_s", S.valid_score(F.col("score"))).where(F.col("_s").isNotNull())
           .groupBy(*CASE_KEY).agg(F.max_by(F.struct("_s", "note"), "entered_at").alias("_new")))
    hit = F.col("_new").isNotNull()
    return cases.join(new, CASE_KEY, "left").withColumns({
        "human_score": F.when(hit, F.format_string("%.3f", F.col("_new._s"))).otherwise(F.col("human_score")),
        "human_note": F.when(hit, F.coalesce(F.col("_new.note"), F.lit(""))).otherwise(F.col("human_note")),
        "arbitration_method": F.when(hit, F.lit("human")).otherwise(F.col("arbitration_method")),
    }).drop("_new")


def score_problems(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """Human scores that ``apply_scores`` cannot enter, with the ``reason``: no number from 0 to 1, or no such case."""
    bad = S.valid_score(F.col("score")).isNull()
    known = cases.select(*CASE_KEY).distinct().withColumn("_known", F.lit(True))
    df = scores.join(known, CASE_KEY, "left")
    reason = F.when(bad, F.lit("invalid score")).when(F.col("_known").isNull(), F.lit("unknown case"))
    return df.withColumn("reason", reason).where("reason is not null").drop("_known")


def populate_canonical(results: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical score of every row, and the keys that found no partner.

    Agreeing rows with both scores get their mean and never shuffle; only flagged rows are
    joined to the resolved cases, within their run where cases carry one.  Rows for which no rule
    fires keep the score they have.  The second frame lists flagged rows without a case
    (``results``), cases without a flagged row (``cases``) and keys whose cases disagree
    (``conflict``), which are entered nowhere.
    """
    key = ["prompt_id", "model", "_lever", *(["run_id"] if "run_id" in cases.columns else [])]
    score = F.col("human_score").try_cast("double")
    resolved = (cases.where(is_scored(F.col("human_score"))).withColumnRenamed("lever", "_lever")
                .groupBy(*key).agg(F.min(score).alias("_low"), F.max(score).alias("_high")))
    agree = F.col("_low").eqNullSafe(F.col("_high"))
    stored = F.col("canonical_score") if "canonical_score" in results.columns else F.lit(None).cast("double")
    columns = [c for c in results.columns if c != "canonical_score"]
    flagged = F.coalesce(F.col("judge_disagreement_flag"), F.lit(0)) == 1
    both = F.col("judge_a_score").isNotNull() & F.col("judge_b_score").isNotNull()
    agreed = results.where(~flagged).select(
        *columns, F.when(both, S.mean_of_both(F.col("judge_a_score"), F.col("judge_b_score"))).otherwise(stored).alias("canonical_score"))
    disputed = results.where(flagged).select(*columns, stored.alias("_stored"), F.col("optimisation_lever").alias("_lever"))
    r = resolved.select(*key, F.when(agree, F.col("_high")).alias("_arbitrated"))
    settled = disputed.join(r, key, "left").select(*columns, F.coalesce("_arbitrated", "_stored").alias("canonical_score"))
    keys = disputed.select(*key)
    unmatched = (keys.join(r, key, "left_anti").withColumn("side", F.lit("results"))
                 .unionByName(r.select(*key).join(keys, key, "left_anti").withColumn("side", F.lit("cases"))))
    unmatched = unmatched.unionByName(resolved.where(~agree).select(*key).withColumn("side", F.lit("conflict")))
    return agreed.unionByName(settled), unmatched.withColumnRenamed("_lever", "lever")
