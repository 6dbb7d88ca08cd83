"""From raw responses and judge replies to canonical scores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gradeloom.operators import resolve, tier1


def rescored(results: DataFrame, prompts: DataFrame) -> DataFrame:
    """Results with freshly computed deterministic scores in place of stored ones."""
    return tier1.score_tier1(results, prompts)


def final_scores(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Results with their canonical score filled in."""
    return resolve.populate_canonical(results, cases)[0]
