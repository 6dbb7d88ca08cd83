"""Stored quantile sketches: a KLL sketch for each (run, group), merged when asked, so that a new run does not read old rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Size of a sketch: larger is more exact.
K_SIZE = 200


def rank_error(k: int = K_SIZE) -> float:
    """Normalised rank error of a sketch of size ``k`` at 99 % confidence."""
    return 2.446 / k ** 0.9433


def sketch(rows: DataFrame, column: str, by: list[str], k: int = K_SIZE) -> DataFrame:
    """One row for each group: its sketch of a whole-number column (NULLs left out) and the rows it holds."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col(column).cast("long"), F.lit(k)).alias("sketch"), F.count(column).alias("n"))


def append_sketches(sketches: DataFrame, path: str) -> None:
    """Add the sketches of new runs to a table."""
    sketches.write.mode("append").parquet(path)


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups from stored ones; the rows themselves are not needed."""
    return sketches.where("n > 0").groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"), F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, points: dict[str, float], by: list[str]) -> DataFrame:
    """Values at ranks from 0 to 1 (``{name: rank}``), one row a sketch."""
    return sketches.select(*by, "n", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(name) for name, p in points.items()])
