"""Mixing sources to target weights by Poisson replication.

A document of a source whose mean repetition rate is r appears k times, where k is the inverse of
the Poisson distribution with mean r at a number hashed from the document's id and a seed.  Each
copy then goes to a place hashed from id and copy, so the mixture is shuffled over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import fresh, hash52, staged

SEED = 20
#: Without given weights a source of n documents weighs n ** TEMPERATURE.
TEMPERATURE = 0.5
#: A higher rate is drawn in equal parts of at most this, whose sum has the same distribution.
#: No part has as many copies as PART_COPIES, which numbers the copies.
PART_RATE, PART_COPIES = 100, 1000
#: More sources than this are joined by a shuffle with salted keys instead of a broadcast.
BROADCAST_SOURCES, SALTS = 50_000, 64


def source_rates(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, source: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """source, n_docs, rate, parts, cdf: how often a document of each source appears on average.

    ``weights`` (source, weight) are relative; a source they don't name, and a NULL or negative
    weight, has weight 0.  ``total`` is the documents wanted, as many as there are by default.
    """
    sizes = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("n_docs", F.lit(temperature)))
    else:
        named = weights.groupBy(F.col("source").cast("string").alias("_source")).agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
        weighed = sizes.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").fillna(0.0, ["weight"])
    weighed = staged(weighed, "weights")
    sums = weighed.agg(F.sum("n_docs").alias("n"), F.sum("weight").alias("w")).first()
    wanted = total if total is not None else sums["n"] or 0
    scale = wanted / sums["w"] if sums["w"] else 0.0
    rated = weighed.withColumn("rate", F.col("weight") * F.lit(float(scale)) / F.col("n_docs"))
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")
    rated = rated.withColumns({"parts": parts, "part_rate": F.col("rate") / parts})
    return rated.select("source", "n_docs", "rate", "parts", distribution(F.col("part_rate")).alias("cdf"))


def distribution(rate: Column) -> Column:
    """Partial sums of the Poisson distribution, from no copy up to where what is left is far below 2**-52."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    first = F.exp(-rate)
    following = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), (s["c"] + s["p"] * rate / k).alias("c"),
                                      F.array_append(s["sums"], s["c"] + s["p"] * rate / k).alias("sums"))
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("sums"))
    return F.aggregate(F.sequence(F.lit(1), last), start, following, lambda s: s["sums"])


def mix(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
        source: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """The mixture: all columns of ``docs``, copy (from 1) and shuffle_key, a row for each copy.

    Draws depend on id and text alone: a rerun gives the same rows, and rows that repeat are drawn
    alike.  A NULL source is a source of its own; NULL ids are told apart by their texts and a NULL
    text counts as empty.  Input columns named copy or shuffle_key are replaced.  An empty table,
    and weights of 0 throughout, give no rows.
    """
    rates = staged(source_rates(docs, weights, total, source, temperature).where("rate > 0"), "rates")
    plain = docs.drop("copy", "shuffle_key")
    key, salt, parts, cdf, draw, part, number, same = fresh(plain, "rate_source", "rate_salt", "rate_parts", "rate_cdf", "drawn", "draw_part", "copy_in_part", "row_identity")
    right = rates.select(F.col("source").alias(key), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    on = F.col(source).cast("string").eqNullSafe(F.col(key))
    rows = plain.withColumn(same, F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))
    if rates.count() <= BROADCAST_SOURCES:
        rated = rows.join(F.broadcast(right), on)
    else:
        right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = rows.join(right, on & (F.pmod(F.xxhash64(same), F.lit(SALTS)).cast("int") == F.col(salt))).drop(salt)
    drawn = rated.withColumn(part, F.explode(F.sequence(F.lit(1), F.col(parts))))
    u = hash52(F.concat_ws("|", F.lit(seed), same, part)) / F.lit(float(2**52))
    pinned = drawn.withColumn(draw, u)
    count = F.size(F.filter(cdf, lambda c: c <= F.col(draw)))
    copies = pinned.withColumn(number, count).where(F.col(number) > 0).withColumn(number, F.explode(F.sequence(F.lit(1), F.col(number))))
    out = copies.withColumn("copy", ((F.col(part) - 1) * PART_COPIES + F.col(number)).cast("long"))
    out = out.withColumn("shuffle_key", hash52(F.concat_ws("|", F.lit(seed), same, F.lit("copy"), "copy")))
    return out.select(*plain.columns, "copy", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
