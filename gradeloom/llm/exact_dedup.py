"""Exact duplicates by digest, with the heaviest groups taken out before the shuffle.

Misra-Gries summaries, one per task and merged, name at most ``counters`` digests that may hold
more than ``rows / counters`` rows.  Their exact winners fit a broadcast whose size that number
bounds, so rows of heavy groups get their answer where they lie.  All other groups are smaller
than the bound and take an ordinary shuffle of narrow rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.llm.common import SPACE_CHARS, fresh, numbered, staged, text_or_empty

COUNTERS = 512


def without_space(text: Column) -> Column:
    """The text after every character of ``[\\x20\\x09-\\x0D]`` has gone."""
    for c in SPACE_CHARS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def summarise(counts: Counter, counters: int) -> Counter:
    """Cut a summary to ``counters`` entries: take the next largest count off all (Agarwal et al., mergeable summaries)."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def heavy_candidates(rows: DataFrame, key: str, counters: int = COUNTERS, least: int = 1) -> DataFrame:
    """At most ``counters`` values of ``key``, all that hold ``rows / (counters + 1) + least`` rows or more among them."""

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: Counter = Counter()
        for batch in batches:
            kept.update(Counter(batch["k"].tolist()))
            kept = summarise(kept, counters)
        yield pd.DataFrame({"k": list(kept.keys()), "n": list(kept.values())})

    spark = rows.sparkSession
    schema = f"k {rows.schema[key].dataType.simpleString()}, n long"
    parts = rows.select(F.col(key).alias("k")).where("k is not null").mapInPandas(per_task, schema)
    top = parts.groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(counters + 1).collect()
    cut = top[counters]["n"] if len(top) > counters else 0
    return spark.createDataFrame([(r["k"],) for r in top if r["n"] - cut >= least], rows.select(F.col(key).alias(key)).schema)


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    A NULL text counts as empty, so NULL, empty and blank texts are one group.  Of equal texts the
    one with most code points stays, then the smallest doc_id; a NULL doc_id loses to any other.
    Rows that repeat the id and text of the winner are all marked kept (``dedup`` returns one of
    them).  Columns other than the two named are not read.  An empty table gives no rows.
    """
    whole = text_or_empty(text)
    rows = staged(docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(without_space(whole), 256)).alias("digest"),
                              F.char_length(whole).cast("long").alias("n_points")), "digests")
    best = F.struct(F.col("n_points"), -F.col("doc_id"))
    candidates = heavy_candidates(rows, "digest", counters)
    heavy = (rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest")
             .agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    tagged = rows.join(F.broadcast(heavy), "digest", "left")  # at most ``counters`` rows
    group = Window.partitionBy("digest")
    light = (tagged.where("best is null").drop("best", "group_size")
             .select("*", F.max(best).over(group).alias("best"), F.count(F.lit(1)).over(group).alias("group_size")))
    out = tagged.where("best is not null").unionByName(light)
    keep = -F.col("best")["col2"]
    return out.select("doc_id", keep.alias("keep_id"), "group_size",
                      (F.col("doc_id").eqNullSafe(keep) & (F.col("n_points") == F.col("best")["n_points"])).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"), "n_points")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns, one row for each distinct text.

    The winner is that of ``mark``; of rows that repeat its id, text length and normalised text one stays.  Losers of
    heavy groups go where they lie, by the broadcast winners; the rest is decided on narrow rows.  Extra columns
    pass through whatever their names; an empty table stays empty.
    """
    number, digest, winner, heavy_digest = fresh(docs, "row_number", "text_digest", "heavy_winner", "heavy_digest")
    rows = numbered(docs, number)
    whole = text_or_empty(text)
    best = F.max(F.struct("n_points", F.col("id").isNotNull().alias("named"), (-F.col("id")).alias("low"), (-F.col("uid")).alias("first"))).alias("best")
    narrow = staged(rows.select(F.col(number).alias("uid"), F.col(doc_id).cast("long").alias("id"), F.unhex(F.sha2(without_space(whole), 256)).alias("digest"),
                                F.char_length(whole).alias("n_points")), "digests")
    candidates = heavy_candidates(narrow, "digest", counters)
    heavy = staged(narrow.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(best).select("digest", (-F.col("best.first")).alias("uid")), "heavy")
    light = narrow.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").groupBy("digest").agg(best)  # at most ``counters`` rows
    stay = staged(light.select((-F.col("best.first")).alias("uid")).unionByName(heavy.select("uid")), "stay")
    marked = rows.withColumn(digest, F.unhex(F.sha2(without_space(whole), 256)))
    marked = marked.join(F.broadcast(heavy.select(F.col("digest").alias(heavy_digest), F.col("uid").alias(winner))), F.col(digest) == F.col(heavy_digest), "left")
    left = marked.where(F.col(winner).isNull() | (F.col(winner) == F.col(number))).drop(digest, heavy_digest, winner)
    return left.join(stay.withColumnRenamed("uid", winner), F.col(number) == F.col(winner), "left_semi").select(*docs.columns)
