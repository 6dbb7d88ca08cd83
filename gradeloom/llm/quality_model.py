"""A quality classifier by importance resampling.

Two generative models over hashed words and word pairs are counted: one of target text (labelled
good and not toxic), one of all raw text.  A document's log weight is the sum of the log ratios of
its n-grams, which grows with the text, so each band of lengths has a cut of its own: that which
tells held-out good documents from bad ones best.  Documents are then sampled without replacement
in proportion to their weights over the cut by Gumbel top-k: the k largest of log weight less cut
plus noise hashed from id and text.  k is the number of documents whose log weight reaches the cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import fresh, staged, text_or_empty
from gradeloom.llm.ngrams import blocks, hashed

BITS = 16
#: Labelled rows that take part at most, those with the smallest hash of their id; half fit the
#: target model, half are held out.  It bounds what is broadcast.
LABELLED = 20_000
#: Expected n-grams of a bucket that count as prior knowledge: rare buckets say little.
PRIOR = 5.0
#: Held-out documents of either label that a band of lengths has at least, the share of good ones a cut may lose, and the room it leaves for noise.
BAND, LOSS, NOISE_ROOM = 10, 0.01, 2.0
SEED = 6


@dataclass
class Model:
    """Log ratio of target to raw for each n-gram bucket."""

    log_ratio: np.ndarray
    bits: int = BITS


def labelled(labels: DataFrame, bound: int = LABELLED, seed: int = SEED) -> DataFrame:
    """At most ``bound`` labelled ids with ``good``, ``quality`` and ``fold`` (0 fits, 1 is held out); several labels of an id: the worst counts."""
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(
        (F.min(F.coalesce("quality", F.lit(0))) > 0).alias("quality"), (F.max(F.coalesce("toxic", F.lit(1))) > 0).alias("toxic"))
    order = F.xxhash64(F.lit(seed), "doc_id")
    return worst.select("doc_id", (F.col("quality") & ~F.col("toxic")).alias("good"), "quality", F.pmod(F.shiftright(order, 8), F.lit(2)).alias("fold"), order.alias("_o")).orderBy("_o", "doc_id").limit(bound).drop("_o")


def _count(bits: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 << bits, np.int64), np.zeros(2 << bits, np.int64)
        for batch in batches:
            is_target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, data, offsets in blocks(batch.column(0)):
                bucket, doc = hashed(data, offsets, bits)
                raw += np.bincount(bucket, minlength=2 << bits)
                target += np.bincount(bucket[is_target[row + doc]], minlength=2 << bits)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((used, pa.int32()), (raw[used], pa.int64()), (target[used], pa.int64()))], ["bucket", "raw", "target"])

    return task


def fit(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, prior: float = PRIOR) -> Model:
    """Count both models in one pass over all documents; ``sample`` comes from ``labelled``."""
    targets = sample.where("good and fold = 0").select(F.col("doc_id").alias("_target"))
    rows = docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("text")).join(F.broadcast(targets), F.col("_id") == F.col("_target"), "left")
    counted = rows.select("text", F.col("_target").isNotNull().alias("t")).mapInArrow(_count(bits), "bucket int, raw long, target long")
    table = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # at most 2 << bits rows
    raw, target = np.zeros(2 << bits), np.zeros(2 << bits)
    at = table["bucket"].to_numpy()
    raw[at], target[at] = table["raw"].to_numpy(), table["target"].to_numpy()
    ratio = np.zeros(2 << bits)
    for part in (slice(0, 1 << bits), slice(1 << bits, 2 << bits)):
        expected = raw[part] * (target[part].sum() / max(raw[part].sum(), 1.0))
        ratio[part] = np.log((target[part] + prior) / (expected + prior))
    return Model(ratio, bits)


def _score(model: Model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for row, data, offsets in blocks(batch.column(0)):
                bucket, doc = hashed(data, offsets, model.bits)
                n = len(offsets) - 1
                out[row:row + n] = np.bincount(doc, weights=model.log_ratio[bucket], minlength=n)
                size[row:row + n] = np.bincount(doc, minlength=n)
            yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(size), *batch.columns[1:]], ["log_weight", "n_grams", *batch.schema.names[1:]])

    return task


def gumbel(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """Gumbel noise hashed from id and text."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 12).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.log(-F.log(u))


def log_weights(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, digest of the text, log_weight, n_grams (their number) and noise of every document."""
    whole = text_or_empty(text)
    rows = docs.select(whole.alias("text"), F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(whole)).alias("digest"), gumbel(F.col(doc_id), whole, seed).alias("noise"))
    scored = rows.mapInArrow(_score(model), "log_weight double, n_grams long, doc_id long, digest binary, noise double")
    return scored.select("doc_id", "digest", "log_weight", "n_grams", "noise")


def best_cut(good: list[float], bad: list[float], room: float = NOISE_ROOM) -> float:
    """The log weight from which on texts count as good: that with the least sum of both error rates, at most LOSS of good ones, and 0 at most.

    It lies ``room`` and the good texts' quartile distance below the lowest good text above it, but
    no lower than halfway to the next text below.
    """
    g, b = np.sort(good), np.sort(bad)
    lost = np.arange(len(g)) / len(g)
    wrong = 1 - np.searchsorted(b, g) / len(b) if len(b) else np.zeros(len(g))
    at = int(np.argmin(np.where(lost <= LOSS, lost + wrong, np.inf)))
    below = max([x for x in (*g[:at][-1:], *b[:np.searchsorted(b, g[at])][-1:])], default=-np.inf)
    first, third = np.percentile(g, [25, 75])
    return min(max(float(g[at]) - room - float(third - first), (float(g[at]) + below) / 2), 0.0)


def cuts(held: list[tuple[int, float, bool]], band: int = BAND) -> list[tuple[int, float]]:
    """Least number of n-grams and cut of each band of lengths, from held-out (n_grams, log_weight, quality).

    Bands are powers of two, joined until each has ``band`` texts of either label.
    """
    groups: list[tuple[int, list[float], list[float]]] = []
    by: dict[int, tuple[list[float], list[float]]] = {}
    for n, weight, quality in held:
        by.setdefault((n + 1).bit_length(), ([], []))[0 if quality else 1].append(weight)
    for size in sorted(by):
        if groups and min(len(groups[-1][1]), len(groups[-1][2])) < band:
            groups[-1] = (groups[-1][0], groups[-1][1] + by[size][0], groups[-1][2] + by[size][1])
        else:
            groups.append(((1 << (size - 1)) - 1, *by[size]))
    if len(groups) > 1 and min(len(groups[-1][1]), len(groups[-1][2])) < band:
        _, good, bad = groups.pop()
        groups[-1] = (groups[-1][0], groups[-1][1] + good, groups[-1][2] + bad)
    return [(least, best_cut(good, bad)) for least, good, bad in groups if good]


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 1024) -> float | None:
    """The k-th largest value of a column, by counts in ever narrower ranges; k from 1 to the number of rows."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low is not None and low < high:
        width = (high - low) / bins
        if not width:
            return high if rows.where(F.col(column) >= high).count() >= k else low
        inside = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        place = F.least(F.floor((F.col(column) - low) / F.lit(width)), F.lit(bins - 1))
        parts = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for part in parts:
            if k <= part["n"]:
                low, high = part["low"], part["high"]
                break
            k -= part["n"]
    return low


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = LABELLED, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, digest (MD5 of the text), log_weight, key, kept.

    key is the log weight less the cut of the document's band of lengths, plus noise.  ``labels``
    (doc_id, quality, toxic) with NULLs count as bad.  Without labelled target documents
    there is no target model: all weights are 0 and all documents stay.  NULL and empty texts have
    no n-grams and weigh 0.  Repeated rows have the same key and are kept or rejected together, also
    where that is more than k.  Extra columns are not read; an empty table gives no rows.
    """
    sample = staged(labelled(labels, bound, seed), "labelled")
    model = fit(docs, sample, doc_id, text, bits)
    rows = staged(log_weights(docs, model, doc_id, text, seed), "weights")
    held = rows.join(F.broadcast(sample.where("fold = 1").select("doc_id", "quality")), "doc_id").select("doc_id", F.struct("n_grams", "log_weight", "quality").alias("h"))
    held = held.groupBy("doc_id").agg(F.min("h").alias("h")).select("h.*")  # a row an id, however often it repeats
    bands = cuts([tuple(r) for r in held.collect()])  # at most ``bound`` rows
    cut = F.lit(bands[0][1] if bands else 0.0)
    for n, value in bands[1:]:
        cut = F.when(F.col("n_grams") >= n, F.lit(value)).otherwise(cut)
    rows = rows.select("doc_id", "digest", "log_weight", (F.col("log_weight") - cut + F.col("noise")).alias("key"), (F.col("log_weight") >= cut).alias("over"))
    k = rows.where("over").count() if bands and not sample.where("good and fold = 0").isEmpty() else 0
    rows = rows.drop("over")
    least = kth_largest(rows, "key", k) if k else None
    return rows.withColumn("kept", F.col("key") >= F.lit(least) if least is not None else F.lit(True))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = LABELLED, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """The documents that the sample holds, with all their columns, whatever the names of others."""
    kept = classify(docs, labels, doc_id, text, bound, bits, seed).where("kept").select("doc_id", "digest").distinct()
    key, digest, own = fresh(docs, "kept_id", "kept_digest", "own_digest")
    kept = kept.toDF(key, digest)
    rows = docs.withColumn(own, F.unhex(F.md5(text_or_empty(text))))
    return rows.join(kept, F.col(doc_id).eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest)), "left_semi").drop(own)
