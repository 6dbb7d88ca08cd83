"""One document of each group of near copies, by SimHash fingerprints and multi-index hashing.

Texts link when the Jaccard similarity of their sets of five-word shingles is 0.8 or more, checked on the full
sets.  Candidates come from fingerprints of 1,024 bits over word pairs, which a changed word moves less than
it moves longer shingles.  A fingerprint has as many disjoint segments as give the recall that is
asked for; every segment is a key of a table, and the table is asked for the ball of one bit around it.  Segments are
as long as the number of texts asks for, so that strangers seldom share a key at any size.

A key of few texts gives pairs.  A crowded key, as in groups of thousands of near copies, does not: there each text
meets the nearest of a few leaders of its crowds, for some rounds, which joins a group by few pairs; then
all texts of a crowd that are still apart are compared, so no comparison within a key is left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.llm.common import fresh, numbered, staged, text_or_empty
from gradeloom.llm.components import components
from gradeloom.llm.exact_dedup import heavy_candidates
from gradeloom.llm.simhash import majority, shingle_sets

#: Words of a shingle, the least similarity of a near copy, words of a fingerprint's features and its 64-bit words.
SHINGLE, SIMILARITY, FEATURE, WORDS = 5, 0.8, 2, 16
#: Share of differing bits for which segments are planned (nearly all pairs at 0.8 have less), and the recall wanted there.
DIFFERING, RECALL = 0.12, 0.97
#: Most bits of 64, and share of all bits, in which fingerprints of near copies differ; sets of fewer than SMALL shingles are not tested so.
SKETCH_BITS, MOST_DIFFERING, SMALL = 18, 0.18, 24
#: Texts of a key beyond which it is a crowd; leaders of a crowd, nearest leaders that a text meets, and rounds.
CROWD, LEADERS, NEAREST, ROUNDS = 32, 4, 4, 3


def plan(n: int, bits: int = 64 * WORDS, differing: float = DIFFERING, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a segment and number of segments for ``n`` texts."""
    size = min(max(16, math.ceil(math.log2(max(n, 2))) + 2), 40)
    found = (1 - differing) ** size * (1 + size * differing / (1 - differing))  # within one bit in a segment
    return size, min(bits // size, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def _prints(size: int, feature: int, words: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests = [], []
            fp = np.zeros((batch.num_rows, words), np.uint64)
            for found in shingle_sets(batch.column(0), size):
                n.append(len(found))
                digests.append(hashlib.md5(found.tobytes(), usedforsecurity=False).digest())
            for row, found in enumerate(shingle_sets(batch.column(0), feature)):
                if len(found):
                    fp[row] = majority(found, words)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * words), len(fp), [None, pa.py_buffer(fp.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), packed], ["uid", "n", "digest", "fp"])

    return task


def _keys(size: int, segments: int, words: int):
    """Every text in the table of each segment (asks 0), and asking for the keys one bit off; of a flip, the side whose bit is 0 asks."""
    weights = np.uint64(1) << np.arange(size, dtype=np.uint64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                fp = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, 8 * words)
                uid = batch.column(0).to_numpy()
                sketch = fp.view(np.uint64)[:, -1].view(np.int64)
                bits = np.unpackbits(fp, axis=1, bitorder="little")[:, :size * segments].reshape(-1, segments, size)
                key = (bits * weights).sum(axis=2, dtype=np.uint64) | (np.arange(segments, dtype=np.uint64) << np.uint64(size))
                row, segment, bit = np.nonzero(bits == 0)
                asked = key[row, segment] | weights[bit]
                keys = np.concatenate((key.ravel(), asked)).view(np.int64)
                who = np.concatenate((np.repeat(np.arange(len(uid)), segments), row))
                asks = np.repeat(np.array([False, True]), (key.size, len(asked)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(asks), pa.array(uid[who]), pa.array(sketch[who])], ["key", "asks", "uid", "sketch"])

    return task


def _meet(crowd: int, most: int):
    """Rows sorted by (key, asks): pairs of small keys whose sketches are near, and the rows of crowds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table_uid, table_sketch, crowded = None, [], [], False
        out: list[tuple[np.ndarray, ...]] = []

        def packed() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], mask=columns[0] < 0), pa.array(columns[1]), pa.array(columns[2], mask=columns[0] >= 0), pa.array(columns[3])], ["key", "a", "b", "sketch"])

        def crowd_rows(k: int, uid: np.ndarray, sketch: np.ndarray) -> None:
            out.append((np.full(len(uid), k, np.int64), uid, np.zeros(len(uid), np.int64), sketch))

        def pairs(uid: np.ndarray, sketch: np.ndarray, own: bool) -> None:
            mine, theirs = np.concatenate(table_uid), np.concatenate(table_sketch)
            near = np.bitwise_count((sketch[:, None] ^ theirs[None, :]).view(np.uint64)) <= most
            if own:
                near &= np.arange(len(uid))[:, None] > np.arange(len(mine))[None, :]
            x, y = np.nonzero(near)
            a, b = uid[x], mine[y]
            differ = a != b
            a, b = a[differ], b[differ]
            out.append((np.full(len(a), -1, np.int64), np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64)))

        def close() -> None:
            if table_uid and not crowded:
                pairs(np.concatenate(table_uid), np.concatenate(table_sketch), True)

        for batch in batches:
            keys, asks, uids, sketches = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1]))))
            for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True):
                if keys[begin] != key:
                    close()
                    key, table_uid, table_sketch, crowded = int(keys[begin]), [], [], False
                uid, sketch = uids[begin:end], sketches[begin:end]
                if crowded:
                    crowd_rows(key, uid, sketch)
                elif not asks[begin]:
                    table_uid.append(uid)
                    table_sketch.append(sketch)
                    if sum(map(len, table_uid)) > crowd:
                        crowded = True
                        crowd_rows(key, np.concatenate(table_uid), np.concatenate(table_sketch))
                elif table_uid:
                    for at in range(0, len(uid), 4096):
                        pairs(uid[at:at + 4096], sketch[at:at + 4096], False)
            if out:
                yield packed()
                out = []
        close()
        if out:
            yield packed()

    return task


def _sets(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(0), size))
            ends = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))), pa.int32())
            flat = pa.array(np.concatenate(found).view(np.int64)) if found else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(ends, flat)], ["uid", "set"])

    return task


def _verify(similarity: float):
    """Pairs that have the sets of both sides: those whose similarity is high enough."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                kept.append(same >= similarity * (len(x) + len(y) - same) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return task


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets (uid, set) have a Jaccard similarity of ``similarity`` or more."""
    least = F.size("set_a") + F.size("set_b")
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    possible = F.least(F.size("set_a"), F.size("set_b")) * (1 + 1 / similarity) >= least - F.lit(1e-6)
    return both.where(possible).select("a", "b", "set_a", "set_b").mapInArrow(_verify(similarity), "a long, b long")


def near_prints(pairs: DataFrame, prints: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (a, b) whose fingerprints are near, or whose sets are too small to tell."""
    most = int(MOST_DIFFERING * 64 * words)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(-1, words) for c in ("fp_a", "fp_b"))
            near = (np.bitwise_count(x ^ y).sum(axis=1) <= most) | batch.column("small").to_numpy(zero_copy_only=False)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    own = prints.select("uid", "n", "fp")
    both = pairs.join(own.toDF("a", "n_a", "fp_a"), "a").join(own.toDF("b", "n_b", "fp_b"), "b")
    possible = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(SIMILARITY - 1e-9)
    return both.where(possible).select("a", "b", "fp_a", "fp_b", (F.least("n_a", "n_b") < SMALL).alias("small")).mapInArrow(task, "a long, b long")


def _leaders(rows: DataFrame, number: int, leaders: int) -> DataFrame:
    """Pairs of a crowd's texts and its leaders, drawn anew in every round, with the distance of their sketches."""
    draw = [F.min(F.struct(F.xxhash64(F.lit(number), F.lit(j), "uid"), "uid", "sketch", "root")).alias(f"l{j}") for j in range(leaders)]
    chosen = rows.groupBy("key").agg(*draw).select("key", F.array(*[f"l{j}" for j in range(leaders)]).alias("leaders"))
    met = rows.join(chosen, "key").select("uid", "sketch", "root", F.explode("leaders").alias("l")).where((F.col("l.root") != F.col("root")))
    return met.select("uid", F.col("l.uid").alias("other"), F.bit_count(F.col("sketch").bitwiseXOR(F.col("l.sketch"))).alias("far"))


def links(prints: DataFrame, texts: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, words: int = WORDS, crowd: int = CROWD, rounds: int = ROUNDS) -> DataFrame:
    """root of every node of the graph of near copies: links of texts (uid, text) with ``prints`` (uid, n, fp), closed transitively."""
    n = prints.count()
    bits, segments = plan(n, 64 * words)
    keyed = prints.select("uid", "fp").mapInArrow(_keys(bits, segments, words), "key long, asks boolean, uid long, sketch long")
    # keys so heavy that they would crowd one task: their rows need no grouping here, for they are crowds
    heavy = staged(heavy_candidates(prints.select("uid", "fp").mapInArrow(_keys(bits, segments, words), "key long, asks boolean, uid long, sketch long").where("NOT asks"), "key", 512, crowd + 1), "heavy")
    counted = keyed.join(F.broadcast(heavy.select(F.col("key").alias("hot"))), F.col("key") == F.col("hot"), "left")  # at most 512 rows
    hot = counted.where("hot IS NOT NULL").select("key", F.col("uid").alias("a"), F.lit(None).cast("long").alias("b"), "sketch")
    rest = counted.where("hot IS NULL").select("key", "asks", "uid", "sketch").repartition("key").sortWithinPartitions("key", "asks")
    met = staged(rest.mapInArrow(_meet(crowd, SKETCH_BITS), "key long, a long, b long, sketch long").unionByName(hot), "met")
    first = staged(near_prints(met.where("b IS NOT NULL").select("a", "b").distinct(), prints, words), "pairs")
    crowds = met.where("b IS NULL").select("key", F.col("a").alias("uid"), "sketch")
    asked = first.select(F.explode(F.array("a", "b")).alias("uid")).unionByName(crowds.select("uid")).distinct()
    sets = staged(texts.join(asked, "uid", "left_semi").select("text", "uid").mapInArrow(_sets(size), "uid long, set array<long>"), "sets")
    found = staged(alike(first, sets, similarity), "links")
    known = components(found)
    tried = first
    rows = staged(crowds, "crowds")
    if rows.isEmpty():
        return known

    def rooted() -> DataFrame:
        named = rows.join(known.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        apart = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        return staged(named.join(apart, "key", "left_semi").select("key", "uid", "sketch", "root"), "apart")

    def judge(pairs: DataFrame) -> None:
        nonlocal found, known, tried
        new = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        new = staged(near_prints(new, prints, words), "pairs")
        found = found.unionByName(staged(alike(new, sets, similarity), "links"))
        tried, known = tried.unionByName(new), components(found)

    for number in range(rounds):
        apart = rooted()
        if apart.isEmpty():
            return known
        near = _leaders(apart, number, LEADERS).where(F.col("far") <= SKETCH_BITS).groupBy("uid", "other").agg(F.min("far").alias("far"))
        ranks = Window.partitionBy("uid").orderBy("far", "other")  # a text has few leaders
        judge(near.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= NEAREST).select(F.col("uid").alias("x"), F.col("other").alias("y")))
    left = rooted()
    sizes = left.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
    lead = sizes.groupBy("key").agg(F.max(F.struct("rows", "root")).alias("most")).select("key", F.col("most.root").alias("lead"))
    mixed = staged(left.join(lead, "key"), "mixed")  # of two texts with different roots one at least is outside the lead
    x = mixed.where("root <> lead").select(F.col("key").alias("kx"), F.col("uid").alias("x"), F.col("sketch").alias("sx"), F.col("root").alias("rx"))
    y = mixed.select(F.col("key").alias("ky"), F.col("uid").alias("y"), F.col("sketch").alias("sy"), F.col("root").alias("ry"), "lead")
    once = (F.col("ry") == F.col("lead")) | (F.col("x") < F.col("y"))
    on = (F.col("kx") == F.col("ky")) & (F.col("rx") != F.col("ry")) & once & (F.bit_count(F.col("sx").bitwiseXOR(F.col("sy"))) <= SKETCH_BITS)
    judge(x.join(y, on).select("x", "y"))
    return known


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, words: int = WORDS,
             crowd: int = CROWD) -> DataFrame:
    """The documents with all their columns, less near copies: of each group of linked texts one stays, that with the smallest id.

    Texts with equal sets of shingles are one group, texts without words too; NULL texts count as empty and NULL ids
    count last.  Of rows with equal sets and ids one stays.  Very long texts are hashed block by block; their sets travel
    whole.  Extra columns pass through whatever their names; an empty table stays empty.  Links are found
    with the recall of ``plan``; a link that is reported is one of the full sets.
    """
    own = fresh(docs, "row_number")[0]
    rows = numbered(docs, own)
    texts = rows.select(text_or_empty(text).alias("text"), F.col(own).alias("uid"))
    prints = staged(rows.select(text_or_empty(text).alias("text"), F.col(own).alias("uid")).mapInArrow(_prints(size, FEATURE, words), "uid long, n int, digest binary, fp binary"), "prints")
    ids = rows.select(F.col(own).alias("uid"), F.col(doc_id).cast("long").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    each = staged(prints.select("uid", "digest").join(ids, "uid").groupBy("digest").agg(F.min(order).alias("first")).select(F.col("first.uid").alias("uid"), "first"), "distinct")
    worded = staged(prints.where("n > 0").join(each.select("uid"), "uid", "left_semi").select("uid", "n", "fp"), "representatives")
    linked = links(worded, texts, size, similarity, words, crowd)
    rooted = each.join(linked, each["uid"] == linked["node"], "left")
    stay = rooted.groupBy(F.coalesce("root", "uid").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.uid").alias("stays"))
    return rows.join(staged(stay, "stays"), F.col(own) == F.col("stays"), "left_semi").drop(own)
