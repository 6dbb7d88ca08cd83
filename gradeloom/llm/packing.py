"""Packing documents into sequences by hierarchical best fit.

Each task encodes its documents and packs their pieces best-fit, largest first.  Bins that are
nearly full are done.  The underfull ones travel on as items of their own: a round deals them out
to fewer tasks, packs them again, and so on up the tree until one task is left or a round no
longer helps.  A bin is a row that carries its pieces, at most ``capacity`` of them, so no round
needs a join, and only underfull bins are ever shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import staged, text_or_empty
from gradeloom.llm.tokens import token_ids

CAPACITY = 2048
END = 0
#: A bin with at least this share of its capacity filled is closed at once.
NEARLY_FULL = 255 / 256
#: Pieces that a task packs at a time, and underfull bins that it takes in a merge round.
LOCAL_ITEMS, MERGE_BINS = 100_000, 10_000
PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                   ("offset", pa.int64()), ("ids", pa.binary())])
BINS = "bin long, fill long, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long,ids:binary>>"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest first, each into the open bin that it fills best (sizes from 1 to capacity)."""
    bins = np.empty(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, made = 0, 0  # bit r of open_rooms: some bin has r left
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            found = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            found, room, made = made, capacity, made + 1
        bins[item] = found
        if room > size:
            by_room[room - size].append(found)
            open_rooms |= 1 << (room - size)
    return bins


def cut(total: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece: whole sequences, but for the first of a longer document."""
    first = total % capacity or capacity
    start, length = 0, min(total, first)
    while start < total:
        yield start, length
        start, length = start + length, capacity


def _bins(pieces: pa.Array, sizes: np.ndarray, counts: np.ndarray, capacity: int, level: int, made: int) -> tuple[pa.RecordBatch, int]:
    """Pack items that are ``counts`` consecutive pieces each; returns the bins and how many there are now."""
    item_bin = best_fit(sizes, capacity)
    order = np.argsort(item_bin, kind="stable")
    fill = np.bincount(item_bin, weights=sizes).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))
    members = np.concatenate([np.arange(first[i], first[i + 1]) for i in order]) if (counts != 1).any() else order
    taken = pieces.take(pa.array(members))
    names = [f.name for f in PIECE]
    length = taken.field("length").to_numpy(zero_copy_only=False)
    per_bin = np.bincount(np.repeat(item_bin, counts), minlength=len(fill))
    ends = np.cumsum(length)
    offset = ends - length - np.repeat(np.cumsum(fill) - fill, per_bin)
    fields = [pa.array(offset) if n == "offset" else taken.field(n) for n in names]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_bin))), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(PIECE)))
    numbers = (level << 56) + (TaskContext.get().partitionId() << 32) + made + np.arange(len(fill))
    return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(fill), lists], ["bin", "fill", "pieces"]), made + len(fill)


def _encode_and_pack(path: str, ranks_path: str | None, capacity: int, with_ids: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        made = 0

        def packed():
            pieces = pa.StructArray.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), PIECE, strict=True)], fields=list(PIECE))
            sizes = np.array([r[3] for r in rows], dtype=np.int64)
            return _bins(pieces, sizes, np.ones(len(rows), dtype=np.int64), capacity, 0, made)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(token_ids(text, path, ranks_path), np.uint32(END)).astype("<u4")
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start:start + length].tobytes()
                    rows.append((doc_id, number, start, length, zlib.crc32(part), 0, part if with_ids else None))
                if len(rows) >= LOCAL_ITEMS:
                    out, made = packed()
                    rows.clear()
                    yield out
        if rows:
            yield packed()[0]

    return task


def _merge(capacity: int, level: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)  # about MERGE_BINS rows
        if tables:
            rows = pa.Table.from_batches(tables).combine_chunks()
            lists = rows["pieces"].combine_chunks()
            counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            yield _bins(lists.flatten().cast(PIECE), rows["fill"].to_numpy(), counts, capacity, level, 0)[0]

    return task


def pack(docs: DataFrame, path: str, ranks_path: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         with_ids: bool = False, merge_bins: int = MERGE_BINS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids (unsigned 32 bit, little-endian).

    A document is its ids and an end id; a NULL text is an end id alone.  Only documents over
    ``capacity`` are cut.  Every row is a document, so repeated rows are packed each, and NULL ids
    stay NULL.  Other columns are not read.  An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    bins = staged(rows.mapInArrow(_encode_and_pack(path, ranks_path, capacity, with_ids), BINS), "bins")
    full = int(capacity * NEARLY_FULL)
    done, rest, level, left = bins.where(F.col("fill") >= full), bins.where(F.col("fill") < full), 0, None
    while True:
        level, before = level + 1, rest.count() if left is None else left
        groups = -(-before // merge_bins)
        if before < 2:
            break
        dealt = rest.repartition(groups, F.xxhash64("bin", F.lit(level)))
        merged = staged(dealt.mapInArrow(_merge(capacity, level), BINS), "bins")
        done, rest = done.unionByName(merged.where(F.col("fill") >= full)), merged.where(F.col("fill") < full)
        left = rest.count()
        if groups == 1 or left > 0.99 * before:
            break
    return done.unionByName(rest).select(F.col("bin").alias("sequence_id"), F.inline("pieces")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., with_ids=True)``: sequence_id, n_tokens, ids (binary)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", joined.alias("ids"))
