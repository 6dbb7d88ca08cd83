"""Exact token counts of texts of any length.

Documents over ``LONG`` code points become overlapping chunks, which tasks encode with offsets
like small texts.  Two neighbours are spliced at a place in their overlap where both encodings
start a token and that no context can move: a space between two characters that are not white
space.  The splitting pattern of a byte-level vocabulary never joins a space to what stands
before it, so tokens left of such a place depend on nothing right of it, and the other way
round.  Where an overlap holds no such place, the document is cut again with wider overlaps.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.llm.common import staged, text_or_empty
from gradeloom.llm.tokens import token_numbers, token_starts

LONG, CHUNK, OVERLAP = 32_768, 16_384, 256
#: Documents that the library encodes at a time.
BATCH = 64
LIMIT = 512
STABLE = re.compile(r"(?<=\S) (?=\S)")
CHUNKS = "uid long, doc_id long, n_bytes long, number int, last int, start long, body string"


@lru_cache(maxsize=4)
def splits_at_spaces(path: str) -> bool:
    """Whether the splicing places are proven for this tokenizer: plain byte-level splitting and no normaliser."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = spec.get("pre_tokenizer") or {}
    plain = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
    return plain and split.get("type") == "ByteLevel" and bool(split.get("use_regex")) and not split.get("add_prefix_space") and not spec.get("normalizer")


def spans(n: int, chunk: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk of a text of ``n`` code points; neighbours share ``overlap``."""
    start = 0
    while True:
        end = min(n, start + chunk)
        yield start, end
        if end == n:
            return
        start = end - overlap


def _count_whole(path: str, ranks_path: str | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, counts = batch.column(1), []
            for at in range(0, len(column), BATCH):
                counts += token_numbers(column.slice(at, BATCH).to_pylist(), path, ranks_path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return task


def _cut(chunk: int, overlap: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        for batch in batches:
            for row in range(batch.num_rows):
                doc_id, text, n_bytes = (batch.column(i)[row].as_py() for i in range(3))
                parts = list(spans(len(text), chunk, overlap))
                rows = [(made, doc_id, n_bytes, i, len(parts) - 1, a, text[a:b]) for i, (a, b) in enumerate(parts)]
                made += 1
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                 ["uid", "doc_id", "n_bytes", "number", "last", "start", "body"])

    return task


def _encode_chunks(path: str, ranks_path: str | None, overlap: int):
    """Tokens of each chunk, and for its head and tail the splicing places with the tokens before them."""

    def places(text: str, begin: int, end: int, starts: np.ndarray, base: int) -> list[tuple[int, int]]:
        found = np.array([m.start() for m in STABLE.finditer(text, begin, end)], dtype=np.int64)
        before = np.searchsorted(starts, found)
        is_start = (before < len(starts)) & (starts[np.minimum(before, len(starts) - 1)] == found)
        return [(int(x) + base, int(n)) for x, n in zip(found[is_start], before[is_start], strict=True)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.int64(), pa.int64())
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                text = x["body"]
                starts = token_starts(text, path, ranks_path)
                head = places(text, 0, overlap, starts, x["start"]) if x["number"] else []
                tail = places(text, max(0, len(text) - overlap), len(text), starts, x["start"]) if x["number"] < x["last"] else []
                rows.append((x["uid"], x["doc_id"], x["n_bytes"], x["number"], x["last"], len(starts), head, tail))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), kind, kind)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                 ["uid", "doc_id", "n_bytes", "number", "last", "n", "head", "tail"])

    return task


def splice(counted: DataFrame) -> DataFrame:
    """uid, doc_id, n_bytes, n_tokens of each chunked document; n_tokens is NULL where some overlap has no common place."""
    order = Window.partitionBy("uid").orderBy("number")
    paired = counted.withColumn("next", F.lead("head").over(order))
    common = F.array_sort(F.array_intersect(F.map_keys("tail"), F.map_keys("next")))
    at = F.get(common, F.floor(F.size(common) / 2).cast("int"))
    paired = paired.withColumn("at", F.when(F.col("number") < F.col("last"), at))
    part = F.when(F.col("number") == F.col("last"), F.col("n")).otherwise(F.col("tail")[F.col("at")] - F.col("next")[F.col("at")])
    paired = paired.withColumn("part", part)
    return paired.groupBy("uid", "doc_id", "n_bytes").agg(F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens"))


def rebuilt(chunks: DataFrame) -> DataFrame:
    """doc_id, text and n_bytes of chunked documents, from their chunks."""
    ends = F.struct("number", "start", "body")
    overlap = lambda done, x: F.concat(done, F.substring(x["body"], F.length(done) - x["start"].cast("int") + 1, F.length(x["body"])))
    parts = chunks.groupBy("uid", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(ends)).alias("parts"))
    return parts.select("doc_id", F.aggregate("parts", F.lit(""), overlap).alias("text"), "n_bytes")


def count_tokens(docs: DataFrame, path: str, ranks_path: str | None = None, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text",
                 long: int = LONG, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``ranks_path`` names the same vocabulary in the format of a faster library, for texts on which
    both are proven to agree.  NULL and empty texts have no bytes and no tokens.  A tokenizer for which the splicing places
    aren't proven encodes every text whole.  Each row counts for itself, repeated ones too, and
    NULL ids stay NULL.  Other columns are not read.  An empty table gives no rows.
    """
    whole = text_or_empty(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes"))
    huge = F.lit(splits_at_spaces(path)) & (F.length("text") > long)
    counts = "doc_id long, n_bytes long, n_tokens long"
    out = rows.where(~huge).mapInArrow(_count_whole(path, ranks_path), counts)
    left = rows.where(huge)
    while True:
        chunks = staged(left.mapInArrow(_cut(chunk, overlap), CHUNKS), "chunks")
        maps = "uid long, doc_id long, n_bytes long, number int, last int, n long, head map<long,long>, tail map<long,long>"
        counted = staged(splice(chunks.repartition("uid", "number").mapInArrow(_encode_chunks(path, ranks_path, overlap), maps)), "spliced")
        out = out.unionByName(counted.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens"))
        failed = counted.where("n_tokens is null").select("uid")
        if failed.isEmpty():
            break
        left = rebuilt(chunks.join(failed, "uid", "left_semi"))
        overlap *= 4
        chunk = max(chunk, 4 * overlap)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
