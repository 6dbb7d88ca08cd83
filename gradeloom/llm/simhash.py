"""Near copies by SimHash fingerprints and multi-index hashing.

``exact_links`` finds all pairs of 64-bit fingerprints within two bits.  Two halves cannot both
differ in two bits or more, unless one is equal: so a table by left half is asked for every value
in a ball of one bit around a left half, and a table by right half for equal ones.  Of a flip, the
side whose bit is 0 asks, so each pair comes up once.  Matches count when the complete distance
is small enough.  Halves shared by many fingerprints would give all pairs of a group; for those,
fingerprints meet at all values within one bit of themselves, where a star is enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.llm.common import fresh, staged, text_or_empty
from gradeloom.llm.components import components
from gradeloom.llm.ngrams import STEP, blocks, mixed
from gradeloom.llm.passages import word_hashes

SEED = 42
#: Bytes of a text that are cut into words at a time, and shingles whose bits are counted at a time.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 255 * 64
#: Fingerprints per half beyond which they meet at midpoints instead of in pairs.
BUCKET = 64
SPACE_BYTE = re.compile(rb"[\x20\x09-\x0D]")
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(data: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``size`` words, A-Z lower-cased and joined by spaces; of all words where there are fewer."""
    digest, out, tail, at = xxhash.xxh64_intdigest, [], [], 0
    while at < len(data):
        end = at + BLOCK_BYTES
        if end < len(data):
            found = SPACE_BYTE.search(data, end)
            end = found.start() if found else len(data)
        words = tail + data[at:end].lower().split()
        out.append(np.array([digest(b" ".join(words[i:i + size]), seed) for i in range(len(words) - size + 1)], dtype=np.uint64))
        tail, at = words[-(size - 1):] if size > 1 else [], end
    found = np.concatenate(out) if out else np.empty(0, np.uint64)
    if not len(found) and tail:
        found = np.array([digest(b" ".join(tail), seed)], dtype=np.uint64)
    return found


def majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit words whose bits are set in over half of the hashes; further words come from mixed hashes."""
    counts = np.zeros((words, 8, 8), dtype=np.int64)  # word, bit of a byte, byte
    salts = (np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for at in range(0, len(hashes), BLOCK_ROWS):
        part = hashes[at:at + BLOCK_ROWS, None]
        x = part if words == 1 else np.concatenate((part, mixed(part ^ salts[:, 1:])), axis=1)
        pad = -len(x) % 255
        if pad:
            x = np.concatenate((x, np.zeros((pad, words), np.uint64)))
        x = x.reshape(-1, 255, words)
        for bit in range(8):
            lanes = ((x >> np.uint64(bit)) & LANES).sum(axis=1, dtype=np.uint64)  # at most 255 in each byte
            counts[:, bit, :] += lanes.view(np.uint8).reshape(-1, words, 8).sum(axis=0, dtype=np.int64)
    over = (2 * counts > len(hashes)).astype(np.uint8)  # bit b of byte y is bit 8 * y + b
    packed = (over << np.arange(8, dtype=np.uint8)[None, :, None]).sum(axis=1, dtype=np.uint8)
    return np.ascontiguousarray(packed).view(np.uint64).reshape(words)


def _fingerprint(size: int, words: int, distinct: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, words), dtype=np.uint64)
            for row in range(batch.num_rows):
                hashes = shingle_hashes(batch.column(0)[row].as_py().encode(), size)
                if len(hashes):
                    out[row] = majority(np.unique(hashes) if distinct else hashes, words)
            fp = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, words), pa.int32()), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([fp, *batch.columns[1:]], ["fp", *batch.schema.names[1:]])

    return task


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1, distinct: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, an array of ``words`` longs; a text without words has fingerprint zero."""
    rows = docs.select(text_or_empty(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    return rows.mapInArrow(_fingerprint(size, words, distinct), "fp array<long>, doc_id long").select("doc_id", "fp")


def _meet(asking: DataFrame, table: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Pairs within two bits whose keys agree, and the fingerprints that ask or fill a key of over ``bucket``."""
    hot = table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))).between(1, 2)
    cold = asking.join(hot, "key", "left_anti").join(table.withColumnRenamed("fp", "other").join(hot, "key", "left_anti"), "key")
    crowd = asking.join(hot, "key", "left_semi").select("fp").unionByName(table.join(hot, "key", "left_semi").select("fp")).distinct()
    return cold.where(near).select(F.col("fp").alias("a"), F.col("other").alias("b")), crowd


def _masks(bits: int) -> Column:
    """An array of longs with one bit set each."""
    return F.array(*[F.lit(x).cast("long") for x in np.left_shift(np.int64(1), np.arange(bits)).tolist()])


def exact_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` (long) within two bits of each other."""
    left, right = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    flips = F.filter(F.transform(_masks(32), left.bitwiseOR), lambda x: x != left)
    ask_left = fps.select("fp", F.explode(F.array_append(flips, left)).alias("key"))
    pairs_left, crowd_left = _meet(ask_left, fps.select("fp", left.alias("key")), bucket)
    by_right = fps.select("fp", right.alias("key"))
    pairs_right, crowd_right = _meet(by_right, by_right, bucket)
    crowd = crowd_left.unionByName(crowd_right).distinct()
    around = F.array_append(F.transform(_masks(64), lambda m: F.col("fp").bitwiseXOR(m)), F.col("fp"))
    meeting = crowd.select("fp", F.explode(around).alias("mid")).withColumn("least", F.min("fp").over(Window.partitionBy("mid")))  # at most 65 rows each
    stars = meeting.where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return pairs_left.unionByName(pairs_right).unionByName(stars)


def group(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id of the component).

    Fingerprints of runs of ``size`` words, repeats included, link at two bits or fewer.  NULL,
    empty and blank texts have fingerprint zero and link like any other.  Repeated rows share a
    component; NULL ids count last, so a component of NULL ids alone has a NULL id.  Other columns
    are not read; an empty table gives no rows.
    """
    rows = staged(fingerprints(docs, size, 1, False, doc_id, text).select("doc_id", F.col("fp")[0].alias("fp")), "fingerprints")
    each = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = components(exact_links(each.select("fp"), bucket))
    return _label(rows, each, linked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _label(rows: DataFrame, each: DataFrame, linked: DataFrame) -> DataFrame:
    """Add component_id to rows with an ``fp``: the least ``first`` over the component of ``each`` fingerprint."""
    rooted = each.join(linked, each["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = staged(rooted.join(least, "root").select(F.col("fp").alias("named"), "component_id"), "named")
    return rows.join(named, rows["fp"] == named["named"]).drop("named")


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct 64-bit hashes of each text's runs of ``size`` words (of all words where there are fewer)."""
    for _, data, offsets in blocks(column):
        words, first = word_hashes(data, offsets)
        for i in range(len(offsets) - 1):
            own = words[first[i]:first[i + 1]]
            k = min(size, len(own))
            runs = np.zeros(len(own) - k + 1 if k else 0, np.uint64)
            for j in range(k):
                runs = runs * np.uint64(STEP) + own[j:j + len(runs)]
            yield np.unique(mixed(runs))
