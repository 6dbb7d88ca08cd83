"""Importance resampling towards a target set of texts, with an untrained pre-tokeniser for the features.

A pre-tokeniser of ``tokenizers`` (a regular-expression split, nothing is trained) cuts the
lower-cased text into words with offsets.  A window over the offsets of neighbouring words gives
runs of one and two words, whose bytes are hashed by CRC32 into buckets; the hash of a pair goes on
where that of its first word ended, so no string is built.  Histograms of all raw and all target texts
give each bucket a gain, documents weigh the floored mean gain of their runs, and Gumbel noise
hashed from the id makes the largest scores a sample in proportion to the weights.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import staged, text_or_empty
from gradeloom.operators.ordered import position

#: Buckets of the histograms, and those that the prior adds one run to each of.
BUCKETS = 10_000
#: Share of the documents that are drawn (per cent), fewest words of a document that can be, and the seed of the noise.
SHARE, LEAST_WORDS, SEED = 25, 20, 7
#: What separates words, as a pattern of the pre-tokeniser: all of ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
IS_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes of text that are cut at a time, and bytes of a word that are hashed in step with all others.
BLOCK, STEPS = 1 << 18, 40
POLYNOMIAL, ONES = 0xEDB88320, np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(SEPARATORS), behavior="removed")


@lru_cache(maxsize=1)
def crc_table() -> np.ndarray:
    """What a byte does to a CRC32 state."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), table >> np.uint32(1)).astype(np.uint32)
    return table


def crc_states(data: np.ndarray, begin: np.ndarray, end: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The CRC32 states after data[begin:end], from given states: all words take their n-th byte together."""
    table, size = crc_table(), end - begin
    order = np.argsort(-size, kind="stable")
    state, at, size = start[order], begin[order], size[order]
    live = np.searchsorted(-size, -np.arange(STEPS), side="left")  # words of more than n bytes
    for n in range(STEPS):
        m = int(live[n])
        if not m:
            break
        state[:m] = table[(state[:m] ^ data[at[:m] + n]) & np.uint32(255)] ^ (state[:m] >> np.uint32(8))
    for i in range(int(np.searchsorted(-size, -STEPS, side="left"))):  # the rest of long words
        rest = data[at[i] + STEPS:at[i] + size[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i] ^ ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def spans(lowered: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of a lower-cased text."""
    from tokenizers import PreTokenizedString

    text = PreTokenizedString(lowered.decode())
    collecting = gc.isenabled()
    gc.disable()  # many short tuples and no cycles
    try:
        _splitter().pre_tokenize(text)
        found = np.fromiter(chain.from_iterable(map(itemgetter(1), text.get_splits("original", "byte"))), dtype=np.int64).reshape(-1, 2)
    finally:
        if collecting:
            gc.enable()
    return found[:, 0], found[:, 1]


def cut(data: bytes, at: int, block: int) -> int:
    """The first separator at ``at`` or later, or the end."""
    while at < len(data):
        gaps = np.flatnonzero(IS_SEPARATOR[np.frombuffer(data[at:at + block], dtype=np.uint8)])
        if len(gaps):
            return at + int(gaps[0])
        at += block
    return len(data)


def pieces(texts: list[str], block: int = BLOCK) -> Iterator[list[tuple[int, bytes]]]:
    """Rows and their lower-cased bytes, about ``block`` bytes at a time; a longer text is cut at separators into several pieces."""
    held, total = [], 0
    for row, text in enumerate(texts):
        data, at = text.encode().lower(), 0
        while at < len(data):
            if total and total + len(data) - at > block:
                yield held
                held, total = [], 0
            end = cut(data, at + block, block)
            held.append((row, data[at:end]))
            total, at = total + end - at, end
    if held:
        yield held


def features(texts: list[str], buckets: int = BUCKETS, block: int = BLOCK) -> tuple[list[np.ndarray], np.ndarray]:
    """The buckets of each text's runs of one and two words, repeats included, and its number of words."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    words = np.zeros(len(texts), np.int64)
    last_row, last_state = -1, np.uint32(0)
    for held in pieces(texts, block):
        joined = b"\x00".join(data for _, data in held)
        begin, end = spans(joined)
        if not len(begin):
            continue
        starts = np.cumsum([0] + [len(data) + 1 for _, data in held[:-1]])
        row = np.array([r for r, _ in held])[np.searchsorted(starts, begin, side="right") - 1]
        data = np.frombuffer(joined, dtype=np.uint8)
        one = crc_states(data, begin, end, np.full(len(begin), ONES))
        before = np.concatenate((np.array([last_state], np.uint32), one[:-1]))
        paired = row == np.concatenate(([last_row], row[:-1]))
        spaced = crc_table()[(before[paired] ^ np.uint32(32)) & np.uint32(255)] ^ (before[paired] >> np.uint32(8))
        two = crc_states(data, begin[paired], end[paired], spaced)
        found = (np.concatenate((one, two)) ^ ONES) % np.uint32(buckets)
        where = np.concatenate((row, row[paired]))
        order = np.argsort(where, kind="stable")
        where, found = where[order], found[order].astype("<u4")
        cuts = np.flatnonzero(np.diff(where)) + 1
        for r, part in zip(where[np.concatenate(([0], cuts))].tolist(), np.split(found, cuts), strict=True):
            out[r].append(part)
        words += np.bincount(row, minlength=len(texts))
        last_row, last_state = int(row[-1]), one[-1]
    empty = np.empty(0, "<u4")
    return [np.concatenate(parts) if parts else empty for parts in out], words


def _featurise(buckets: int):
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, words = features(batch.column(0).to_pylist(), buckets)
            packed = pa.array([f.astype(kind).tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, pa.array(words), *batch.columns[1:]], ["buckets", "n_words", *batch.schema.names[1:]])

    return task, kind


def _histogram(buckets: int, kind: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                counts += np.bincount(np.frombuffer(packed.as_buffer(), dtype=kind), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["bucket", "n"])

    return task


def histogram(rows: DataFrame, buckets: int, kind: str) -> np.ndarray:
    """Runs in each bucket over all rows; what comes to the driver has ``buckets`` rows at most."""
    table = rows.select("buckets").mapInArrow(_histogram(buckets, kind), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket."""
    s, t, n = raw.astype(np.float64), target.astype(np.float64), len(raw)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weigh(gain: np.ndarray, kind: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, packed in enumerate(batch.column(0)):
                own = np.frombuffer(packed.as_buffer(), dtype=kind)
                if len(own):
                    size[i], weight[i] = len(own), int(gain[own].sum()) // len(own)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(weight), *batch.columns[1:]], ["n_features", "weight", *batch.schema.names[1:]])

    return task


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE,
             least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, slices: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (NULL where it is not drawn).

    Of the N documents with ``least_words`` words, floor(share * N / 100) are drawn: those with the
    highest scores, ties to the smaller doc_id, NULL ids last.  Rows that repeat are drawn and
    ranked one by one, in any order among themselves.  NULL, empty and wordless texts have no runs and
    weigh 0; texts of any length are cut into pieces of BLOCK bytes.  Without target texts all buckets
    gain alike for equal counts, so frequent runs weigh less.  Other columns are not read; an empty table
    gives no rows.  Positions come from range slices, so no task orders all rows.
    """
    task, kind = _featurise(buckets)
    schema = "buckets binary, n_words long"
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("double")
    rows = docs.select(text_or_empty(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"), drawn.alias("h"))
    rows = staged(rows.mapInArrow(task, f"{schema}, doc_id long, h double"), "features")
    wanted = target.select(text_or_empty(target_text).alias("text")).mapInArrow(task, schema)
    gain = gains(histogram(rows, buckets, kind), histogram(wanted, buckets, kind))
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((F.col("h") + F.lit(0.5)) / F.lit(4294967296.0))))
    weighed = rows.select("buckets", "doc_id", "h", "n_words").mapInArrow(_weigh(gain, kind), "n_features long, weight long, doc_id long, h double, n_words long")
    scored = staged(weighed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), F.monotonically_increasing_id().alias("row")), "scores")
    able = F.col("n_words") >= least_words
    k = scored.where(able).count() * share // 100
    ranked = position(scored.where(able), [], [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")], "rank", slices)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < k, F.col("rank") + 1))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest).drop("row")
