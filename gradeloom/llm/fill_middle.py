"""Fill-in-the-middle: texts cut at two token boundaries and put together in another order.

The boundaries of a text are looked up in a learned rank index.  Straight segments predict the
offset of a boundary from its rank, each within a fixed error of all boundaries it covers; what a
prediction lacks is stored as one signed byte a boundary, so a lookup is a prediction plus its
residual, and exact.  Segments grow as long as a cone of slopes from their first boundary holds all
error bars (the shrinking cone of piecewise-linear indexes).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import SPACE_CHARS, text_or_empty

#: Error of a prediction (residuals fit a signed byte) and boundaries that a cone is tried on at first.
ERROR, TRY = 120, 256
#: Code points of a text whose boundaries are found at a time.
BLOCK = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, TRANSFORMED, SUFFIX_FIRST = 42, 50, 80
IS_SPACE = np.zeros(128, dtype=bool)
IS_SPACE[[ord(c) for c in SPACE_CHARS]] = True


def boundaries(text: str, block: int = BLOCK) -> np.ndarray:
    """Offsets in code points of 0 and of the end of each token: words with the white space before them, and white space at the end."""
    found, inside = [np.zeros(1, np.int64)], False
    for at in range(0, len(text), block):
        points = np.frombuffer(text[at:at + block].encode("utf-32-le"), dtype="<u4")
        word = ~((points < 128) & IS_SPACE[np.minimum(points, 127)])
        ends = np.flatnonzero(np.concatenate(([inside], word[:-1])) & ~word) + at
        found.append(ends)
        inside = bool(word[-1])
    if text:
        found.append(np.array([len(text)], np.int64))  # the last word, or the white space after it
    return np.concatenate(found)


@dataclass
class RankIndex:
    """Segments (first rank, its offset, slope) and the residual of every rank."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, rank: np.ndarray) -> np.ndarray:
        """The offsets that the segments predict."""
        rank = np.asarray(rank)
        s = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[s] + np.rint(self.slope[s] * (rank - self.first[s])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """The exact offsets of boundaries."""
        return self.predict(rank) + self.residual[np.asarray(rank)]


def _cone(offsets: np.ndarray, error: float) -> tuple[int, float]:
    """How many leading offsets one segment from the first covers within ``error``, and its slope."""
    steps = np.arange(1, len(offsets))
    rise = (offsets[1:] - offsets[0]).astype(np.float64)
    low, high = np.maximum.accumulate((rise - error) / steps), np.minimum.accumulate((rise + error) / steps)
    closed = np.flatnonzero(low > high)
    n = int(closed[0]) if len(closed) else len(steps)
    return n + 1, float((low[n - 1] + high[n - 1]) / 2) if n else 0.0


def fit(offsets: np.ndarray, error: int = ERROR, most: int = TRY) -> RankIndex:
    """An index of ascending offsets, each predicted within ``error`` (and one half for rounding)."""
    first, base, slope, at = [], [], [], 0
    while at < len(offsets):
        size = most
        while True:
            covered, tilt = _cone(offsets[at:at + size], error)
            if covered < size or at + size >= len(offsets):
                break
            size *= 2
        first.append(at)
        base.append(int(offsets[at]))
        slope.append(tilt)
        at += covered
    index = RankIndex(np.array(first, np.int64), np.array(base, np.int64), np.array(slope), np.empty(0, np.int8))
    index.residual = (offsets - index.predict(np.arange(len(offsets)))).astype(np.int8 if error < 127 else np.int64)
    return index


def _transform(error: int, transformed: int, suffix_first: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, form, prefix, middle, output = [], [], [], [], []
            for i in range(batch.num_rows):
                text, (h1, h2, h3, h4) = batch.column(0)[i].as_py(), (batch.column(c)[i].as_py() for c in range(1, 5))
                offsets = boundaries(text)
                tokens = len(offsets) - 1
                n.append(tokens)
                if not text or h3 % 100 >= transformed or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                    form.append("plain"), prefix.append(None), middle.append(None), output.append(text)
                    continue
                cuts = sorted((h1 % (tokens + 1), h2 % (tokens + 1)))
                a, b = fit(offsets, error).offset(np.array(cuts)).tolist()
                form.append("spm" if h4 % 100 < suffix_first else "psm")
                prefix.append(a), middle.append(b - a)
                head = f"{PREFIX}{text[:a]}", f"{SUFFIX}{text[b:]}"
                output.append("".join(head if form[-1] == "psm" else head[::-1]) + f"{MIDDLE}{text[a:b]}")
            out = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, batch.column(0).type)]
            yield pa.RecordBatch.from_arrays([*out, *batch.columns[5:]], ["n", "form", "prefix_chars", "middle_chars", "output", *batch.schema.names[5:]])

    return task


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, transformed: int = TRANSFORMED,
              suffix_first: int = SUFFIX_FIRST, error: int = ERROR) -> DataFrame:
    """One row per document: doc_id, text, n (tokens), form, prefix_chars, middle_chars, output.

    The cuts and the form depend on the id and the seed alone; ``transformed`` per cent of the documents change their
    order, ``suffix_first`` per cent of these put the suffix first.  A NULL text counts as empty;
    empty texts and texts that hold a mark stay plain.  A NULL id is hashed as ``null``; rows that repeat
    come out alike.  Texts of any length are walked in blocks, and the index holds one byte a boundary.  Other columns
    are not read; an empty table gives no rows.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256)
    numbers = [F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(text_or_empty(text).alias("text"), *numbers, F.col(doc_id).alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_transform(error, transformed, suffix_first), f"n long, form string, prefix_chars long, middle_chars long, output string, doc_id {kind}")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring_index(head, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring_index(F.substring_index(head, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
