"""Language identification by compression.

Each language has a zstandard dictionary of raw content: windows of its labelled texts.  A text is
compressed with every dictionary, and the language whose dictionary gives the smallest encoding is
its language.  Texts are encoded in blocks, so that the dictionaries and not the text itself
are what a block can refer to; a run of zero bytes after each block keeps short texts from being
stored as they are, which would make all sizes equal.  Narrow margins are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import text_or_empty

#: Texts of a language that its dictionary is made of, code points taken of each (at a hashed place), and languages that are learned
#: (those with most rows).  They bound what is collected and broadcast: 128 x 100 x 1,024 code points.
WINDOWS, WINDOW, LANGUAGES = 100, 1024, 128
#: Bytes of a text that are encoded at a time, zero bytes after them, and the level of compression.
BLOCK, PADDING, LEVEL = 8192, 64, 6
#: Least lead over the second language, as a share of the best encoding and in bytes: below it a text is rejected.
MARGIN, MARGIN_BYTES = 0.005, 2
UNKNOWN, SEED = "und", 11


@dataclass
class Model:
    """The raw content of each language's dictionary, by language."""

    content: dict[str, bytes]
    level: int = LEVEL


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", windows: int = WINDOWS, window: int = WINDOW, languages: int = LANGUAGES, seed: int = SEED) -> Model:
    """Dictionaries from labelled rows; equal texts of a language count once, whatever their number.

    The sample is that of the smallest hashes.  A first pass estimates the distinct texts of each
    language, a second takes the windows of about twice as many texts as wanted; the number of
    windows and languages bounds what comes to the driver.
    """
    key = F.xxhash64(F.lit(seed), F.col("text"))
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(key, 0.02).alias("texts")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return Model({})
    spark = docs.sparkSession
    share = spark.createDataFrame([(r["lang"], min(1.0, (2.0 * windows + 20) / r["texts"])) for r in sizes], "lang string, share double")
    place = F.shiftrightunsigned(key, 12).cast("double") / F.lit(float(2**52))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("text")), F.greatest(F.char_length("text") - F.lit(window), F.lit(0)) + 1).cast("int")
    chosen = rows.join(F.broadcast(share), "lang").where(place < F.col("share"))  # one row a language
    taken = chosen.groupBy("lang", place.alias("place")).agg(F.min(F.substring(F.col("text"), start + 1, F.lit(window))).alias("piece"))
    found: dict[str, list[str]] = {}
    for row in taken.orderBy("lang", "place").toLocalIterator():
        own = found.setdefault(row["lang"], [])
        if len(own) < windows:
            own.append(row["piece"])
    return Model({name: "\n".join(found[name]).lower().encode() for name in sorted(found)})


def encoders(model: Model) -> list:
    """One compressor a language, in the order of their names."""
    import zstandard

    out = []
    for content in model.content.values():
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=model.level)
        out.append(zstandard.ZstdCompressor(level=model.level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def encoded_sizes(text: str, compressors: list, block: int = BLOCK) -> list[int]:
    """Bytes of the whole text under each compressor, block by block."""
    total, zeros = [0] * len(compressors), bytes(PADDING)
    for at in range(0, len(text), block):
        data = text[at:at + block].lower().encode()
        for start in range(0, len(data), block):
            part = data[start:start + block] + zeros
            for i, compressor in enumerate(compressors):
                total[i] += len(compressor.compress(part))
    return total


def _identify(model: Model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors, names = encoders(model), list(model.content)
        for batch in batches:
            best, second, size, lead, score = [], [], [], [], []
            for text, letters in zip(batch.column(0), batch.column(1), strict=True):
                sizes = np.array(encoded_sizes(text.as_py(), compressors) if letters.as_py() else [], dtype=np.int64)
                order = np.argsort(sizes, kind="stable")
                known = [names[i] for i in order[:2]] + [None, None]
                behind = sizes[order] - sizes[order[:1]]
                best.append(known[0]), second.append(known[1])
                size.append(int(sizes[order[0]]) if len(order) else None)
                lead.append(int(behind[1]) if len(order) > 1 else None)
                score.append(float(1 / np.exp2(-np.minimum(behind, 64.0)).sum()) if len(order) else 0.0)
            out = [pa.array(best, pa.string()), pa.array(second, pa.string()), pa.array(size, pa.int64()), pa.array(lead, pa.int64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*out, *batch.columns[2:]], ["best", "second", "bytes", "lead", "score", *batch.schema.names[2:]])

    return task


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", margin: float = MARGIN, margin_bytes: int = MARGIN_BYTES) -> DataFrame:
    """One row per document: doc_id, lang_pred, second, bytes, lead, score, accepted.

    lang_pred is the language of the smallest encoding (ties: the first name), ``und`` where the text is
    NULL or has no letter or no language was learned.  lead is how many bytes longer the second best
    encoding is; a text is accepted if that is ``margin_bytes`` and ``margin`` of the best one.  score is the
    weight of the best language when each byte more halves it, from 1 / languages to 1, and 0 for ``und``.  Texts of any
    length are read whole, block by block; rows that repeat come out alike.  Other columns are not read; an empty
    table gives no rows.
    """
    rows = docs.select(text_or_empty(text).alias("text"), text_or_empty(text).rlike(r"\p{L}").alias("letters"), F.col(doc_id).alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_identify(model), f"best string, second string, bytes long, lead long, score double, doc_id {kind}")
    clear = (F.col("lead") >= margin_bytes) & (F.col("lead") >= F.col("bytes") * F.lit(margin))
    return out.select("doc_id", F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"), "second", "bytes", "lead", "score",
                      (F.col("best").isNotNull() & F.coalesce(clear, F.lit(True))).alias("accepted"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: CRC32 of its id as text leaves 2 when divided by 4 (a NULL id: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows that may be learned from: a language, an id and not held out."""
    return docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
