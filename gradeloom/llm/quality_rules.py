"""Quality rules whose thresholds come from the data of each language and source.

Every measure is counted in buckets of a log-linear histogram.  Such histograms add up, so one
aggregation per (language, source) also serves a language and the whole corpus.  A document
fails when a measure lies beyond the far fence of its own group; small groups use the next
coarser one.  All of it is built-in functions: measures are taken inside the row, and only
bucket counts and fences are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.llm.common import SPACE, SPACE_CHARS, staged, text_or_empty
from gradeloom.llm.exact_dedup import without_space

#: Fewest words, and the largest share of repeated words, of a document that passes the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A fence lies this many quartile distances above the third quartile, plus the slack of its measure.
FENCE = 3
#: Smallest group that gets thresholds of its own.
MIN_GROUP = 50
#: Values below 2**BITS have buckets of their own; above, buckets are 2**(1 - BITS) of their value wide.
BITS = 6
#: Measures in parts of 10,000 and the slack that a fence always leaves.
SLACK = {"symbol_share": 200, "dup_line_share": 4000, "repeat_share": 3000}


def measures(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    NULL counts as empty and has no words.  Equal windows of three words are found by their 64-bit
    hash inside one document.
    """
    whole = text_or_empty(text)
    base = docs.select(*keep, whole.alias("_text"), F.btrim(whole, F.lit(SPACE_CHARS)).alias("_body"))
    cut = base.select(*keep, F.char_length(without_space(F.col("_text"))).cast("long").alias("word_chars"),
                      F.char_length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                      F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("_lines"),
                      F.when(F.col("_body") != "", F.split("_body", f"[{SPACE}]+", -1)).otherwise(F.array().cast("array<string>")).alias("_words"))
    n = F.size("_words")
    w = F.col("_words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    rows = cut.select(*keep, "word_chars", "n_symbols", n.cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"),
                      (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), windows.alias("_windows"))
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    ordered = F.when(repeats, F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    rows = rows.select("*", ordered.alias("_ordered")).drop("_windows")
    s = F.col("_ordered")
    twin = lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
    starts = F.transform(F.filter("_ordered", twin), lambda x: x["i"])
    rows = rows.select("*", starts.alias("_starts")).drop("_ordered")
    at = F.col("_starts")
    covered = F.size(F.array_union(F.array_union(at, F.transform(at, lambda p: p + 1)), F.transform(at, lambda p: p + 2)))
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                       F.when(at.isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def _share(part: str, whole: str) -> Column:
    return F.floor(F.col(part) * 10000 / F.greatest(F.col(whole), F.lit(1))).cast("long")


def bucket(value: Column) -> Column:
    """The largest value that shares a bucket with ``value`` (a long of at least 0)."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    width = F.pow(F.lit(2.0), shift).cast("long")
    return (F.floor(value / width) * width + width - 1).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """Bucket counts of each measure per (lang, source), per language and over all: level, lang, source, measure, top, n."""
    long = rows.select("lang", "source", F.explode(F.create_map(*[x for m in SLACK for x in (F.lit(m), bucket(F.col(m)))])).alias("measure", "top"))
    fine = long.groupBy("lang", "source", "measure", "top").agg(F.count(F.lit(1)).alias("n"))
    level = F.posexplode(F.array(F.struct("lang", "source"), F.struct("lang", F.lit(None).cast("string").alias("source")),
                                 F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))))
    spread = fine.select(level.alias("level", "group"), "measure", "top", "n")
    return spread.groupBy("level", F.col("group.lang").alias("lang"), F.col("group.source").alias("source"), "measure", "top").agg(F.sum("n").alias("n"))


def fences(counts: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source): the fence of each measure, from the finest level with ``min_group`` documents."""
    group = ["level", "lang", "source", "measure"]
    upto = Window.partitionBy(*group).orderBy("top")
    ranked = counts.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy(*group)).alias("total"))
    at = lambda quarter: F.min(F.when(F.col("upto") * 4 >= F.col("total") * quarter, F.col("top")))
    quartiles = ranked.groupBy(*group).agg(F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))
    slack = F.create_map(*[F.lit(x) for pair in SLACK.items() for x in pair])[F.col("measure")]
    wide = quartiles.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"), *[F.max(F.when(F.col("measure") == m, F.col("q3") + FENCE * (F.col("q3") - F.col("q1")) + slack)).alias(m) for m in SLACK])
    wide = staged(wide, "fences")
    by = {k: wide.where(F.col("level") == k).select(*keys, F.struct("total", *SLACK).alias(f"l{k}")) for k, keys in ((0, ["lang", "source"]), (1, ["lang"]))}
    lang = by[1].withColumnRenamed("lang", "lang_1")
    corpus = wide.where("level = 2").first()
    rows = by[0].join(lang, F.col("lang").eqNullSafe(F.col("lang_1")), "left")
    rows = rows.withColumn("l2", F.struct(*[F.lit(corpus[c] if corpus else None).cast("long").alias(c) for c in ("total", *SLACK)]))
    use = F.when(F.col("l0.total") >= min_group, F.col("l0")).when(F.col("l1.total") >= min_group, F.col("l1")).otherwise(F.col("l2"))
    return rows.select("lang", "source", use.alias("f")).select("lang", "source", *[F.col(f"f.{m}").alias(f"{m}_fence") for m in SLACK])


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
          min_group: int = MIN_GROUP) -> DataFrame:
    """One row per document: its measures, base_failed, the fences of its group and kept.

    base_failed: fewer than 50 words, or over 50 % of the words in repeated windows of three words.
    NULL languages or sources form groups of their own; rows that repeat count each time.  An
    empty table gives no rows.  Only the four named columns are read, so others may have any name.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"),
                        F.col(text).alias("_whole"))
    rows = measures(named, "doc_id", "lang", "source", text="_whole")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = staged(rows.select("*", failed.alias("base_failed"), _share("n_symbols", "word_chars").alias("symbol_share"),
                              _share("n_dup_lines", "n_lines").alias("dup_line_share"), _share("n_repeat_words", "n_words").alias("repeat_share")), "measures")
    limits = staged(fences(sketches(rows.where("not base_failed")), min_group), "fences")
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    on = rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"])
    within = F.lit(True)
    for m in SLACK:
        within = within & (F.col(m) <= F.coalesce(F.col(f"{m}_fence"), F.col(m)))
    return rows.join(limits, on, "left").drop("_lang", "_source").withColumn("kept", ~F.col("base_failed") & within)


def keep_good(docs: DataFrame, **names: str) -> DataFrame:
    """The documents that pass, with all their columns; rows with the same id and text are judged alike."""
    doc_id, text = names.get("doc_id", "doc_id"), names.get("text", "text")
    mark = F.sha2(text_or_empty(text), 256)
    plain = docs.select(F.struct(F.col(doc_id).alias("id"), mark.alias("digest"), F.col(names.get("source", "source")).alias("s"), F.col(names.get("lang", "lang")).alias("l")).alias("doc_id"),
                        F.col(text).alias("text"), F.col(names.get("lang", "lang")).alias("lang"), F.col(names.get("source", "source")).alias("source"))
    good = judge(plain).where("kept").select(F.col("doc_id").alias("_good")).dropDuplicates()
    key = F.struct(F.col(doc_id).alias("id"), mark.alias("digest"), F.col(names.get("source", "source")).alias("s"), F.col(names.get("lang", "lang")).alias("l"))
    return docs.join(good, key.eqNullSafe(F.col("_good")), "left_semi")
