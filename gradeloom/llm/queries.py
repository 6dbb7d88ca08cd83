"""Registered queries of the corpus operators, with their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm import (exact_dedup, fill_middle, language_id, mixing, packing, passages, quality_model, quality_rules, simhash, target_sampling,
                           token_counts, url_rules, warc)

#: The same vocabulary for the two libraries.
TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_exact_dedup", r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM rows)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents")).drop("n_points")


@query("op10_quality_rules", r"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, unnest(list_transform(range(1, len(words) - 1), lambda i: {'i': i, 'w': words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]})) AS x FROM base),
twice AS (SELECT r, x.i AS i, count(*) OVER (PARTITION BY r, x.w) AS c FROM windows),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE c > 1) GROUP BY r),
rows AS (
  SELECT base.r, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM base LEFT JOIN covered ON base.r = covered.r),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         {'symbol_share': n_symbols * 10000 // greatest(word_chars, 1), 'dup_line_share': n_dup_lines * 10000 // greatest(n_lines, 1),
          'repeat_share': n_repeat_words * 10000 // greatest(n_words, 1)} AS m
  FROM rows),
long AS (
  SELECT lang, source, unnest(['symbol_share', 'dup_line_share', 'repeat_share']) AS measure, unnest([m.symbol_share, m.dup_line_share, m.repeat_share]) AS v
  FROM judged WHERE NOT base_failed),
tops AS (
  SELECT *, (v // w) * w + w - 1 AS top FROM (SELECT *, CAST(2 ** greatest(length(bin(v)) - 6, 0) AS BIGINT) AS w FROM long)),
levels AS (
  SELECT 0 AS level, lang, source, measure, top FROM tops UNION ALL SELECT 1, lang, NULL, measure, top FROM tops
  UNION ALL SELECT 2, NULL, NULL, measure, top FROM tops),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY level, lang, source, measure ORDER BY top) AS k, count(*) OVER (PARTITION BY level, lang, source, measure) AS total
  FROM levels),
quartiles AS (
  SELECT level, lang, source, measure, max(total) AS total, min(top) FILTER (k * 4 >= total) AS q1, min(top) FILTER (k * 4 >= total * 3) AS q3
  FROM ranked GROUP BY ALL),
fence AS (
  SELECT level, lang, source, max(total) AS total, max(q3 + 3 * (q3 - q1) + 200) FILTER (measure = 'symbol_share') AS f1,
         max(q3 + 3 * (q3 - q1) + 4000) FILTER (measure = 'dup_line_share') AS f2, max(q3 + 3 * (q3 - q1) + 3000) FILTER (measure = 'repeat_share') AS f3
  FROM quartiles GROUP BY ALL),
chosen AS (
  SELECT a.lang, a.source, CASE WHEN a.total >= 50 THEN {'f1': a.f1, 'f2': a.f2, 'f3': a.f3} WHEN b.total >= 50 THEN {'f1': b.f1, 'f2': b.f2, 'f3': b.f3}
                                ELSE {'f1': c.f1, 'f2': c.f2, 'f3': c.f3} END AS f
  FROM fence a JOIN fence b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang JOIN fence c ON c.level = 2 WHERE a.level = 0)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND m.symbol_share <= coalesce(f.f1, m.symbol_share) AND m.dup_line_share <= coalesce(f.f2, m.dup_line_share)
         AND m.repeat_share <= coalesce(f.f3, m.repeat_share) AS kept
FROM judged LEFT JOIN chosen ON judged.lang IS NOT DISTINCT FROM chosen.lang AND judged.source IS NOT DISTINCT FROM chosen.source""")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The rules of the contract: host, path, verdict.
URL_RULES = """SELECT * FROM VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                     ('net', '/es/', 'block'), ('net', '/fr/', 'block') AS rules(host, path, verdict)"""


@query("op3_url_rules", r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best ON parts.r = best.r""")
def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), spark.sql(URL_RULES))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, RANKS)


@query("op5_poisson_mixing", r"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w * (CAST((SELECT sum(n) FROM sizes) AS DOUBLE) / (SELECT sum(w) FROM sizes)) / n AS rate FROM sizes),
terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
ids AS (
  SELECT row_number() OVER () AS r, *, coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, '')) AS same FROM documents),
drawn AS (SELECT *, CAST('0x' || substr(md5('20|' || same || '|1'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM ids),
counted AS (SELECT r, count(*) AS n FROM drawn JOIN terms ON drawn.source IS NOT DISTINCT FROM terms.source AND c <= u GROUP BY r),
copies AS (SELECT drawn.*, unnest(range(1, n + 1)) AS copy FROM drawn JOIN counted ON drawn.r = counted.r)
SELECT doc_id, text, lang, source, n_chars, copy, CAST('0x' || substr(md5('20|' || same || '|copy|' || copy), 1, 13) AS BIGINT) AS shuffle_key FROM copies""")
def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER, RANKS)


@query("op6_quality_model")
def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("digest")


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents"))


@query("op1_warc", r"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT html, min(page_id) AS first FROM rows GROUP BY html),
coded AS (
  SELECT page_id, strlen(rows.html) AS payload_bytes, first,
         list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) % 32 + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest
  FROM rows JOIN firsts ON rows.html = firsts.html)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM coded""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_passages")
def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


@query("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(language_id.labelled(docs)))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "accepted")


@query("op12_fill_middle", r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS hex,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents),
drawn AS (
  SELECT *, len(tokens) AS n, CAST('0x' || substr(hex, 1, 8) AS BIGINT) % (len(tokens) + 1) AS x, CAST('0x' || substr(hex, 9, 8) AS BIGINT) % (len(tokens) + 1) AS y,
         CAST('0x' || substr(hex, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) % 100 AS h4
  FROM rows),
cuts AS (
  SELECT *, array_to_string(tokens[1:least(x, y)], '') AS prefix, array_to_string(tokens[least(x, y) + 1:greatest(x, y)], '') AS middle,
         array_to_string(tokens[greatest(x, y) + 1:], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cuts""")
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query("op13_target_sampling", r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, true AS raw, coalesce(text, '') AS text FROM documents UNION ALL SELECT NULL, NULL, false, coalesce(text, '') FROM benchmark),
cut AS (
  SELECT r, doc_id, raw, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM texts),
runs AS (
  SELECT r, raw, unnest(words) AS f FROM cut UNION ALL
  SELECT r, raw, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM cut),
counted AS (SELECT r, raw, f, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
nibbles AS (
  SELECT f, list_concat([4294967295::BIGINT], flatten(list_transform(range(0, length(h) // 2), lambda i: [instr('123456789ABCDEF', substr(h, 2 * i + 2, 1)), instr('123456789ABCDEF', substr(h, 2 * i + 1, 1))]))) AS l
  FROM bytes),
hashed AS (
  SELECT f, xor(list_reduce(l, lambda c, b: xor(c >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580,
                                                        3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][xor(c, b) % 16 + 1])), 4294967295::BIGINT) % 10000 AS b
  FROM nibbles),
folded AS (SELECT r, raw, b, sum(c) AS c FROM counted JOIN hashed ON counted.f = hashed.f GROUP BY ALL),
sides AS (SELECT b, coalesce(sum(c) FILTER (raw), 0) AS s, coalesce(sum(c) FILTER (NOT raw), 0) AS t FROM folded GROUP BY b),
sums AS (SELECT sum(s) AS sn, sum(t) AS tn FROM sides),
gain AS (
  SELECT b, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sn + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (tn + 10000)::DOUBLE))) AS BIGINT) AS g FROM sides, sums),
weighed AS (SELECT r, CAST(sum(c) AS BIGINT) AS n_features, CAST(floor(sum(c * g)::DOUBLE / sum(c)::DOUBLE) AS BIGINT) AS weight FROM folded JOIN gain ON folded.b = gain.b WHERE raw GROUP BY r),
scored AS (
  SELECT cut.r, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM cut LEFT JOIN weighed ON cut.r = weighed.r WHERE raw),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 25 * n // 100 THEN k END AS rank FROM ranked""")
def op13_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = target_sampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
