"""Tokenizer paths, token counts, packing and WARC archives against the libraries and plain round trips."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict
from urllib.parse import quote

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from pyarrow import fs

from gradeloom.llm import packing, token_counts, tokens, warc
from gradeloom.llm.common import shared_folder

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "x" * 9000, " " * 5000, "ab  cd\n\n" * 700 + "<|endoftext|>" * 30 + " a <|endoftext|> b" * 100, "日本語 テキスト" * 400, "a\x85b\x1c c" * 300,
         "Ünï cödé don't  stop " * 300, "word " * 2047, "word " * 5000, "👩‍👩‍👧 é ١٢٣ " * 100]


def docs(spark, texts=TEXTS):
    rows = [(i if i else None, t, "own") for i, t in enumerate(texts)] + [(7, "repeated row", "own")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def library(text):
    return tokens.tokenizer(JSON).encode(text or "", add_special_tokens=False).ids


def test_both_libraries_agree_on_every_pair_of_plain_characters():
    plain = [chr(c) for c in range(0x2030) if tokens.is_plain(chr(c))]
    texts = ["".join(x + y + z for y in plain) for x in plain for z in ("", " ", "a", "1", "\n ", "'s")]
    for at in range(0, len(texts), 200):
        for text, e in zip(texts[at:at + 200], tokens.tokenizer(JSON).encode_batch(texts[at:at + 200], add_special_tokens=False), strict=True):
            assert e.ids == tokens._ranks(RANKS).encode_ordinary(text)
            assert [a for a, _ in e.offsets] == tokens.token_starts(text, JSON, RANKS).tolist()


@pytest.mark.parametrize("ranks", [None, RANKS])
@pytest.mark.parametrize(("long", "chunk", "overlap"), [(200, 150, 12), (32_768, 16_384, 256)])
def test_token_counts_are_the_library_s(spark, ranks, long, chunk, overlap):
    df = docs(spark)
    got = Counter(tuple(r) for r in token_counts.count_tokens(df, JSON, ranks, long=long, chunk=chunk, overlap=overlap).collect())
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library(r.text)), len(library(r.text)) > 512) for r in df.collect())
    assert got == want
    assert token_counts.count_tokens(df.where("false"), JSON, ranks).count() == 0


def test_a_tokenizer_without_proven_places_encodes_whole_texts(spark):
    path = P.path("word_bpe_49k.json")
    assert token_counts.splits_at_spaces(JSON) and not token_counts.splits_at_spaces(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark), path, long=100).where("doc_id is not null").collect()}
    assert got[8] == len(tokens.tokenizer(path).encode(TEXTS[8], add_special_tokens=False).ids)


@pytest.mark.parametrize("merge_bins", [3, 10_000])
def test_packing_round_trip(spark, merge_bins):
    df = docs(spark)
    plan = packing.pack(df, JSON, RANKS, with_ids=True, merge_bins=merge_bins).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in plan:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        pieces[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for i, text in enumerate(TEXTS):
        if i in (0, 7):
            continue
        ids = library(text) + [0]
        parts = sorted(pieces[i])
        assert b"".join(p[3] for p in parts) == struct.pack(f"<{len(ids)}I", *ids)
        assert [p[0] for p in parts] == list(range(len(parts))) and [p[1] for p in parts] == list(np.cumsum([0] + [p[2] for p in parts[:-1]]))
        assert all(p[2] == 2048 for p in parts[1:])
    assert len(pieces[7]) == 2 + len(list(packing.cut(len(library(TEXTS[7])) + 1, 2048)))  # each repeated row is packed
    assert len(pieces[None]) == 1
    assert packing.pack(df.where("false"), JSON, RANKS).count() == 0


def test_packing_comes_close_to_the_least_number_of_sequences(spark):
    rng = random.Random(5)
    many = docs(spark, ["w " * rng.randrange(1, 1500) for _ in range(1500)]).repartition(12)
    plan = packing.pack(many, JSON, RANKS)
    total = sum(r.length for r in plan.collect())
    assert plan.select("sequence_id").distinct().count() <= math.ceil(total / 2048 * 1.01) + 1
    sizes = packing.sequences(packing.pack(many, JSON, RANKS, with_ids=True)).collect()
    assert sum(r.n_tokens for r in sizes) == total and all(len(r.ids) == 4 * r.n_tokens for r in sizes)


def test_best_fit_never_overfills_and_beats_no_bound():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 101, 300)
        found = packing.best_fit(sizes, 100)
        fill = np.bincount(found, weights=sizes)
        assert fill.max() <= 100 and fill.min() > 0
        assert len(fill) <= 11 / 9 * math.ceil(sizes.sum() / 100) + 4


def pages(spark):
    rows = [(4, "http://a/ü\r\n", "same"), (2, None, "same"), (9, "http://b/", None), (3, "http://c/", ""), (1, "http://d/", "é" * 400_000), (4, "http://a/", "same"),
            (None, "http://e/", "same"), (None, "http://f/", "alone"), (2, "http://g/", "same"), (5, "http://h/", "\r\n\r\nWARC/1.1\r\n")]
    return spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("split", [64, 1000, 1 << 30])
def test_warc_round_trip(spark, split):
    got = warc.read(warc.write(pages(spark), rotate=2000), split)
    rows = got.collect()
    assert all(r.error is None for r in rows)
    want = Counter()
    for r in pages(spark).collect():
        body = (r.html or "").encode()
        first = min((p.page_id for p in pages(spark).collect() if (p.html or "") == (r.html or "") and p.page_id is not None), default=None)
        again = first is not None and r.page_id != first
        want[(r.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None, b"" if again else body)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in rows) == want


@pytest.mark.parametrize("split", [1000, 1 << 30])
def test_urls_of_any_length_keep_their_pages(spark, split):
    urls = ["data:text/html," + "a1b2" * 25_000, "http://e/" + "語" * 100_000, "data:," + hashlib.sha512(b"u").hexdigest() * 1000, "http://e/short"]
    rows = [(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)]
    got = warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), split).collect()
    assert sorted((r.page_id, r.target_uri, bytes(r.payload).decode(), r.error) for r in got) == [(i, quote(u, safe=":/,"), h, None) for i, u, h in rows]


def test_warc_of_nothing(spark):
    archives = warc.write(pages(spark).where("false"))
    assert archives.count() == 0 and warc.read(archives).count() == 0


def put(folder, name, data):
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    with store.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(data)


@pytest.mark.parametrize("split", [300, 977, 5000, 1 << 30])
def test_archives_inside_payloads_are_not_taken_for_records(spark, split):
    rng = random.Random(3)
    bodies = [rng.randbytes(rng.randrange(3000)) for _ in range(40)]
    for i in range(0, 40, 5):
        inner = b"".join(warc.record(9000 + j, "http://x/", rng.randbytes(200), None, False) for j in range(20))
        bodies[i] = rng.randbytes(500) + inner + rng.randbytes(100)
    folder = shared_folder(spark, "nested")
    put(folder, "a.warc.gz", b"".join(warc.record(i, f"http://e/{i}", b, None, False) for i, b in enumerate(bodies)))
    rows = warc.read(warc.archives_in(spark, folder), split).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in rows) == list(enumerate(bodies))


@pytest.mark.parametrize("split", [977, 1 << 30])
def test_damage_costs_only_the_damaged_record_and_is_reported(spark, split):
    rng = random.Random(4)
    records = [warc.record(i, None, rng.randbytes(1500), None, False) for i in range(30)]
    data = bytearray(b"".join(records))
    at = sum(map(len, records[:7])) + 600
    data[at:at + 80] = bytes(80)
    folder = shared_folder(spark, "damaged")
    put(folder, "a.warc.gz", bytes(data))
    rows = warc.read(warc.archives_in(spark, folder), split).collect()
    assert sorted(r.page_id for r in rows if r.error is None) == [i for i in range(30) if i != 7]
    assert any(r.error for r in rows)


def test_ranges_are_dealt_over_tasks(spark):
    from gradeloom.llm import warc

    rows = spark.range(200).select(F.lit("path").alias("path"), F.col("id").cast("int").alias("number"), F.lit(0).cast("long").alias("start"))
    dealt = warc.spread(rows).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(dealt) > 100 and max(r["count"] for r in dealt) < 10
