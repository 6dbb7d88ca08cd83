"""Language identification, fill-in-the-middle and target sampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import fill_middle, language_id, queries, target_sampling

ENDS = {"aa": ["tion", "ing", "the", "and"], "bb": ["schen", "keit", "ung", "der"], "cc": ["eaux", "ment", "les", "vi"]}
ODD = [None, "", " \t\n", "12 34 !?", "one", "é" * 300 + " x " + "y" * 90, "a\x00b C\x7fd É", "tail  ", "  head", "<P> a <S>", "😀 b 😀"]


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(ENDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def frame(spark, rows):
    """doc_id, text, lang and columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, g, "own", 1) for i, t, g in rows], "doc_id long, text string, lang string, score string, rank int")


def corpus(spark):
    rng = random.Random(4)
    rows = [(i, prose(lang, rng.choice([3, 20, 200]), rng), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000 + i, t, "aa") for i, t in enumerate(ODD)] + [(None, prose("bb", 30, rng), "bb"), (None, None, None)]
    rows += [(2000, prose("cc", 60_000, rng), "cc")] + [(2001, "ment les vi " * 10, "cc")] * 3
    return frame(spark, rows), rows


# ---- language --------------------------------------------------------------------------------------
def test_languages_of_held_out_documents_by_whole_texts(spark):
    docs, rows = corpus(spark)
    model = language_id.fit(language_id.labelled(docs))
    assert sorted(model.content) == ["aa", "bb", "cc"]
    got = language_id.identify(docs, model).collect()
    assert len(got) == len(rows)
    compressors, names = language_id.encoders(model), list(model.content)
    texts = {i: t for i, t, _ in rows if i is not None}
    wrong = 0
    for r in got:
        if r.doc_id is None:
            continue
        text = texts[r.doc_id] or ""
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        sizes = []
        for c in compressors:
            data = [text[at:at + language_id.BLOCK].lower().encode() for at in range(0, len(text), language_id.BLOCK)]
            parts = [d[x:x + language_id.BLOCK] + bytes(language_id.PADDING) for d in data for x in range(0, len(d), language_id.BLOCK)]
            sizes.append(sum(len(c.compress(p)) for p in parts))
        assert names[sizes.index(min(sizes))] == r.lang_pred and 0 < r.score <= 1
        assert r.accepted == (r.lead >= language_id.MARGIN_BYTES and r.lead >= r.bytes * language_id.MARGIN)
        if r.doc_id < 180 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2:
            wrong += r.lang_pred != ["aa", "bb", "cc"][r.doc_id % 3]
    assert wrong <= 1


def test_held_out_documents_unlabelled_and_null_ids_are_not_learned(spark):
    docs, rows = corpus(spark)
    flags = {r.doc_id: r.h for r in docs.select("doc_id", language_id.held_out().alias("h")).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows if i is not None) and flags[None] is False
    learned = language_id.labelled(docs)
    assert learned.columns == ["text", "lang"]
    want = sum(1 for i, _, g in rows if i is not None and g is not None and zlib.crc32(str(i).encode()) % 4 != 2)
    assert learned.count() == want
    shown = language_id.identify(docs.withColumn("lang", F.lit("zz")), language_id.fit(language_id.labelled(docs)))
    assert {r.lang_pred for r in shown.collect()} <= {"aa", "bb", "cc", "und"}


def test_language_samples_are_bounded_and_copies_count_once(spark):
    rng = random.Random(5)
    rows = [(i, "der keit ung " * 40, "bb") for i in range(900)] + [(1000 + i, prose("bb", 30, rng), "bb") for i in range(300)] + [(5000, prose("aa", 5, rng), "aa")]
    model = language_id.fit(frame(spark, rows), windows=50, window=64)
    pieces = model.content["bb"].split(b"\n")
    assert len(pieces) == 50 and max(map(len, pieces)) <= 64 and len(set(pieces)) == 50
    assert list(language_id.fit(frame(spark, rows), languages=1).content) == ["bb"]


def test_language_of_nothing(spark):
    empty = frame(spark, [])
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    unlabelled = language_id.identify(frame(spark, [(1, "the", None)]), language_id.fit(empty)).first()
    assert (unlabelled.lang_pred, unlabelled.score) == ("und", 0.0)
    one = language_id.fit(frame(spark, [(1, "the and", "aa")]))
    assert language_id.identify(frame(spark, [(2, "the", None)]), one).first().lang_pred == "aa"


def test_held_out_accuracy_of_the_query(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op11_language_id"](spark, sf).collect()}
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.lang and re.search(r"[^\W\d_]", r.text or "")]
    held = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 20 and sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)


# ---- fill in the middle ------------------------------------------------------------------------------
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def filled(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, len(tokens), "plain", None, None, text)
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    spm = h4 % 100 < 80
    return (doc_id, len(tokens), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_is_that_of_the_rules_and_comes_back(spark):
    docs, rows = corpus(spark)
    made = fill_middle.transform(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = made.collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(repr(filled(i, t)) for i, t, _ in rows)
    texts = {i: t for i, t, _ in rows if i is not None}
    assert all(r.back == (texts[r.doc_id] or "") for r in got if r.doc_id is not None)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(frame(spark, [])).count() == 0


def test_all_documents_in_either_order(spark):
    docs, rows = corpus(spark)
    for first, form in ((0, "psm"), (100, "spm")):
        made = fill_middle.transform(docs, transformed=100, suffix_first=first)
        back = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).join(docs.select("doc_id", "text"), "doc_id")
        assert back.where("back <> coalesce(text, '')").count() == 0
        assert {r.form for r in made.collect()} == {"plain", form}


@pytest.mark.parametrize("error", [0, 3, 120])
def test_rank_index_is_exact_and_bounded(error):
    rng = random.Random(error)
    texts = ["a b", "", " ", "x" * 5000 + " y", " ".join("w" * rng.choice([1, 2, 900]) for _ in range(4000)), " \n".join("é😀"[rng.random() < 0.5] * rng.randint(1, 9) for _ in range(3000))]
    for text in texts:
        want = [0] + [m.end() for m in TOKEN.finditer(text)]
        for block in (1 << 20, 7):
            assert fill_middle.boundaries(text, block).tolist() == want
        index = fill_middle.fit(np.array(want), error)
        ranks = np.arange(len(want))
        assert index.offset(ranks).tolist() == want
        assert np.abs(index.residual.astype(int)).max() <= error + 1 and index.residual.dtype == np.int8
        assert len(index.first) <= len(want) and (np.diff(index.first) > 0).all()


# ---- target sampling -----------------------------------------------------------------------------------
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    words = WORD.findall((text or "").encode().lower().decode())
    return words, [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def sampled(rows, targets):
    own = [(i, *runs(t)) for i, t, _ in rows]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, _, f in own:
        np.add.at(s, f, 1)
    for text in targets:
        np.add.at(t, runs(text)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    out = []
    for i, words, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:25 * len(able) // 100]):
        r[5] = k + 1
    return out


def test_target_sample_agrees_with_brute_force(spark):
    docs, rows = corpus(spark)
    targets = [prose("bb", 40, random.Random(i)) for i in range(20)] + [None, ""]
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    got = sorted(repr(list(r)) for r in target_sampling.resample(docs, target).collect())
    assert got == sorted(repr(r) for r in sampled(rows, targets))


def test_target_sample_of_ties_copies_and_nothing(spark):
    rows = [(7, "w " * 25, "aa")] * 40 + [(None, "v " * 25, "aa")] * 8
    none = spark.createDataFrame([], "text string")
    got = target_sampling.resample(frame(spark, rows), none).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 13)) and len(got) == 48
    assert target_sampling.resample(frame(spark, []), none).count() == 0
    wordless = target_sampling.resample(frame(spark, [(1, None, None), (2, "", None), (3, "?!", None)]), none).collect()
    assert [(r.n_features, r.weight, r.rank) for r in wordless] == [(0, 0, None)] * 3


@pytest.mark.parametrize("block", [1 << 18, 64, 7])
def test_runs_do_not_depend_on_the_blocks(block):
    rng = random.Random(2)
    texts = [t or "" for t in ODD] + [prose("cc", 50, rng), "z" * 500 + " end", "a b " * 40]
    found, words = target_sampling.features(texts, block=block)
    assert [(sorted(f.tolist()), int(n)) for f, n in zip(found, words, strict=True)] == [(sorted(runs(t)[1]), len(runs(t)[0])) for t in texts]
