"""Exact dedup, quality rules, URL rules, mixing: edge cases and brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import exact_dedup, mixing, quality_rules, url_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "mine", "own") for i, t, s in rows], SCHEMA)


ROWS = [(5, "a b\tc", "x"), (3, "abc", "x"), (9, "a  b c", "y"), (1, None, "x"), (2, "", None), (4, " \n\v", "x"), (None, "abc", "x"), (7, "A bc", "y"),
        (8, "q", "y"), (8, "q", "y"), (10, " ", "x"), (11, "z" * 300_000, "x"), (None, None, "x")]


def expected(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for key, members in groups.items():
        n, none, keep = min((-len(t), i is None, i or 0) for i, t in members)
        keep = None if none else keep
        out += [(i, keep, len(members), i == keep and len(t) == -n, hashlib.sha256(key.encode()).hexdigest()) for i, t in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [1, 2, 512])
def test_exact_dedup_marks_as_brute_force_does(spark, counters):
    rows = ROWS + [(i, "hot text", "x") for i in range(100, 160)]
    got = exact_dedup.mark(frame(spark, rows), counters=counters).drop("n_points").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)


def test_exact_dedup_keeps_one_row_of_each_text_and_all_columns(spark):
    docs = frame(spark, ROWS)
    got = exact_dedup.dedup(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert len(kept) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in ROWS})
    assert {r.kept for r in kept} == {"mine"}
    assert exact_dedup.dedup(docs.where("false")).count() == 0
    assert exact_dedup.mark(docs.where("false")).count() == 0


def test_misra_gries_never_misses_a_heavy_key(spark):
    rng = random.Random(1)
    keys = [rng.randrange(400) for _ in range(3000)] + [1001] * 700 + [1002] * 500
    rng.shuffle(keys)
    found = {r.k for r in exact_dedup.heavy_candidates(spark.createDataFrame([(k,) for k in keys], "k long").repartition(7), "k", 10).collect()}
    assert len(found) <= 10
    assert found >= {k for k, n in Counter(keys).items() if n > len(keys) / 11}


def measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_measures_match_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n ", "a", "a b", "a a a", "a a a a", "x y z x y z\nx y z\n\nx y z", "    b", "é# <b> |\r\n|", "\n".join(["same line"] * 40)]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))).replace(" ", rng.choice([" ", "\n", "\t", "  "]), 7) for _ in range(60)]
    texts.append(" ".join(str(rng.randrange(50)) for _ in range(30_000)))
    got = quality_rules.measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id").collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measure(texts[r.doc_id]), texts[r.doc_id]


def test_rules_adapt_to_each_source(spark):
    rng = random.Random(3)
    clean = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(80))
    code = lambda: " ".join(f"{rng.choice(['<', '>', '&'])}w{rng.randrange(10_000)}" for _ in range(80))
    rows = [(i, clean(), "prose") for i in range(200)] + [(1000 + i, code(), "markup") for i in range(200)] + [(5000, code(), "prose"), (5001, None, None), (5002, clean(), None)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert all(kept[i] for i in range(200)) and all(kept[1000 + i] for i in range(200))
    assert not kept[5000] and not kept[5001] and kept[5002]
    assert quality_rules.judge(frame(spark, rows).where("false")).count() == 0
    good = quality_rules.keep_good(frame(spark, rows))
    assert good.columns == SCHEMA.replace(",", "").split()[::2] and good.count() == sum(kept.values())


def best_rule(host, path, rules):
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits) if fits else None


@pytest.mark.parametrize("slices", [1, 5])
def test_url_rules_match_brute_force(spark, slices):
    rng = random.Random(4)
    labels = ["a", "b", "com", "x-y", "a0"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, n)))
    path = lambda: rng.choice(["", "/", "/a", "/a/", "/a/b", "/b"])
    rules = [(host(4), path(), rng.choice(["allow", "block"])) for _ in range(40)] + [(None, "/", "block"), ("com", None, "allow")]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{host(6)}{path()}{rng.choice(['', '?q=://x', '#f'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "http://A.COM/É", "://com", "http://com" + "/a" * 50_000] + ["http://a.com/"] * 50
    pages = spark.createDataFrame([(i % 300, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = Counter(tuple(r) for r in url_rules.judge(pages, table, "allow", slices=slices).collect())
    plain = [(h, p or "", v) for h, p, v in rules if h is not None]
    want = Counter()
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2]
        h = re.match(r"[^/?#]*", rest)[0]
        h = re.sub("[A-Z]", lambda m: m[0].lower(), h)
        p = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        best = best_rule(h, p, plain)
        want[(i % 300, h, p, best and best[3], best[2] if best else "allow")] += 1
    assert got == want
    assert url_rules.judge(pages.where("false"), table).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, table.where("false"), "block").collect()} == {"block"}


def test_url_rules_run_no_python(spark):
    plan = url_rules.judge(spark.createDataFrame([(1, "http://a")], "page_id long, url string"), spark.sql("SELECT 'com' AS host, '/' AS path, 'allow' AS verdict"))
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_mixing_reaches_its_weights_and_repeats_itself(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else "small") for i in range(6000)] + [(None, f"other {i}", None) for i in range(50)]
    docs = frame(spark, rows).withColumn("copy", F.lit("own"))
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0), (None, 0.0), ("absent", 9.0)], "source string, weight double")
    mixed = mixing.mix(docs, weights, total=12_000)
    assert mixed.columns == [c for c in docs.columns if c != "copy"] + ["copy", "shuffle_key"]
    got = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(got) == {"big", "small"}
    assert abs(got["big"] - 3000) < 250 and abs(got["small"] - 9000) < 450  # over four standard deviations
    key = lambda df: sorted((r.doc_id, r["copy"], r.shuffle_key) for r in df.collect())
    assert key(mixed) == key(mixing.mix(docs.repartition(5), weights, total=12_000))


def test_mixing_at_high_rates_small_tables_and_many_sources(spark, monkeypatch):
    one = frame(spark, [(1, None, "a"), (1, None, "a"), (2, "x", "b")])
    rates = {r["source"]: r.rate for r in mixing.source_rates(one, spark.createDataFrame([("a", 0.0), ("b", 1.0)], "source string, weight double"), 2500).collect()}
    assert rates == {"a": 0.0, "b": 2500.0}
    copies = mixing.mix(one, spark.createDataFrame([("b", 1.0)], "source string, weight double"), 2500).collect()
    assert abs(len(copies) - 2500) < 250 and len({r["copy"] for r in copies}) == len(copies)
    assert mixing.mix(one.where("false")).count() == 0
    docs = frame(spark, [(i, f"t{i}", f"s{i % 7}") for i in range(300)])
    plain = sorted((r.doc_id, r["copy"]) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted((r.doc_id, r["copy"]) for r in mixing.mix(docs).collect()) == plain
