"""The pipeline, stage by stage against brute force, and the registered queries of the corpus operators."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gradeloom.llm import common, exact_dedup, mixing, tokens
from gradeloom.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], sf), name))
    return out


def test_stages_are_the_dealt_ones(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_model", "exact_dedup", "simhash_near_dedup", "poisson_mixing", "best_fit_packing"]
    assert all(s.columns == COLUMNS for s in stages[:5])


def test_quality_stage_keeps_clean_documents(spark, sf, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = ({r.doc_id for r in s.select("doc_id").collect()} for s in stages[:2])
    assert after < before
    good = [i for i in before if labels.get(i) == 1]
    assert sum(i in after for i in good) >= 0.98 * len(good)


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text)


def test_exact_stage_keeps_the_longest_of_equal_texts(stages):
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    best = {}
    for i, t in before:
        best[bare(t)] = min(best.get(bare(t), (1, 0)), (-len(t), i))
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(i for _, i in best.values())


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_stage_leaves_no_alike_pair_and_drops_only_alike_texts(stages):
    before = {r.doc_id: shingles(r.text) for r in stages[2].collect()}
    after = {r.doc_id for r in stages[3].collect()}
    alike = defaultdict(float)
    ids, missed = sorted(before), 0
    for n, a in enumerate(ids):
        for b in ids[:n]:
            j = len(before[a] & before[b]) / len(before[a] | before[b])
            if j >= 0.7:
                alike[a], alike[b] = max(alike[a], j), max(alike[b], j)
                missed += j >= 0.8 and a in after and b in after
    assert all(alike[i] >= 0.8 for i in set(before) - after)
    assert missed <= 0.1 * len(set(before) - after)


def test_mixing_stage_draws_by_the_inverse_poisson_distribution(stages):
    rows = [(r.doc_id, r.text, r.source) for r in stages[3].collect()]
    sizes = Counter(s for _, _, s in rows)
    weight = {s: n ** 0.5 for s, n in sizes.items()}
    want = Counter()
    for i, t, s in rows:
        rate = weight[s] * (len(rows) / sum(weight.values())) / sizes[s]
        same = f"{i}|{hashlib.md5(t.encode()).hexdigest()}"
        u = int(hashlib.md5(f"{mixing.SEED}|{same}|1".encode()).hexdigest()[:13], 16) / 2**52
        term, total, k = math.exp(-rate), math.exp(-rate), 0
        while total <= u:
            k += 1
            term *= rate / k
            total += term
        if k:
            want[i] = k
    assert Counter(r.doc_id for r in stages[4].collect()) == want


def test_packing_stage_holds_every_token_of_every_copy(stages):
    json_path = P.path("byte_bpe_50k.json")
    want = Counter()
    for r in stages[4].collect():
        ids = np.array([*tokens.tokenizer(json_path).encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        for n, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start:first if n == 0 else start + 2048]
            want[(r.doc_id, n, start, len(part), zlib.crc32(part.tobytes()))] += 1
    rows = stages[5].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= math.ceil(sum(filled.values()) / 2048) * 1.05 + 1


@pytest.mark.parametrize("rows", [[], [(None, None)] * 3, [(i, None) for i in range(5)], [(1, "the same text " * 20)] * 4 + [(None, ""), (2, " ")], [(1, "x " * 30_000), (2, "y")]])
def test_stages_take_empty_null_repeated_and_long_rows(spark, sf, rows):
    own = [(i, t, "en", "s", 1, f"c{n}", n, "d", 1.5, "k") for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long, copy string, row_number int, text_digest string, shuffle_key double, kept_id string")
    before = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf), name)
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "row_number", "text_digest", "shuffle_key", "kept_id"]
            assert {tuple(r) for r in docs.collect()} <= before
    assert docs.count() >= 0


def test_exact_stage_keeps_one_of_rows_that_tie(spark):
    rows = [(1, "a b c", "x"), (1, "ab  c", "y"), (1, "a  bc", "z"), (None, "q r", "x"), (None, "qr ", "y"), (2, "abc", "x")] + [(i, "heavy  text", "h") for i in range(3, 2003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    for counters in (1, 512):
        got = exact_dedup.dedup(docs, counters=counters).collect()
        assert sorted((r.doc_id or 0, bare(r.text)) for r in got) == [(0, "qr"), (1, "abc"), (3, "heavytext")]


def test_heavy_losers_do_not_reach_the_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(i, "heavy  text") for i in range(5000)] + [(9000 + i, f"text {i}") for i in range(50)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = exact_dedup.dedup(spark.read.parquet(str(tmp_path / "docs")))
    plan = out._jdf.queryExecution().executedPlan()
    assert len(out.collect()) == 51
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    sizes = []
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        while node.nodeName().endswith("QueryStage"):
            node = node.plan()
        if node.nodeName() == "Exchange":
            sizes.append(node.metrics().apply("shuffleRecordsWritten").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert sizes and max(sizes) <= 60, sizes


def test_staged_tables_of_a_finished_step_are_freed(spark, tmp_path):
    import os

    df = staged(spark.range(5), "freed")
    folder = common.STAGED[-1]
    common.free(spark, [folder], df)
    assert df.count() == 5  # still read
    common.free(spark, [folder, "/no/such"])
    assert not os.path.exists(folder.removeprefix("file:")) and folder not in common.STAGED


OWN = sorted(k for k in entry.queries() if re.match(r"op\d+_|pipeline$", k))


def test_all_dealt_operators_are_registered():
    assert {int(re.match(r"op(\d+)", k)[1]) for k in OWN if k != "pipeline"} == set(range(1, 14)) and "pipeline" in OWN


@pytest.mark.parametrize("name", OWN)
def test_corpus_query(name, spark, sf):
    df = entry.queries()[name](spark, sf)
    if name in entry.oracle_sql():
        assert compare.compare(df, compare.connection(sf), entry.oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_a_stage_called_alone_sends_small_batches(spark, sf):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        corpus_pipeline.freed(lambda s, docs, d: docs)(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

        assert max(r.n for r in spark.range(20_000).coalesce(1).mapInArrow(sizes, "n long").collect()) <= 2000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
