"""Scoring rules, one case per rule."""

import json

import pytest
from pyspark.sql import functions as F

from gradeloom.catalog import QUERIES, source_queries  # noqa: F401
from gradeloom.functions import answers as A, jsonvalues as J, text as T
from gradeloom.operators import tier1

LONG = "A misconfigured connection pool size (50 instead of 500) on a proxy, degrading for six hours"
# category, expected, response, extra row fields, status
CASES = [
    ("extraction", {"name": "Customer A", "email": "a@example.com", "amount": 249.0}, '{"name": "Customer A", "email": "a@example.com", "amount": 249.00}', {}, "pass"),
    ("extraction", {"amount": 249.0}, '{"amount": 249}', {}, "pass"),
    ("extraction", {"amount": 249.0}, '{"amount": 249.004}', {}, "pass"),
    ("extraction", {"amount": 249.0}, '{"amount": 249.01}', {}, "fail_content"),
    ("extraction", {"opt_in": True}, '{"opt_in": 1}', {}, "fail_schema"),
    ("extraction", {"count": 6}, '{"count": true}', {}, "fail_schema"),
    ("extraction", {"count": 6}, '{"count": 6.0}', {}, "fail_schema"),
    ("extraction", {"who": ["Alice", "Bob", "Carol"]}, '{"who": ["Carol", "alice", "Bob"]}', {}, "pass"),
    ("extraction", {"who": ["a", "a", "b"]}, '{"who": ["a", "b", "b"]}', {}, "fail_content"),
    ("extraction", {"who": [["a", 1], ["b"]]}, '{"who": [["B"], [1, "a"]]}', {}, "pass"),
    ("extraction", {"who": ["a"]}, '{"who": "a"}', {}, "fail_schema"),
    ("extraction", {"at": {"x": 1, "y": "k"}}, '{"at": {"y": "k", "x": 1}}', {}, "pass"),
    ("extraction", {"name": "Customer A"}, '{"name": "  customer  a  "}', {}, "pass"),
    ("extraction", {"name": "X", "email": "x@example.com"}, '{"name": "X"}', {}, "fail_schema"),
    ("extraction", {"name": "Customer A"}, '{"name": "Customer B"}', {}, "fail_content"),
    ("extraction", {"note": None}, '{"note": null}', {}, "pass"),
    ("extraction", {"note": None}, '{"note": "text"}', {}, "fail_schema"),
    ("extraction", {"note": None}, '{"note": 3}', {}, "fail_content"),
    ("extraction", {"name": "Customer A"}, '{"result": {"name": "Customer A"}}', {}, "pass"),
    ("extraction", {"name": "Customer A"}, '{"result": "not the expected shape"}', {}, "fail_schema"),
    ("extraction", {"name": "X"}, '{"result": {"unrelated": "field"}}', {}, "fail_schema"),
    ("extraction", {"name": "A"}, '{"result": {"result": {"name": "A"}}}', {}, "fail_schema"),
    ("extraction", {"name": "A"}, '{"result": {"name": "A"}, "more": 1}', {}, "fail_schema"),
    ("extraction", {"name": "A"}, '{"name": "B", "name": "A"}', {}, "pass"),
    ("extraction", {"amount": 1.0}, '{"amount": NaN}', {}, "fail_content"),
    ("extraction", {"name": "A"}, '["A"]', {}, "fail_schema"),
    ("customer_support", {"category": "billing"}, '{"category": "billing", "reply": "thank you..."}', {}, "pass"),
    ("customer_support", {"category": "technical"}, '```json\n{"category": " Technical ", "reply": "ok"}\n```', {}, "pass"),
    ("customer_support", {"category": "billing"}, '{"category": "payments"}', {}, "fail_content"),
    ("customer_support", {"category": "billing"}, '{"category": "complaint"}', {}, "fail_content"),
    ("customer_support", {"category": "billing"}, '{"category": 3}', {}, "fail_schema"),
    ("customer_support", {"category": "billing"}, '{"category": "billing"}}', {}, "fail_format"),
    ("customer_support", {"category": "billing"}, '{"category": "billing"} and {"category": "other"}', {}, "fail_format"),
    ("customer_support", {"category": "billing"}, '{"category": "billing"}] , [{"category": "other"}', {}, "fail_format"),
    ("customer_support", {"category": "billing"}, "null", {}, "fail_format"),
    ("customer_support", {"category": "billing"}, "12", {}, "fail_schema"),
    ("customer_support", {"category": "billing"}, "", {}, "fail_format"),
    ("rag_qa", {"answer": "2014", "supporting_sentences": [4]}, '{"answer": "Founded in 2014.", "supporting_sentences": [4]}', {}, "pass"),
    ("rag_qa", {"answer": "Sara Patel", "supporting_sentences": [6]}, '{"answer": "Sara", "supporting_sentences": [6]}', {}, "fail_content"),
    ("rag_qa", {"answer": LONG, "supporting_sentences": [11, 12]}, '{"answer": "The pool was small.", "supporting_sentences": [12, 11, 12]}', {}, "pass"),
    ("rag_qa", {"answer": LONG, "supporting_sentences": [11, 12]}, '{"answer": "X", "supporting_sentences": [3, 4]}', {}, "fail_content"),
    ("rag_qa", {"answer": "2014", "supporting_sentences": [4]}, '{"answer": "2014", "supporting_sentences": [3]}', {}, "fail_content"),
    ("rag_qa", {"answer": "2014", "supporting_sentences": [4]}, '{"answer": "2014", "supporting_sentences": ["4"]}', {}, "fail_schema"),
    ("rag_qa", {"answer": "2014", "supporting_sentences": [4]}, '{"answer": "2014", "supporting_sentences": [true]}', {}, "fail_schema"),
    ("rag_qa", {"answer": "one two three four five", "supporting_sentences": [4]}, '{"answer": "x", "supporting_sentences": [4]}', {}, None),
    ("reasoning", {"final_answer": "£14.00"}, '{"final_answer": "£14"}', {}, "pass"),
    ("reasoning", {"final_answer": "£14.00"}, '{"final_answer": "14.0 gbp"}', {}, "pass"),
    ("reasoning", {"final_answer": "£14.00"}, '{"final_answer": "£15.00"}', {}, "fail_content"),
    ("reasoning", {"final_answer": "£14.00"}, '{"final_answer": "$14.00"}', {}, "fail_content"),
    ("reasoning", {"final_answer": "£14.00"}, '{"final_answer": "14.00"}', {}, "fail_content"),
    ("reasoning", {"final_answer": "14:00"}, '{"final_answer": "14:00:00"}', {}, "pass"),
    ("reasoning", {"final_answer": "14:00"}, '{"final_answer": "2:00 PM"}', {}, "pass"),
    ("reasoning", {"final_answer": "00:30"}, '{"final_answer": "12:30 am"}', {}, "pass"),
    ("reasoning", {"final_answer": "14:00"}, '{"final_answer": "13:00 PM"}', {}, "fail_content"),
    ("reasoning", {"final_answer": "Eligible"}, '{"final_answer": "eligible."}', {}, "pass"),
    ("reasoning", {"final_answer": "Greendot, £12,960.00"}, '{"final_answer": "Greendot, £12,960.00"}', {}, "pass"),
    ("reasoning", {"final_answer": "Greendot, £12,960.00"}, '{"final_answer": "Greendot, £12960.00"}', {}, "fail_content"),
    ("reasoning", {"final_answer": "Greendot, £12,960.00"}, '{"final_answer": "Greendot, £13,000.00"}', {}, "fail_content"),
    ("summarisation", None, "• one\n• two", {}, "not_applicable"),
    ("customer_support", {"category": "billing"}, '{"category": "billing"}', {"lever": "output_cap", "tokens": 200}, "pass"),
    ("customer_support", {"category": "billing"}, '{"category": "billing", "reply": "Thanks for', {"lever": "output_cap", "tokens": 200}, "truncated"),
    ("customer_support", {"category": "billing"}, '{"category": "billing"', {"lever": "output_cap", "tokens": 15}, "fail_format"),
    ("extraction", {"name": "X"}, "(unused)", {"lever": "compression", "config": '{"compression_status": "unavailable"}'}, "compression_unavailable"),
    ("customer_support", {"category": "billing"}, '{"category": "billing"}', {"lever": "compression", "config": '{"original_input_tokens": 200}'}, "pass"),
    ("customer_support", {"category": "billing"}, "", {"error": "RateLimitError"}, "error"),
]


@pytest.fixture(scope="module")
def scored(spark):
    prompts = [(f"p{i:03d}", c, None if e is None else json.dumps(e, ensure_ascii=False)) for i, (c, e, *_) in enumerate(CASES)]
    rows = [(f"p{i:03d}", x.get("lever", "baseline"), x.get("config"), x.get("tokens", 50), r, x.get("error")) for i, (_, _, r, x, _) in enumerate(CASES)]
    p = spark.createDataFrame(prompts, "prompt_id string, task_category string, expected string")
    r = spark.createDataFrame(rows, "prompt_id string, optimisation_lever string, optimisation_config string, output_tokens bigint, response_text string, error string")
    return {x["prompt_id"]: x for x in tier1.score_tier1(r, p).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_status(i, scored):
    row = scored[f"p{i:03d}"]
    assert row["tier_1_status"] == CASES[i][4], (CASES[i], row)
    assert (row["reject_reason"] is not None) == (CASES[i][4] is None)
    assert row["truncated_due_to_cap"] == int(CASES[i][4] == "truncated")


STEPS = [
    ('```json\n{"a": 1}\n```', '{"a": 1}', ["fence_strip"]),
    ('Step 1.\n{"a": "£14.00"} done', '{"a": "£14.00"}', ["preamble_strip"]),
    ("{“name”: “A”}", '{"name": "A"}', ["smart_quote_normalise"]),
    ('{"name": "“quoted”"}', '{"name": "“quoted”"}', []),
    ('{"a": 1}', '{"a": 1}', []),
    (' 　{"a": 1}\n', '{"a": 1}', ["whitespace_strip"]),
    ('   ```json\nPreamble\n{"a": 1}\n```', '{"a": 1}', ["whitespace_strip", "fence_strip", "preamble_strip"]),
    ('[ note {"a": 1}', '[ note {"a": 1}', []),
    ("no json", "no json", []),
]


def test_normalisation_steps(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(STEPS)], "i int, response_text string")
    for row in tier1.normalise(df).collect():
        _, text, steps = STEPS[row["i"]]
        assert (row["normalised_text"], row["normalisation_steps_applied"]) == (text, steps)


def test_prose_is_only_stripped(spark):
    df = spark.createDataFrame([("```json\n• one\n```",)], "response_text string")
    row = tier1.normalise(df, expects_json=F.lit(False)).collect()[0]
    assert row["normalised_text"] == "```json\n• one\n```" and row["normalisation_steps_applied"] == []


DOCS = ['{"a":1}', '{"a":{"b":2}}', "[1,[2]]", '[{"a":1}]', '{"a":[{"b":1}]}', '"x"', "1.5", '{"a":1}}', "[1]]", '{"a":1},{"b":2}', '[1],"k":[2]', '{"a":1} x}',
        "[1] ]", '{"a":1}],[{"b":2}', "1],[2", "{'a':1}", '{"a":1', "", "nul", '{"a":"}"}', '{"a":"]"}', '["]"]', '{"a":"x"}{"b":"y"}', '{"a":NaN}', "[1]}", '{}', "[]", '{"a":1,}']


def test_one_document_only(spark):
    """The parser agrees with Python's on what is exactly one JSON document."""
    df = spark.createDataFrame([(t,) for t in DOCS], "t string")
    got = {r["t"]: r["ok"] for r in df.select("t", J.document(F.col("t")).isNotNull().alias("ok")).collect()}

    def reads(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    assert got == {t: reads(t) for t in DOCS}


def test_strip_matches_python(spark):
    texts = [chr(c) + "x " + chr(c) for c in range(0x3001) if chr(c).isspace()] + ["​x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r["s"] == r["t"].strip() for r in df.select("t", T.strip(F.col("t")).alias("s")).collect())


def test_registered_checker(spark):
    tier1.register_checker("extraction_v2", lambda parsed, want: F.when(J.field(parsed, "$.a", "int") == want, tier1._outcome("pass")).otherwise(tier1._outcome("fail_content")),
                           lambda e: J.field(e, "$.a", "int"))
    try:
        p = spark.createDataFrame([("p", "extraction_v2", '{"a": 3}')], "prompt_id string, task_category string, expected string")
        r = spark.createDataFrame([("p", "baseline", None, 1, '{"a": 3}', None)], "prompt_id string, optimisation_lever string, optimisation_config string, output_tokens int, response_text string, error string")
        assert tier1.score_tier1(r, p).collect()[0]["tier_1_status"] == "pass"
    finally:
        del tier1._CHECKERS["extraction_v2"]


def test_money_and_clock_readings(spark):
    df = spark.createDataFrame([("£1,200.50",), ("12 usd",), ("-3 chf",), ("12",), ("£x",), ("9:05 pm",), ("24:00",), ("9:60",)], "t string")
    got = {r["t"]: (r["m"] and tuple(r["m"]), r["c"]) for r in df.select("t", A.parse_currency(F.col("t")).alias("m"), A.parse_time(F.col("t")).alias("c")).collect()}
    assert got == {"£1,200.50": ((1200.5, "£"), None), "12 usd": ((12.0, "$"), None), "-3 chf": ((-3.0, "chf"), None), "12": (None, None), "£x": (None, None),
                   "9:05 pm": (None, "21:05"), "24:00": (None, None), "9:60": (None, None)}


DEEP = [  # response value, expected value, equal by the recursive rules
    ('[[["x", "y"]]]', '[[["Y", "x"]]]', True), ("[[[1.001]]]", "[[[1.0]]]", True), ('[[[["X"]]]]', '[[[["x"]]]]', True), ('{"q": 100.0}', '{"q": 1e2}', True),
    ('{"q": 1}', '{"q": true}', True), ('{"q": [1, 2]}', '{"q": [2, 1]}', False), ("[[[1]], [[1]]]", "[[[1]], [[2]]]", False), ('[{"a": 1.0}]', '[{"a": 1}]', True),
    ("[[[1.5]]]", "[[[1]]]", False), ("[[[null]]]", "[[[null]]]", True), ("[[[true]]]", "[[[1]]]", False), ('{"a": {"b": "X"}}', '{"a": {"b": "x"}}', False),
]


@pytest.mark.parametrize("walk", [None, True])
def test_values_of_any_depth(spark, walk):
    prompts = [(f"p{i}", "extraction", '{"f": %s, "n": 1}' % e) for i, (_, e, _) in enumerate(DEEP)] + [("flat", "extraction", '{"n": 1}')]
    rows = [(f"p{i}", "baseline", '{"f": %s, "n": 1}' % g) for i, (g, _, _) in enumerate(DEEP)] + [("flat", "baseline", '{"n": 1}'), ("p0", "batch", '{"f": [[["x"]]]}'), ("p0", "caching", '{"f": "x", "n": 1}')]
    p = spark.createDataFrame(prompts, "prompt_id string, task_category string, expected string")
    r = spark.createDataFrame(rows, "prompt_id string, optimisation_lever string, response_text string").withColumns(
        {"error": F.lit(None).cast("string"), "optimisation_config": F.lit(None).cast("string"), "output_tokens": F.lit(1)})
    got = {(x.prompt_id, x.optimisation_lever): x.tier_1_status for x in tier1.score_tier1(r, p, walk=walk).collect()}
    for i, (_, _, same) in enumerate(DEEP):
        assert got[(f"p{i}", "baseline")] == ("pass" if same else "fail_content"), DEEP[i]
    assert got[("flat", "baseline")] == "pass" and got[("p0", "batch")] == got[("p0", "caching")] == "fail_schema"


def test_values_of_many_shapes_are_read_from_their_bytes(spark):
    long = ", ".join(f'"k{i}": [{i}, "{"y" * 70}{i}", {i}.50, {10 ** (i % 25)}]' for i in range(300))
    texts = ['{"f": [1, 1.0, 2.004, 1e2, true, false, null, "", "é", -5, 300, 70000, 3000000000, 12345678901234567890, 0.125]}', '{' + long + '}', '{"a": {"b": {' + long + "}}}", "[]", "{}", '"x"']
    for row in spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("v"), "t").collect():
        found = J._value(bytes(row.v.value), bytes(row.v.metadata))
        assert found == json.loads(row.t) and json.dumps(found, sort_keys=True) == json.dumps(json.loads(row.t), sort_keys=True)


def test_equality_needs_no_interpreted_lambdas_and_one_row_group_makes_many_tasks(spark, sf):
    rows = spark.createDataFrame([('{"f": 1}', '{"f": 1}', True), ('{"f": 1.0}', '{"f": 1}', False), ('{"f": [2]}', "{}", True), ("[1]", "{}", True), (None, "{}", True), ('{"f": 1}', None, False),
                                  ('{"f": 1}', "[1]", False), ('{"f": [[[1]], "A "]}', '{"f": ["a", [[1.0]]]}', True)], "g string, e string, equal boolean")
    df = J.with_json_equal(rows, F.try_parse_json("g"), F.try_parse_json("e"), "found")
    assert [r for r in df.collect() if r.found != r.equal] == []
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "forall(" not in plan
    query = QUERIES["typed_equality"](spark, sf)
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("RepartitionByExpression")  # the keys are dealt out below the explode
