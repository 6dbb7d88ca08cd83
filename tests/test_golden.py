"""Published cell values: frontier, dominators, near-best bands and headline scalars."""

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import cells as C, frontier as P

S, H, G, M = "claude-sonnet-4-6", "claude-haiku-4-5", "gpt-5.4-2026-03-05", "gpt-5.4-mini-2026-03-17"
LEVERS = ["baseline", "batch", "compression", "output_cap"]
# fixed values: published mean score and mean cost per (model, lever), all categories
OVERALL = {
    H: [(0.8111, 0.001841), (0.8123, 0.00092), (0.587, 0.001502), (0.7311, 0.001599)],
    S: [(0.8885, 0.005566), (0.8713, 0.002791), (0.7087, 0.004416), (0.8429, 0.00467)],
    G: [(0.9348, 0.00422), (0.9321, 0.0021), (0.7544, 0.003436), (0.8834, 0.003377)],
    M: [(0.8871, 0.00117), (0.8809, 0.000557), (0.6854, 0.000929), (0.857, 0.000922)],
}
# fixed values: the same for summarisation
SUMMARISATION = {
    H: [(0.7535, 0.00376), (0.7745, 0.001866), (0.6763, 0.002554), (0.7205, 0.003614)],
    S: [(0.8318, 0.011302), (0.799, 0.005616), (0.7817, 0.007902), (0.7712, 0.010901)],
    G: [(0.916, 0.010162), (0.9008, 0.005045), (0.8318, 0.007222), (0.7915, 0.00722)],
    M: [(0.8113, 0.002787), (0.7997, 0.001263), (0.747, 0.001927), (0.7595, 0.001908)],
}


def frame(spark, table, category="all"):
    rows = [(category, m, lv, *values) for m, cells in table.items() for lv, values in zip(LEVERS, cells)]
    return spark.createDataFrame(rows, "task_category string, model string, lever string, mean_score double, mean_cost double")


def test_frontier_and_dominators(spark):
    got = {(r["model"], r["lever"]): (r["dominated_by_model"], r["dominated_by_lever"]) for r in P.frontier(frame(spark, OVERALL)).collect()}
    assert {k for k, v in got.items() if v == (None, None)} == {(M, "batch"), (M, "baseline"), (G, "batch"), (G, "baseline")}
    assert got[(H, "batch")] == (M, "batch") and got[(M, "compression")] == (M, "batch")
    assert got[(H, "compression")] == (M, "baseline") and got[(H, "baseline")] == (M, "baseline")
    assert got[(S, "batch")] == (G, "batch") and got[(G, "output_cap")] == (G, "batch")
    assert got[(S, "baseline")] == (G, "baseline") and got[(S, "compression")] == (G, "baseline")


def test_headline_scalars(spark):
    r = P.headline_scalars(frame(spark, OVERALL)).collect()[0]
    assert (r["best_model"], r["best_lever"], r["cheap_model"], r["cheap_lever"]) == (G, "baseline", M, "batch")
    assert r["quality_share"] == pytest.approx(0.942, abs=1e-3)
    assert r["cost_share"] == pytest.approx(0.132, abs=1e-3)
    assert r["cost_multiple"] == pytest.approx(7.6, abs=0.05)


def test_baseline_differences(spark):
    df = frame(spark, OVERALL).withColumns({"pass_rate_all": F.lit(0.0), "pass_rate_applicable": F.lit(0.0)})
    got = {(r["model"], r["lever"]): r for r in C.vs_baseline(df, ["model"]).collect()}
    assert got[(G, "compression")]["delta_score"] == pytest.approx(-0.1804, abs=1.5e-4)
    assert got[(S, "batch")]["cost_ratio"] == pytest.approx(0.5014, abs=1e-3)
    ratios = [got[(m, "batch")]["cost_ratio"] for m in OVERALL]
    assert min(ratios) == pytest.approx(0.476, abs=1e-3) and max(ratios) == pytest.approx(0.501, abs=1e-3)


def test_summarisation_band(spark):
    df = frame(spark, SUMMARISATION, "summarisation")
    assert P.frontier(df, ["task_category"]).where("pareto_optimal").count() == 4
    r = P.cost_sensitivity(df).collect()[0]
    assert (r["n_near_best"], r["cheapest_model"], r["cheapest_lever"]) == (4, G, "batch")
    assert r["cost_ratio"] == pytest.approx(2.2, abs=0.05)


def test_rollup_uses_sums(spark, sf):
    from gradeloom.catalog.grid import results
    from gradeloom.plans.analysis import model_cells

    rows = results(spark, sf)
    rolled = {(r["model"], r["lever"]): r for r in model_cells(C.cells(rows)).collect()}
    direct = C.with_rates(C.cells(rows, ["model", "lever"])).collect()
    for r in direct:
        other = rolled[(r["model"], r["lever"])]
        assert r["n_rows"] == other["n_rows"] and r["mean_score"] == pytest.approx(other["mean_score"]) and r["mean_cost"] == pytest.approx(other["mean_cost"])
