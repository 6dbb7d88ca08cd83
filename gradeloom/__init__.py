"""gradeloom: evaluation-log analytics on Spark.

Tables of prompts, model responses, prices and judge outputs go in; costs,
deterministic scores, judge audits, canonical scores, cost/quality cells and
frontiers come out.  Every operator is lazy and takes and returns DataFrames or
Columns.
"""
