"""What a run still has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from gradeloom import constants as K
from gradeloom.operators import planning


def missing_work(results: DataFrame, prompts: DataFrame, run_id: str, models: list[str] = K.TEST_MODELS,
                 levers: list[str] = K.LEVERS, subset_size: int | None = None) -> DataFrame:
    """Measurements of one run without a successful row.

    ``subset_size`` is the budget tier's size and limits the compression lever to a stratified
    subset of the prompts; None means all prompts, 0 leaves that lever out.
    """
    done = results.where((F.col("run_id") == run_id) & F.col("error").isNull())
    gap = planning.coverage_gap(done, prompts, models, levers)
    if subset_size is None:
        return gap
    plain = gap.where("lever <> 'compression'")
    if subset_size == 0:
        return plain
    chosen = planning.stratified_subset(prompts, subset_size).select("prompt_id")
    return plain.unionByName(gap.where("lever = 'compression'").join(chosen, "prompt_id", "left_semi"))


def infer(df: DataFrame, call, schema: str) -> DataFrame:
    """Run a user's callable over Arrow batches of work rows.

    ``call(pandas.DataFrame) -> pandas.DataFrame`` returns the response columns of ``schema``;
    a row that failed carries its error as data.  After an exception in the callable the batch
    is tried row by row, so that only the rows that raise are marked; ``schema`` (any DDL text)
    must hold an ``error`` column.
    """
    import pandas as pd

    names = StructType.fromDDL(schema).names

    def tried(batch):
        try:
            return call(batch)
        except Exception as e:  # the failure is data
            if len(batch) > 1:
                return pd.concat([tried(batch.iloc[i:i + 1]).reindex(columns=names).astype(object) for i in range(len(batch))])
            out = batch.reindex(columns=names).copy()
            out["error"] = f"{type(e).__name__}: {e}"
            return out

    def run(batches):
        for batch in batches:
            yield pd.DataFrame(tried(batch)).reindex(columns=names).astype(object)

    return df.mapInPandas(run, schema)
