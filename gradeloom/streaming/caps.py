"""The cap check of a running evaluation: one alert a run, at the first call that the cap refuses."""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gradeloom import constants as K
from gradeloom.streaming.jobs import DRAIN

#: Settings of a query whose keyed state expires: the state store, and no empty micro-batches, which such state would ask for for ever.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
#: How long the spend of a run is kept after its last call.
KEPT_MS = 30 * 24 * 3600 * 1000
#: Calls of a run that are ordered at once, and calls that are read back at once; the rest waits in temporary files.
CHUNK, BLOCK = 250_000, 4096
_CALL = ["ts", "result_id", "cost_usd", "est_cost_gbp", "cost_cap_gbp"]
_OUT = "run_id string, ts timestamp, result_id string, spent_gbp double, est_cost_gbp double, cost_cap_gbp double"


def _written(calls):
    """A temporary file of calls in order, a few at a time."""
    file = tempfile.TemporaryFile()
    calls = calls.sort_values(["ts", "result_id"], kind="stable", ignore_index=True)
    for at in range(0, len(calls), BLOCK):
        calls.iloc[at:at + BLOCK].to_pickle(file)
    file.seek(0)
    return file


def _order(call: tuple) -> tuple:
    """The order of ``sort_values``: what is missing comes last."""
    lost = call[0] != call[0], call[1] is None or call[1] != call[1]
    return lost[0], 0 if lost[0] else call[0].value, lost[1], "" if lost[1] else call[1]


def _read(file) -> Iterator[tuple]:
    import pandas as pd

    end = file.seek(0, 2)
    file.seek(0)
    while file.tell() < end:
        yield from pd.read_pickle(file).itertuples(index=False, name=None)


class CapCheck(StatefulProcessor):
    """State of a run: what it has spent, and whether its alert is out.

    The calls of a run in a micro-batch may be any number: at most ``chunk`` of them are in memory, and once
    the alert is out they are only summed up.
    """

    def __init__(self, fx: float, kept_ms: int, chunk: int = CHUNK):
        self.fx, self.kept_ms, self.chunk = fx, kept_ms, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "spent_usd double, alerted boolean", self.kept_ms)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        spent, alerted = self.run.get() if self.run.exists() else (0.0, False)
        total, waiting, held, files = spent, [], 0, []
        try:
            for calls in rows:
                total += float(calls["cost_usd"].sum())
                if alerted:
                    continue
                waiting.append(calls[_CALL])
                held += len(calls)
                if held >= self.chunk:
                    files.append(_written(pd.concat(waiting)))
                    waiting, held = [], 0
            parts = [*map(_read, files)]
            if waiting:
                parts.append(pd.concat(waiting).sort_values(["ts", "result_id"], kind="stable").itertuples(index=False, name=None))
            upto = spent
            for ts, result_id, cost, estimate, cap in heapq.merge(*parts, key=_order):
                if upto / self.fx + estimate > cap:
                    alerted = True
                    yield pd.DataFrame({"run_id": [key[0]], "ts": [ts], "result_id": [result_id], "spent_gbp": [upto / self.fx], "est_cost_gbp": [estimate], "cost_cap_gbp": [cap]})
                    break
                upto += cost
        finally:
            for file in files:
                file.close()
        self.run.update((total, alerted))

    def close(self) -> None:
        pass


def first_refused(calls: DataFrame, caps: DataFrame, fx: float = K.GBP_USD_RATE, kept_ms: int = KEPT_MS) -> DataFrame:
    """One row a run: its first call whose estimate, on top of the spend before it, is over the cap.

    ``calls`` is a stream of run_id, ts, result_id, cost_usd, est_cost_gbp; ``caps`` holds run_id and
    cost_cap_gbp.  Calls count in the order of the micro-batches, and by (ts, result_id) inside one.  Spend
    and the mark that the alert is out are keyed state, so no table of alerts is read back; the state of a
    run goes ``kept_ms`` after its last call.  NULL costs and estimates count as 0.  ``operators.costs.first_refused`` is the
    batch form.  The query needs SETTINGS when it starts, see ``alerts``.
    """
    rows = calls.select("run_id", F.col("ts").cast("timestamp").alias("ts"), "result_id", F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
                        F.coalesce("est_cost_gbp", F.lit(0.0)).alias("est_cost_gbp")).join(F.broadcast(caps.select("run_id", "cost_cap_gbp")), "run_id")
    return rows.groupBy("run_id").transformWithStateInPandas(CapCheck(fx, kept_ms), _OUT, "append", "ProcessingTime")


def alerts(calls: DataFrame, caps: DataFrame, path: str, checkpoint: str, fx: float = K.GBP_USD_RATE, kept_ms: int = KEPT_MS, trigger: dict = DRAIN) -> StreamingQuery:
    """Start the cap check and write its alerts to ``path``, each once."""
    conf = calls.sparkSession.conf
    before = {key: conf.get(key) for key in SETTINGS}
    try:
        for key, value in SETTINGS.items():
            conf.set(key, value)
        found = first_refused(calls, caps, fx, kept_ms).writeStream.outputMode("append").format("parquet")
        return found.option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()  # the query keeps a copy of the settings
    finally:
        for key, value in before.items():
            conf.set(key, value)
