"""Session settings and reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Runtime settings the operators rely on; every one may be set on a running session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # joins whose build side turns out small per partition skip the sort; checked at run time
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16MB",  # as shuffled; some ten times that in memory, in every task at once
    # exploded and JSON columns make tables far larger than the planner's guess from file sizes, so a
    # side is broadcast for its size only once that was counted at run time; small fixed tables have hints
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # a JSON object that repeats a key keeps the last value, as common JSON readers do
    "spark.sql.variant.allowDuplicateKeys": "true",
    # HotSpot leaves methods above 8000 bytecodes interpreted; past that, compile per expression
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # a task that writes to a few folders keeps a file open in each, where it would sort whole rows by folder, on disk if they are many
    "spark.sql.maxConcurrentOutputFileWriters": "32",
    # lower-casing through the JVM has a fast path for ASCII text
    "spark.sql.icu.caseMappings.enabled": "false",
}
#: Of the corpus operators besides: their rows hold whole texts and sets, of which an Arrow batch of 10,000 takes up to hundreds of MB on both sides.
#: Shuffle files go with the statement that wrote them instead of at the end of the session.
CORPUS_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def configure(spark: SparkSession, guess_sizes: bool = False) -> SparkSession:
    """Apply the runtime settings to a session and return it.

    ``guess_sizes`` is for jobs over staged tables, whose file sizes are what a join reads: there the planner's guess may broadcast.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if guess_sizes:
        for key, value in CORPUS_SETTINGS.items():
            spark.conf.set(key, value)
        key = "spark.sql.autoBroadcastJoinThreshold"
        spark.conf.set(key, spark.sparkContext.getConf().get(key, "10MB"))
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a scratch folder on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gradeloom-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and pins values such as partition numbers."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pinned(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Keep some columns and add computed ones that later steps cannot be rewritten through.

    Filters on a computed column are normally pushed below its projection, with the whole
    expression copied into the filter; on long chains of projections those copies multiply.
    A one-row ``explode`` evaluates the columns once per row and stops the rewrite.
    """
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.explode(F.array(values)).alias("_pin")).select(*keep, "_pin.*")
