"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.session import ensure_checkpoint_dir

#: The white space of all text contracts, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Folders written by ``staged`` that ``free`` may delete.
STAGED: list[str] = []


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(spark: SparkSession, folders: list[str], *kept: DataFrame) -> None:
    """Delete staged tables whose results are written elsewhere by now; those that a frame in ``kept`` reads stay."""
    needed = [f for df in kept for f in df.inputFiles()]
    for folder in folders:
        name = folder.rsplit("/", 1)[-1]
        if folder in STAGED and not any(f"/{name}/" in f for f in needed):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            STAGED.remove(folder)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` does not use in any case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in bases:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def hash52(text: Column) -> Column:
    """The first 13 hexadecimal digits of the MD5 of a text, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """Documents with a number that does not change: the place in their files, or else that in a staged copy."""
    place, number, files = F.col("_metadata.file_path"), F.col("_metadata.row_index"), []
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":  # files as they are, no row of them made into several
        try:
            files = [r[0] for r in docs.select(place).distinct().orderBy("file_path").limit(4097).collect()]
        except AnalysisException:  # files without row numbers
            pass
    if not 0 < len(files) <= 4096:
        return staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    order = F.create_map(*[x for i, f in enumerate(files) for x in (F.lit(f), F.lit(i))])
    return docs.withColumn(name, F.shiftleft(order[place].cast("long"), 40) + number)
