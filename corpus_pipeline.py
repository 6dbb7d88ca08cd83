"""A corpus from raw documents to packed sequences: each stage's rows are written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradeloom import session
from gradeloom.llm import common, exact_dedup, mixing, near_copies, packing, quality_model
from gradeloom.llm.common import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the importance sample holds; the rest go."""
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: runs of five words, similarity of 0.8 or more."""
    return near_copies.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents in the target weights of their sources."""
    clash = {c: f"own {c}" for c in docs.columns if c.lower() in ("copy", "shuffle_key")}
    back = {new: old for old, new in clash.items()}
    return mixing.mix(docs.withColumnsRenamed(clash)).withColumnsRenamed({"copy": "_copy", "shuffle_key": "_shuffle_key"}).withColumnsRenamed(back).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all copies and their places in sequences of 2,048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


_left: list[str] = []


def freed(stage: Stage, last: bool = False) -> Stage:
    """A stage that first deletes what the stage before it staged inside: its result is a table by then.

    Shuffle files go with the statement that wrote them instead of at the end of the session.
    """
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in session.CORPUS_SETTINGS.items():
            spark.conf.set(key, value)
        common.free(spark, _left, docs)
        before = len(common.STAGED)
        out = stage(spark, docs, sf_dir)
        _left[:] = [] if last else common.STAGED[before:]
        return out

    run_stage.__doc__ = stage.__doc__
    return run_stage


STAGES: list[tuple[str, Stage]] = [("quality_model", freed(quality)), ("exact_dedup", freed(exact)), ("simhash_near_dedup", freed(near)),
                                   ("poisson_mixing", freed(mixture)), ("best_fit_packing", freed(pack, last=True))]
#: Models, fingerprints and token ids are beyond SQL; a test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows go through a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
