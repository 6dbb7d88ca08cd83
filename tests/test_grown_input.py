"""Files and buckets grow in number with the rows, not in size."""

import glob

import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gradeloom.catalog import source_queries
from gradeloom.sources import keys


def written(monkeypatch) -> list[str]:
    """The folders that the queries make from here on."""
    made, folder = [], source_queries.folder
    monkeypatch.setattr(source_queries, "folder", lambda spark, name: made.append(folder(spark, name)) or made[-1])
    return made


@pytest.mark.parametrize("name, at_least", [("prompt_files", 100), ("prompt_rejects", 100), ("prompt_file_ranges", 5), ("prompt_range_rejects", 5), ("case_file_ranges", 5)])
def test_more_rows_are_more_files(spark, sf, monkeypatch, name, at_least):
    monkeypatch.setattr(source_queries, "PER_FILE", 10)
    monkeypatch.setattr(source_queries, "PER_ARRAY", 200)
    made = written(monkeypatch)
    df = entry.queries()[name](spark, sf)
    assert compare.compare(df, compare.connection(sf), entry.oracle_sql()[name]) is None
    assert len([f for path in made for f in glob.glob(path.removeprefix("file:") + "/part-*")]) >= at_least


def test_buckets_follow_the_rows():
    assert keys.buckets_for(0) == 8 and keys.buckets_for(150_000_000) == 600


def test_empty_tasks_write_no_array(spark, tmp_path):
    one = spark.range(1).select(F.lit('{"a": 1}').alias("value"))
    source_queries.arrays(one, str(tmp_path / "a"), 4)
    texts = sorted(open(f).read().replace(" ", "") for f in glob.glob(str(tmp_path / "a") + "/part-*"))
    assert "".join(texts).count("[") == "".join(texts).count("]") and "[]" not in texts
