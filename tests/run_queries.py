"""Compare registered queries with their SQL twins: python tests/run_queries.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import compare  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = compare.connection(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            built = time.time() - start
            if name in sql:
                problem = compare.compare(df, con, sql[name])
                note = "same rows"
            else:
                n = df.count()
                problem, note = None, f"{n} rows, no SQL"
        except Exception as e:  # report and go on
            problem, built = f"{type(e).__name__}: {str(e)[:1500]}", 0.0
        bad += problem is not None
        print(f"{'OK  ' if problem is None else 'FAIL'} {name} build {built:.1f}s total {time.time() - start:.1f}s {note if problem is None else problem}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
