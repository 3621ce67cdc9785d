"""Run registered queries against their SQL: ``python tests/run_checks.py FOLDER [HOT_ROWS] [KEY ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checking import connect, spark_rows, sql_rows  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from wayledger.session import HOT_ROWS  # noqa: E402


def main(folder: str, hot: str = "", *keys: str) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if hot and hot != "-":
        spark.conf.set(HOT_ROWS, hot)
    db, queries, oracles, bad = connect(folder), entry.queries(), entry.oracle_sql(), 0
    for key in keys or queries:
        began = time.time()
        try:
            names, rows = spark_rows(queries[key](spark, folder))
            took = time.time() - began
            if key not in oracles:
                print(f"rows {key} {len(rows)} {took:.2f}s", flush=True)
                continue
            want_names, want = sql_rows(db, oracles[key])
            good = names == want_names and rows == want
            print("ok  " if good else "BAD ", key, len(rows), len(want), f"{took:.2f}s", flush=True)
            if not good:
                bad += 1
                print("   columns", names, want_names)
                print("   only spark", [r for r in rows if r not in set(want)][:3])
                print("   only sql  ", [r for r in want if r not in set(rows)][:3])
        except Exception as error:  # report and go on with the next key
            bad += 1
            print("FAIL", key, str(error)[:1500], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
