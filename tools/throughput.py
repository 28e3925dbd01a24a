"""Rows per second of one whole run: source, two SQL steps, a column step, replace.

    python tools/throughput.py [sf_dir]
"""

from __future__ import annotations

import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sluiceway import build_session, new_scratch_path  # noqa: E402
from sluiceway.plans.flow import Flow  # noqa: E402
from sluiceway.plans.steps import Columns, Source, Sql, Target  # noqa: E402
from sluiceway.sinks.files import ReplaceFiles  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(
        "throughput", "local[8]", 8, spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    label = {"expression": "CONCAT(l_returnflag, '-', l_linestatus)", "output_column": "flags"}
    flow = Flow(
        spark,
        [
            Source("lines", table=f"{sf_dir}/lineitem.parquet"),
            Sql("net", "SELECT *, l_extendedprice * (1 - l_discount) AS net FROM {prev}"),
            Sql("charged", "SELECT *, net * (1 + l_tax) AS charged FROM {prev} WHERE net > 0"),
            Columns("flags", [{"type": "sql_expression", "config": label}]),
        ],
        [Target(ReplaceFiles(new_scratch_path(spark, "throughput")))],
    )
    seconds = []
    for _ in range(4):
        began = time.monotonic()
        report = flow.run()
        seconds.append(time.monotonic() - began)
    spent = statistics.median(seconds[1:])
    print(f"{report.rows_processed} rows in {spent:.2f} s: {report.rows_processed / spent:.0f} rows/s")


if __name__ == "__main__":
    main()
