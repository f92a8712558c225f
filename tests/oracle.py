"""Compare registered queries with their SQL on the same tables.

``python tests/oracle.py [sf_dir] [name …]`` checks from the command line.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALLEST = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = Counter(tuple(_cell(row[i]) for i in order) for row in rows)
    return [columns[i] for i in order], cells


def compare(spark, con, sf_dir: str, run, sql: str, empty: bool = False) -> str | None:
    """None when equal, else what differs. No rows on both sides count only with ``empty``."""
    df = run(spark, sf_dir)
    ours = _table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = _table([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} against {theirs[0]}"
    if ours[1] != theirs[1]:
        more, less = ours[1] - theirs[1], theirs[1] - ours[1]
        show = lambda c: [str(x)[:400] for x in list(c)[:3]]
        return (
            f"rows {sum(ours[1].values())} against {sum(theirs[1].values())}; "
            f"only here {sum(more.values())} {show(more)}; only there {sum(less.values())} {show(less)}"
        )
    if not ours[1] and not empty:
        return "no rows"
    return None


def session(hot_rows: int | None = None):
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master("local[8]")
        .appName("anamnesis-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if hot_rows is not None:
        spark.conf.set("anamnesis.hotRows", str(hot_rows))
    return spark


def main() -> int:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    hot = os.environ.get("HOT_ROWS")
    spark, con = session(int(hot) if hot else None), connect(sf_dir)
    sql, failed = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if args[1:] and name not in args[1:]:
            continue
        started = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, sf_dir, run, sql[name])
            else:
                problem = None if run(spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        mark = ("ok" if name in sql else "rows") if problem is None else "FAIL"
        print(f"{mark:5} {name:28} {time.time() - started:6.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
