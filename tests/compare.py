"""Run registered queries against their SQL in DuckDB: python -m tests.compare [part of a name ...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: str = "8", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablekit-tests")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shared-"))
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return (type(v).__name__, str(v))
    if isinstance(v, int):
        return ("int", str(v))
    if isinstance(v, float):
        return ("float", "nan" if math.isnan(v) else repr(v))
    if isinstance(v, (list, tuple)):
        return ("list", str([_cell(x) for x in v]))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return ("time", v.isoformat())
    return (type(v).__name__, str(v))


def rows_of(names: list[str], rows: list[tuple]) -> tuple[list[str], list]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, sf_dir: str, fn, sql: str | None) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    rel = con.sql(sql)
    want_names, want = rows_of(list(rel.columns), rel.fetchall())
    if got_names != want_names:
        return False, f"columns {got_names} against {want_names}"
    if got == want:
        return True, f"{len(got)} rows"
    got_set, want_set = set(got), set(want)
    only_got = [x for x in got if x not in want_set][:3]
    only_want = [x for x in want if x not in got_set][:3]
    return False, f"{len(got)} against {len(want)} rows\n  spark {only_got}\n  sql   {only_want}"


def main(parts: list[str]) -> int:
    from workload import ORACLES, QUERIES

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, fn, ORACLES.get(name))
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(bad)} failed: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
