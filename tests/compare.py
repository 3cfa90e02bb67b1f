"""Runs every query beside its SQL twin: python -m tests.compare [sf_dir] [query ...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


def connect(sf_dir):
    from shelfmark.plans.views import TABLES

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.12g}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, relation):
    """What differs between a DataFrame and a relation: names, types or rows."""
    mine = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    if mine != theirs:
        return f"schema {sorted(mine.items() - theirs.items())} vs {sorted(theirs.items() - mine.items())}"
    left, right = _rows(df.columns, df.collect()), _rows(relation.columns, relation.fetchall())
    if left != right:
        only_left, only_right = set(left) - set(right), set(right) - set(left)
        return (f"{len(left)} vs {len(right)} rows, {len(only_left)} and {len(only_right)} alone, "
                f"columns {sorted(df.columns)}, e.g. {sorted(only_left)[:2]} / {sorted(only_right)[:2]}")
    return None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    con, oracle = connect(sf_dir), entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracle:
                problem = differences(df, con.sql(oracle[name]))
            else:
                problem = f"(no twin) {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"ERROR {type(error).__name__} {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:22s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{bad} with differences")


if __name__ == "__main__":
    main()
