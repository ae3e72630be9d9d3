"""Run registered queries beside their SQL and compare whole results, values and types.

    python tests/oracle_check.py [directory] [name ...]

``CHECK_TIME_ZONE`` sets another time zone of the session; results must not depend on it.
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

TYPE_NAMES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def session(cpus: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("checks")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", os.environ.get("CHECK_TIME_ZONE", "UTC"))
        .getOrCreate()
    )


def oracle(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return connection


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda row: tuple((value is not None, value if value is not None else 0) for value in row))


def difference(df, relation: duckdb.DuckDBPyRelation) -> str | None:
    """What differs between a Spark result and a DuckDB result; None if nothing does."""
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return f"columns {names} against {sorted(relation.columns)}"
    types = {name: TYPE_NAMES.get(kind, kind) for name, kind in df.dtypes}
    other = dict(zip(relation.columns, map(str, relation.types)))
    if types != other:
        return f"types {types} against {other}"
    ours = _sorted([tuple(row[name] for name in names) for row in df.collect()])
    order = [relation.columns.index(name) for name in names]
    theirs = _sorted([tuple(row[i] for i in order) for row in relation.fetchall()])
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    unequal = [pair for pair in zip(ours, theirs) if pair[0] != pair[1]]
    return f"{len(unequal)} rows differ, first {unequal[0]}" if unequal else None


def main(directory: str, only: list[str]) -> int:
    import __spark_entry__ as registry

    spark, connection = session(), oracle(directory)
    spark.sparkContext.setLogLevel("ERROR")
    sql, bad = registry.oracle_sql(), 0
    for name, query in registry.queries().items():
        if only and not any(name.startswith(prefix) for prefix in only):
            continue
        started = time.time()
        try:
            found = difference(query(spark, directory), connection.sql(sql[name])) if name in sql else "no SQL"
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{name:28s} {time.time() - started:6.2f}s  {found or 'equal'}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(main(directory, sys.argv[2:]) > 0)
