"""Compare registered queries with DuckDB on the same parquet tables."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table[name].to_pylist() for name in names]
    fixed = [[round(v, 6) if isinstance(v, float) else v for v in column] for column in columns]
    return sorted(zip(*fixed), key=repr)


def kinds(table: pa.Table) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


def difference(spark_table: pa.Table, sql_table: pa.Table) -> str | None:
    """None when both hold the same columns, types and rows."""
    if sorted(spark_table.column_names) != sorted(sql_table.column_names):
        return f"columns {sorted(spark_table.column_names)} vs {sorted(sql_table.column_names)}"
    left, right = kinds(spark_table), kinds(sql_table)
    if left != right:
        return "types " + str({k: (left[k], right[k]) for k in left if left[k] != right[k]})
    a, b = rows(spark_table), rows(sql_table)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2] if len(a) < 20000 else []
        only_b = [r for r in b if r not in set(a)][:2] if len(a) < 20000 else []
        return f"rows {len(a)} vs {len(b)}; spark only {only_a}; sql only {only_b}"
    return None


def main(sf_dir: str, names: list[str]) -> None:
    import __spark_entry__ as entry

    from termweave.runtime import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    oracle = entry.oracle_sql()
    failed = []
    for name, function in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            result = function(spark, sf_dir).toArrow()
            took = time.time() - start
            problem = None
            if name in oracle:
                problem = difference(result, db.sql(oracle[name]).to_arrow_table())
        except Exception as error:  # noqa: BLE001
            took, problem, result = time.time() - start, f"{type(error).__name__}: {str(error)[:1500]}", None
        count = result.num_rows if result is not None else "-"
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name:28s} {took:6.2f}s rows={count} {'' if name in oracle else '(no SQL)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
