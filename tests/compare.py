"""Order-insensitive comparison of a Spark result with SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb


def oracle_connection(sf_dir: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in sorted(sf_dir.glob("*.parquet")):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((value is None, str(value)) for value in row)


def sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=_key)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    rows = [tuple(row) for row in df.collect()]
    return sorted(df.columns), sorted_rows(df.columns, rows)


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    columns = [column[0] for column in result.description]
    return sorted(columns), sorted_rows(columns, result.fetchall())
