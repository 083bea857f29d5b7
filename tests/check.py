"""Run registered queries and their checking SQL side by side: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "to_pydatetime"):
        return value.to_pydatetime()
    return value


def rows_of(table) -> list[tuple]:
    """Rows with columns sorted by name, sorted."""
    names = sorted(table.column_names)
    columns = [[_plain(x) for x in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=lambda r: [(x is None, str(type(x)) if x is None else "", str(x)) for x in r])


def _sorted(table):
    names = sorted(table.column_names)
    plain = [n for n in names if not pa.types.is_nested(table.schema.field(n).type)]
    return table.select(names).sort_by([(n, "ascending") for n in plain]).replace_schema_metadata().combine_chunks()


def compare(spark_table, duck_table) -> str | None:
    """What differs, or None."""
    a, b = sorted(spark_table.column_names), sorted(duck_table.column_names)
    if a != b:
        return f"columns {a} != {b}"
    types = [
        (n, str(spark_table.schema.field(n).type), str(duck_table.schema.field(n).type))
        for n in a
        if str(spark_table.schema.field(n).type) != str(duck_table.schema.field(n).type)
    ]
    if types:
        return f"types {types}"
    if spark_table.num_rows != duck_table.num_rows:
        return f"rows {spark_table.num_rows} != {duck_table.num_rows}"
    # column by column: whether a column may be null is no difference
    if all(x.equals(y) for x, y in zip(_sorted(spark_table).columns, _sorted(duck_table).columns)):
        return None
    ours, theirs = rows_of(spark_table), rows_of(duck_table)
    different = [(x, y) for x, y in zip(ours, theirs) if x != y]
    if different:
        return f"{len(different)} rows differ, first {different[0]}"
    return None


def main() -> int:
    from tests.conftest import make_session

    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(entry.queries())
    spark = make_session()
    connection = duck(folder)
    checks = entry.oracle_sql()
    failed = 0
    for name in names:
        started = time.time()
        try:
            ours = entry.queries()[name](spark, folder).toArrow()
            took = time.time() - started
            if name not in checks:
                print(f"rows {name} {ours.num_rows} {took:.1f}s", flush=True)
                continue
            theirs = connection.execute(checks[name]).to_arrow_table()
            problem = compare(ours, theirs)
        except Exception as e:  # noqa: BLE001
            problem, took = f"{type(e).__name__}: {str(e)[:600]}", time.time() - started
            ours = None
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {ours.num_rows if ours else 0} {took:.1f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
