"""Run registered queries next to their SQL: python tests/oracle_check.py FOLDER [name ...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as spark_entry  # noqa: E402
from rankloom.runtime import build_session  # noqa: E402


def canonical(frame):
    """Rows with columns by name, sorted: what the two engines are compared on."""
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted(frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None), key=repr)


def open_tables(folder: str):
    connection = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    return connection


def compare(spark, connection, folder: str, name: str) -> tuple[bool, str]:
    start = time.time()
    result = spark_entry.queries()[name](spark, folder)
    ours = result.toPandas()
    took = time.time() - start
    sql = spark_entry.oracle_sql().get(name)
    if sql is None:
        return len(ours) > 0, f"{name}: {len(ours)} rows, no SQL ({took:.1f}s)"
    start = time.time()
    theirs = connection.sql(sql).df()
    note = f"{name}: {len(ours)} / {len(theirs)} rows ({took:.1f}s / {time.time() - start:.1f}s)"
    if sorted(ours.columns) != sorted(theirs.columns):
        return False, f"{note} columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    a, b = canonical(ours), canonical(theirs)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3] if len(a) < 50_000 else "…"
        only_b = [r for r in b if r not in set(a)][:3] if len(a) < 50_000 else "…"
        return False, f"{note}\n   ours only {str(only_a)[:900]}\n   SQL only {str(only_b)[:900]}"
    return True, note


def main(folder: str, names: list[str]) -> int:
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                                       "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = open_tables(folder)
    failed = []
    for name in names or list(spark_entry.queries()):
        try:
            ok, note = compare(spark, connection, folder, name)
        except Exception as error:  # noqa: BLE001 - report every query
            ok, note = False, f"{name}: {type(error).__name__} {str(error)[:1500]}"
        print("ok  " if ok else "BAD ", note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
