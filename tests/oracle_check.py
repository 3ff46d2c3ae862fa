"""Compare every registered query with its SQL oracle: ``python tests/oracle_check.py [dir] [names]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    """Empty when columns, Arrow types and the bag of rows agree."""
    ours, theirs = query(spark, sf_dir).toArrow(), con.execute(sql).to_arrow_table()
    names = sorted(ours.column_names)
    if names != sorted(theirs.column_names):
        return [f"columns {names} against {sorted(theirs.column_names)}"]
    kinds = lambda table: [str(table.schema.field(n).type).replace("large_", "") for n in names]
    found = [] if kinds(ours) == kinds(theirs) else [f"types {kinds(ours)} against {kinds(theirs)}"]
    rows = lambda table: Counter(zip(*[table[n].to_pylist() for n in names], strict=True))
    left, right = rows(ours), rows(theirs)
    if left != right:
        only_ours, only_theirs = left - right, right - left
        found.append(
            f"rows {left.total()} against {right.total()}, e.g. {list(only_ours)[:2]} against {list(only_theirs)[:2]}"
        )
    return found


def main() -> None:
    import __spark_entry__ as entry
    from tidemark.session import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = session("oracle_check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = oracle_connection(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        begin = time.time()
        if name not in oracles:  # no SQL can express it; its own tests compare it with a plain version
            print(f"rows {name} {query(spark, sf_dir).count()} in {time.time() - begin:.2f}s", flush=True)
            continue
        try:
            found = differences(spark, con, query, oracles[name], sf_dir)
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok':4} {name} {time.time() - begin:.2f}s", *found, flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
