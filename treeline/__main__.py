"""The queries from the command line: ``python -m treeline QUERY FOLDER [--rows N | --explain | --sql | --out PATH]``, or ``--list``."""

from __future__ import annotations

import argparse
import sys

from treeline.registry import registry
from treeline.session import session


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="treeline", description="Run a registered query over a folder of tables.")
    parser.add_argument("query", nargs="?", help="the query's name")
    parser.add_argument("folder", nargs="?", help="a folder of <table>.parquet")
    parser.add_argument("--list", action="store_true", help="name all queries with the first line of what they do")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    parser.add_argument("--explain", action="store_true", help="show the plan instead of rows")
    parser.add_argument("--sql", action="store_true", help="show the SQL that says the same")
    parser.add_argument("--out", help="write the rows as Parquet here instead of showing them")
    parser.add_argument("--master", help="where to run; by default what the session's configuration says")
    a = parser.parse_args(arguments)
    queries = registry.queries()
    if a.list:
        for name, fn in sorted(queries.items()):
            print(f"{name}: {(fn.__doc__ or '').strip().splitlines()[0] if fn.__doc__ else ''}")
        return 0
    if a.query not in queries:
        print(f"no query {a.query}; --list names them", file=sys.stderr)
        return 2
    if a.sql:
        print(registry.oracle_sql().get(a.query, "-- none"))
        return 0
    if not a.folder:
        print("a folder of tables is needed", file=sys.stderr)
        return 2
    rows = queries[a.query](session("treeline", a.master), a.folder)
    if a.explain:
        rows.explain("formatted")
    elif a.out:
        rows.write.parquet(a.out)
    else:
        rows.show(a.rows, truncate=120)
    return 0


if __name__ == "__main__":
    sys.exit(main())
