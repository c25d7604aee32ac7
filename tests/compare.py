"""Run registered queries next to their SQL and compare the rows.

Usage: python tests/compare.py SF_DIR [name prefix ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    """A value in a form that is equal for both engines."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return f"bool {value}"
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, int):
        return f"int {value}"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"float {value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def difference(spark, con, name: str, function, sql: str, sf_dir: str) -> str | None:
    df = function(spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    result = con.sql(sql)
    names = result.columns
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    places = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(row[i]) for i in places) for row in result.fetchall())
    if mine == theirs:
        return None if mine else "no rows on either side"
    only_mine, only_theirs = set(mine) - set(theirs), set(theirs) - set(mine)
    return f"{len(mine)} and {len(theirs)} rows\n  columns {columns}\n  spark {sorted(only_mine)[:3]}\n  sql   {sorted(only_theirs)[:3]}"


def main() -> int:
    from vigilog.plans import load_queries
    from vigilog.session import local_session

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    queries, oracle = load_queries()
    spark = local_session("8")
    con = connection(sf_dir)
    bad = 0
    for name, function in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = difference(spark, con, name, function, oracle[name], sf_dir)
            else:
                count = function(spark, sf_dir).count()
                problem = None if count else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        kind = "sql" if name in oracle else "rows"
        print(f"{'ok  ' if problem is None else 'BAD '} {kind:4} {time.time() - start:6.2f}s {name}{'' if problem is None else ': ' + problem}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
