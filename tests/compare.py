"""Run registered queries next to their SQL twins and compare the rows.

    python -m tests.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

from tallymill.session import TABLES


def connect(directory: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{directory}/{table}.parquet')")
    return con


def normal(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(timespec="microseconds")
    if isinstance(value, dict):
        return str(sorted((normal(k), normal(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return str([normal(v) for v in value])
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def kinds(frame):
    return {f.name: f.dataType.simpleString() for f in frame.schema.fields}


def compare(frame, con, sql):
    """None when equal, else a short account of the difference."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    mine, theirs = rows_of(frame.columns, frame.collect()), rows_of(names, result.fetchall())
    for name, kind in kinds(frame).items():
        other = types[name]
        wanted = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                  "boolean": "BOOLEAN"}.get(kind)
        if wanted and other != wanted:
            return f"type of {name}: {kind} != {other}"
    if mine == theirs:
        return None
    extra = [r for r in mine if r not in set(theirs)][:2]
    missing = [r for r in theirs if r not in set(mine)][:2]
    return f"{len(mine)} rows, expected {len(theirs)}\n  only here: {str(extra)[:700]}\n  only SQL:  {str(missing)[:700]}"


def main(argv):
    import __spark_entry__ as e
    from tallymill.session import build_session

    directory, names = argv[0], argv[1:]
    spark = build_session("compare", **{
        "spark.master": f"local[{os.environ.get('BENCH_CPUS', '8')}]", "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(directory), []
    queries, oracles = e.queries(), e.oracle_sql()
    wanted = [q for q in queries if not names or any(q.startswith(n.rstrip("*")) if n.endswith("*") else q == n for n in names)]
    for name in wanted:
        start = time.time()
        try:
            frame = queries[name](spark, directory)
            if name in oracles:
                problem, note = compare(frame, con, oracles[name]), ""
            else:
                problem, note = None, f"{frame.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem, note = f"{type(error).__name__}: {str(error)[:1500]}", ""
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s {note}{problem or ''}", flush=True)
        if problem is not None:
            bad.append(name)
    print(f"{len(wanted) - len(bad)} of {len(wanted)} agree; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
