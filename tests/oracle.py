"""Run registered queries next to their reference SQL: python tests/oracle.py [name ...]"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _plain(value):
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return str(value)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_plain(r[i]) for i in order) for r in rows)


_FAMILY = {"tinyint": "int", "smallint": "int", "integer": "int", "bigint": "int", "hugeint": "huge", "long": "int",
           "varchar": "string", "double": "float", "float": "float", "timestamp_ntz": "timestamp",
           "timestamp with time zone": "timestamp"}


def _family(name):
    name = name.lower()
    return name if name.startswith("decimal") else _FAMILY.get(name, name)


def compare(df, sql: str, sf_dir: str) -> list[str]:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    types = {d[0]: str(d[1]) for d in expected.description}
    want = expected.fetchall()
    got = df.collect()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for f in df.schema:
        a, b = _family(f.dataType.simpleString()), _family(types[f.name])
        if a != b and b not in ("null", "\"null\""):
            problems.append(f"type of {f.name}: {a} vs {b}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    a, b = _rows(got, df.columns), _rows(want, names)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        problems.append(f"values differ; columns {sorted(names)}\n  spark {only_a}\n  sql   {only_b}")
    if not want:
        problems.append("EMPTY")
    return problems


def main(argv):
    import os

    from __spark_entry__ import oracle_sql, queries
    from tillwork.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    if "HOT_ROWS" in os.environ:   # make the ordered operators split groups of this size
        spark.conf.set("spark.tillwork.hotGroupRows", os.environ["HOT_ROWS"])
    sqls, failed = oracle_sql(), []
    for name, fn in queries().items():
        if argv and name not in argv and not any(a.endswith("*") and name.startswith(a[:-1]) for a in argv):
            continue
        started = time.time()
        try:
            df = fn(spark, sf_dir)
            problems = compare(df, sqls[name], sf_dir) if name in sqls else [] if df.count() else ["EMPTY"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s {'' if name in sqls else '(rows only)'}",
              *problems, sep="\n     " if problems else " ", flush=True)
        if problems:
            failed.append(name)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
