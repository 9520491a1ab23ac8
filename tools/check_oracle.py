"""Run catalog queries against their SQL twins and report differences.

Usage: python tools/check_oracle.py SF_DIR [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


_FAMILY = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string",
           "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


def compare(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    """Differences between the two engines; empty when equal."""
    df = query(spark, sf_dir)
    mine = _normal(df.columns, df.collect())
    res = con.execute(sql)
    types = {d[0]: str(d[1]) for d in res.description}
    other = _normal([d[0] for d in res.description], res.fetchall())
    if mine[0] != other[0]:
        return [f"columns {mine[0]} against {other[0]}"]
    out = [f"type of {n}: {t} against {types[n]}" for n, t in df.dtypes
           if _FAMILY.get(types[n], types[n]) != t]
    if len(mine[1]) != len(other[1]):
        out.append(f"rows {len(mine[1])} against {len(other[1])}")
    ours, theirs = set(mine[1]), set(other[1])
    only = [r for r in mine[1] if r not in theirs][:2]
    rest = [r for r in other[1] if r not in ours][:2]
    if not only and not rest and mine[1] != other[1]:
        out.append("same rows in different numbers")
    if only or rest:
        out.append(f"values {only} against {rest}")
    return out


def main() -> int:
    from pyspark.sql import SparkSession

    from stepfall.plans import catalog, oracle

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = oracle_connection(sf_dir), 0
    for name, query in catalog.QUERIES.items():
        if wanted and name not in wanted:
            continue
        if name not in oracle.SQL:
            print(f"{name:26s} no SQL")
            continue
        start = time.time()
        try:
            found = compare(spark, con, query, oracle.SQL[name], sf_dir)
        except Exception as e:  # report and go on with the next query
            found = [f"{type(e).__name__}: {str(e)[:500]}"]
        bad += bool(found)
        print(f"{name:26s} {'DIFF' if found else 'ok':5s} {time.time() - start:6.1f}s")
        for line in found:
            print("    " + line[:700])
    print(f"{bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
