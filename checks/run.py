"""Run queries against their SQL: python -m checks.run [sf dir] [name prefix ...]."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype(object).where(df[c].notna(), None)
        df[c] = pd.Series([None if x is None else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
                           for x in df[c]], dtype=object)
    key = df.map(lambda x: "" if x is None else repr(x))
    return df.loc[key.sort_values(list(df.columns)).index].reset_index(drop=True)


def compare(spark_df, con, sql: str) -> tuple[str, int]:
    """'' when equal, else what differs; and the row count."""
    got = spark_df.toPandas()
    rel = con.sql(sql)
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    want = rel.df()
    mine = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema.fields}
    if set(mine) != set(types):
        return f"columns {sorted(mine)} vs {sorted(types)}", len(got)
    off = {c: (mine[c], types[c]) for c in mine if mine[c] != types[c]}
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)} {off}", len(got)
    a, b = _normal(got), _normal(want)
    if not a.equals(b):
        bad = [i for i in range(len(a)) if list(a.iloc[i]) != list(b.iloc[i])]
        return f"{len(bad)} rows differ, first:\n{a.iloc[bad[:2]].to_dict('records')}\n{b.iloc[bad[:2]].to_dict('records')} {off}", len(got)
    return (f"types {off}" if off else ""), len(got)


def main(argv: list[str]) -> int:
    from checks import load
    from platewise.session import build_session
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = load()
    spark = build_session("checks", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf), 0
    for name, fn in queries.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        t = time.time()
        try:
            if name in oracles:
                said, n = compare(fn(spark, sf), con, oracles[name])
            else:
                said, n = "", fn(spark, sf).count()
        except Exception as e:  # noqa: BLE001 - report and go on
            said, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        failed += bool(said)
        print(f"{'FAIL' if said else 'ok  '} {name} rows={n} {time.time() - t:.1f}s {'' if name in oracles else 'no-oracle'} {said}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
