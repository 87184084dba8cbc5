"""Run registered queries and compare them with their SQL: ``python -m textlens.plans.check SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from textlens.plans import PLANS
from textlens.session import build_session, release_scratch

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """The given tables as views."""
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows as sorted text, so that types of the two engines compare."""

    def text(value: object) -> str:
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return "null"
        if isinstance(value, (bool,)) or type(value).__name__ == "bool_":
            return str(bool(value))
        if isinstance(value, pd.Timestamp):
            return str(value)
        if hasattr(value, "isoformat"):
            return str(pd.Timestamp(value))
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            return repr(round(float(value), 9))
        return str(value)

    plain = frame[sorted(frame.columns)].astype(object).map(text)
    return plain.sort_values(list(plain.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """What differs between two results, or None."""
    if sorted(got.columns) != sorted(expected.columns):
        return f"columns {sorted(got.columns)} != {sorted(expected.columns)}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    kinds = {c: (got[c].dtype.kind, expected[c].dtype.kind) for c in got.columns if got[c].dtype.kind != expected[c].dtype.kind}
    if kinds and len(got):
        return f"types differ: {kinds}"
    a, b = _plain(got), _plain(expected)
    wrong = (a != b).any(axis=1)
    if wrong.any():
        return f"{int(wrong.sum())} rows differ, first {str(a[wrong].iloc[0].to_dict())[:400]} != {str(b[wrong].iloc[0].to_dict())[:400]}"
    return None


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(PLANS)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = tables(sf_dir), 0
    for name in names:
        begin = time.time()
        try:
            got = PLANS[name].run(spark, sf_dir).toPandas()
            took = time.time() - begin
            sql = PLANS[name].sql
            verdict = "rows only" if sql is None else difference(got, con.execute(sql).df()) or "equal"
        except Exception as error:  # report every query
            took, verdict, got = time.time() - begin, f"ERROR {str(error)[:1500]}", []
        failed += verdict not in ("equal", "rows only")
        print(f"{name:28s} {took:6.2f}s +{time.time() - begin - took:5.2f}s {len(got):8d} rows  {verdict}", flush=True)
    release_scratch(spark)
    spark.stop()
    print(f"{failed} failed of {len(names)}")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
