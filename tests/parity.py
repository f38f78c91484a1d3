"""Run a registered query and its SQL twin side by side."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(frame.columns):
        out[c] = frame[c].map(lambda v: "NULL" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else (
            f"{v:.6f}" if isinstance(v, float) else str(v)))
    result = pd.DataFrame(out)
    return result.sort_values(list(result.columns)).reset_index(drop=True) if len(result.columns) else result


def compare(spark, con, sf_dir: str, name: str, fn, sql: str) -> str | None:
    """None when equal, otherwise a description of the difference."""
    mine_raw = fn(spark, sf_dir).toPandas()
    theirs_raw = con.execute(sql).df()
    if sorted(mine_raw.columns) != sorted(theirs_raw.columns):
        return f"columns {sorted(mine_raw.columns)} vs {sorted(theirs_raw.columns)}"
    kinds = {
        c: (str(mine_raw[c].dtype), str(theirs_raw[c].dtype))
        for c in mine_raw.columns
        if str(mine_raw[c].dtype) != str(theirs_raw[c].dtype)
        and {str(mine_raw[c].dtype), str(theirs_raw[c].dtype)} - {"object", "str", "string"}
    }
    if kinds and len(mine_raw):
        return f"types {kinds}"
    mine, theirs = normal(mine_raw), normal(theirs_raw)
    if len(mine) != len(theirs):
        both = mine.merge(theirs, how="outer", indicator=True)
        return f"rows {len(mine)} vs {len(theirs)}\n" + both[both._merge != "both"].head(8).to_string()
    if not mine.equals(theirs):
        both = mine.merge(theirs, how="outer", indicator=True)
        return "values\n" + both[both._merge != "both"].sort_values(list(mine.columns)).head(8).to_string()
    if not len(mine):
        return "EMPTY"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from alertloom.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("parity", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        begin = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, name, fn, oracles[name])
            else:
                n = len(fn(spark, sf_dir).toPandas())
                problem = None if n else "EMPTY (no oracle)"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - begin:.1f}s"
              + ("" if name in oracles else " (rows only)") + ("" if problem is None else f"\n     {problem}"), flush=True)
    print("failures:", bad)
    spark.stop()
