"""Compare a Spark result with a DuckDB statement over the same Parquet files."""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(t: pa.DataType) -> str:
    return "string" if pa.types.is_large_string(t) or pa.types.is_string_view(t) else str(t).replace(", tz=UTC", "")


def compare(df: DataFrame, sql: str, sf_dir: str) -> dict:
    """Row counts, columns, types that differ, and rows found on one side only."""
    got = df.toArrow()
    con = connect(sf_dir)
    want = con.sql(sql).to_arrow_table()
    cols = sorted(got.column_names)
    report = {
        "rows": (got.num_rows, want.num_rows),
        "columns": sorted(set(cols) ^ set(want.column_names)),
    }
    if report["columns"]:
        return report | {"ok": False}
    types = {c: (_plain(got.schema.field(c).type), _plain(want.schema.field(c).type)) for c in cols}
    report["types"] = {c: t for c, t in types.items() if t[0] != t[1]}
    con.register("got", got)
    con.register("want", want)
    names = ", ".join(f'"{c}"' for c in cols)
    extra = con.sql(f"SELECT {names} FROM got EXCEPT ALL SELECT {names} FROM want").to_arrow_table()
    lacking = con.sql(f"SELECT {names} FROM want EXCEPT ALL SELECT {names} FROM got").to_arrow_table()
    report["differing"] = (extra.num_rows, lacking.num_rows)
    report["ok"] = not (extra.num_rows or lacking.num_rows)
    report["sample"] = (extra.slice(0, 2000).to_pylist(), lacking.slice(0, 2000).to_pylist())
    return report
