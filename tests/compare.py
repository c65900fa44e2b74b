"""Run registered queries and their SQL side by side:
`python tests/compare.py [sf_dir] [name ...]`."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(frame) -> list[tuple]:
    """Rows with columns by name, order-free."""
    columns = sorted(frame.columns)
    table = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(r) for r in table.itertuples(index=False)), key=repr)


_KINDS = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "INTEGER": "int", "BOOLEAN": "boolean"}


def difference(spark_df, con, sql: str) -> str | None:
    """None if both sides agree in names, types and rows."""
    want = con.execute(sql)
    kinds = {d[0]: _KINDS.get(str(d[1]), str(d[1])) for d in want.description}
    have_kinds = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    if kinds != have_kinds:
        return f"types: spark {have_kinds}, sql {kinds}"
    want_rows, have_rows = rows_of(want.df()), rows_of(spark_df.toPandas())
    if len(want_rows) != len(have_rows):
        return f"rows: spark {len(have_rows)}, sql {len(want_rows)}"
    wrong = [(h, w) for h, w in zip(have_rows, want_rows) if h != w]
    return f"{len(wrong)} rows differ, first: {wrong[0]}" if wrong else None


def main() -> int:
    from seekwell import local_session
    from seekwell.workload import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = difference(df, con, ORACLES[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        checked = "ok" if name in ORACLES else "ok (rows only)"
        print(f"{name:32} {time.time() - start:6.2f}s  {problem or checked}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
