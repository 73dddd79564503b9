"""Run registered queries next to their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and a SQL result; empty when equal."""
    names = sorted(spark_df.columns)
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(described) != names:
        return [f"columns {names} vs {sorted(described)}"]
    problems = [
        f"type of {n}: {t} vs {described[n]}"
        for n, t in spark_df.dtypes
        if SAME.get(t) != described[n]
    ]
    picked = ", ".join(f'"{n}"' for n in names)
    theirs = Counter(
        tuple(map(_cell, row)) for row in con.execute(f"SELECT {picked} FROM ({sql})").fetchall()
    )
    ours = Counter(tuple(map(_cell, row)) for row in spark_df.select(*names).collect())
    if ours != theirs:
        problems.append(
            f"rows {sum(ours.values())} vs {sum(theirs.values())};"
            f" ours only {list((ours - theirs).items())[:3]}; theirs only {list((theirs - ours).items())[:3]}"
        )
    return problems


def main(sf_dir: str, wanted: list[str]) -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from lineflow.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracle:
                problems = compare(df, con, oracle[name])
                note = "equal" if not problems else "; ".join(problems)[:1500]
                note += f" ({df.count()} rows)" if not problems else ""
            else:
                problems, note = [], f"{df.count()} rows, no SQL"
        except Exception as error:  # report and go on
            problems, note = ["error"], f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:32s} {time.time() - started:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
