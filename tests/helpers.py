"""Running a registered query next to its DuckDB oracle."""

import math

import duckdb

from trackspark import plans
from trackspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


def compare(spark, name: str, sf: str = SF) -> None:
    plans.load()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    expected = con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(expected.fetchall(), expected.columns)
