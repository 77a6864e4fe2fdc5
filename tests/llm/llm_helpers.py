"""Small tables and oracles for the tests of the llm operators."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
WORDS = "der die das und ist nicht the of and that with from les des une dans pour avec".split()


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else float(f"{value:.9g}") if isinstance(value, float) else value


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def matches_oracle(spark, queries, name, folder=SF):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = queries.QUERIES[name](spark, folder)
    expected = con.sql(queries.ORACLES[name])
    columns, rows = expected.columns, expected.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert sorted_rows([tuple(r) for r in df.collect()], df.columns) == sorted_rows(rows, columns)


ODD_TEXTS = [
    None, "", " \t\n", "one", "Two words", "a b c d e", "a b c d e", "A B C D E", "Ünïcödé 日本語 😀 text", "x" * 5000, "word " * 3000,
    "MIT License and the Apache License, GNU General Public License", "mit\x00license", "<|im_end|> <|endoftext|> <!|", "'s it's 12 3.4 — …", "line one\r\nline two\x0b\x0cend",
]


def odd_documents(spark, folder):
    """Documents with nulls in every column, odd texts, repeated rows, and columns whose names clash with inner ones."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t) if t else None, i, "k", 1.5) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[3], rows[5], (None, "one more text without an id", "de", "s1", 27, 1, "k", 0.0), (None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, score double"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/documents.parquet")


def empty_tables(spark, folder):
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
