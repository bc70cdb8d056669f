"""Odd inputs that every operator must survive, and a DuckDB runner."""

import os

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp long, rank long, word string, score double, spans string"


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = "The quick brown fox jumps over the lazy dog. token = 'abcdef0123456789' " * 3000
    rows = [
        (1, "Hello world, this is a text.", "en", "a", 3),
        (1, "Hello world, this is a text.", "en", "a", 3),
        (None, None, None, None, None),
        (None, "", "en", "", 0),
        (2, "", None, None, 0),
        (3, None, "en", "a", None),
        (4, long, "en", "a", len(long)),
        (5, "!!! ### 123", "en", "a", 11),
        (6, "Ünïcödé wörds 😀 und Straße", "de", "b", 26),
        (7, "Hello world, this is a text.", "en", "b", 3),
        (8, " \t\n ", "fr", "b", 4),
    ]
    return spark.createDataFrame([(*r, 1, 2, 3, "w", 0.5, "s") for r in rows], DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def duck(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con.execute(sql).df()


def same_rows(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert rows(a) == rows(b)
