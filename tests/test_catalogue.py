"""Every query against its SQL in DuckDB, on the smallest tables."""

import hashlib
import os
import re

import duckdb
import pandas as pd
import pytest

from docloom.plans import catalogue

DATA = os.environ.get("DOCLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def shown(v):
    """Numbers alike whatever their type; nulls in one form."""
    if isinstance(v, bool | str):
        return str(v)
    return "NULL" if pd.isna(v) else f"{v:.6f}" if isinstance(v, int | float) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(shown, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, DATA)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    want = db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


def test_entry(spark):
    assert catalogue.entry(spark, DATA).count() == 4


def test_lookup_digests_cover_every_row_and_the_whole_text(spark):
    texts = ["a" * 250 + "B", "a" * 250 + "C", " Lead (x) ", "tail\n", "\u00a0A-b\u3000", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["digest"] for r in catalogue.normalize_lookup({"documents": docs}.__getitem__).collect()}
    plain = [re.sub(r"[ \n\r\t,:;(){}\[\]\"'`“”‘’%\-_/]", "", t or "").strip().lower() for t in texts]
    assert got == {i: hashlib.md5(p.encode()).hexdigest() for i, p in enumerate(plain)}
