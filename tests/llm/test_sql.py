"""The operators' queries against their twins in SQL."""

from pathlib import Path

import duckdb
import pytest

from feedloom.llm import queries


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    held = df[sorted(df.columns)].astype(object)
    return sorted(held.where(held.notna(), None).itertuples(index=False, name=None), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(name, spark, db, sf_dir):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), db.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)
