"""Every registered query of the entity store against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tarn.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql()) and len(catalogue.queries()) >= 70


def rows(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: None if v is None or v != v or v is pd.NaT else round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    ours = catalogue.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_search_tokens_of_all_languages(spark, duck):
    ours = {r["uuid"] for r in catalogue.queries()["search_tokens_all"](spark, SF).select("uuid").collect()}
    assert ours == {k for (k,) in duck.execute("SELECT doc_id FROM documents").fetchall()}
    assert duck.execute("SELECT count(*) FROM documents WHERE lang <> 'en'").fetchone()[0] > 0
