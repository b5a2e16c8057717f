"""A few registered queries against their SQL twins on the smallest tables."""
import os

import duckdb
import pytest

from checks.compare import TABLES, rows_of
from checks.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
NAMES = ["s2_accept_files", "p3_needs_retag", "a3_tag_hierarchy", "f7_key_insights", "k1_chunk_pages", "r4_bm25_phrases",
         "r9_hybrid_search", "k4_tf_terms", "u5_retag", "x4_live_tags_stream"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_every_twin_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, db, name):
    a, b = QUERIES[name](spark, DIR).toPandas(), db.sql(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows_of(a) == rows_of(b) and len(a)
