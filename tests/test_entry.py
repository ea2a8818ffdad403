import pathlib

import pytest

import __spark_entry__ as driver

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not pathlib.Path(SMALL).exists(), reason="no test tables")


def test_entry(spark):
    assert driver.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", ["keyword_classify", "text_normalise", "tfidf_terms", "week_buckets", "cluster_similarity", "cluster_stats", "clean_cluster_listing", "set_mean_manhattan", "doc_vector_mean"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "documents labels embeddings benchmark pages events orders".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = driver.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.execute(driver.oracle_sql()[name])
    order = [d[0] for d in want.description]
    rows = sorted(map(str, (tuple(r[order.index(c)] for c in columns) for r in want.fetchall())))
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == rows
