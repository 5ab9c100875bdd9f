import duckdb
import pytest

import __spark_entry__ as entry
from quarrylog.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["a4_error_groups", "a9_hour_buckets", "p1_detect_format", "f_fingerprint", "t12_blocks", "c3_clusters", "u4_top_commands"])
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "pages", "documents", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(plans.ORACLES[name]).df()
    got = plans.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert order(got) == order(want)
