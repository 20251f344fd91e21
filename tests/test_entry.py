import duckdb
import pytest

import __spark_entry__ as e
from nearfield.plans import queries, sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    rows = e.entry(spark).orderBy("rank").collect()
    assert len(rows) == 5 and rows[0]["image_id"] == 0 and rows[0]["score"] == 0


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def plain(v):
    return None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["cosine_topk", "fused_weighted_topk", "multi_query_candidate", "knn_self_excluded", "zero_norm_distances", "catalog_upsert", "even_split", "string_functions", "timing_summary", "label_knn_vote"])
def test_queries_agree_with_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(sql.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = lambda xs: sorted((tuple(plain(v) for v in x) for x in xs), key=repr)
    assert rows(got.select(*names).collect()) == rows(want.fetchall())
