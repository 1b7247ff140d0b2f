import duckdb
import pytest
from conftest import SMALL

from skylode.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def cell(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    found = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    assert found or name in ("hard_negative_crops", "chain_verify")
    if name in catalog.ORACLES:
        result = duck.execute(catalog.ORACLES[name])
        order = [d[0] for d in result.description]
        assert sorted(order) == columns
        assert found == sorted(tuple(cell(r[order.index(c)]) for c in columns) for r in result.fetchall())


def test_the_split_is_one_of_scenes(spark):
    from skylode.plans import manifests

    folder = "/root/testdata/sf0.01"
    scenes = manifests._images(spark, folder).select("scene").distinct().count()
    assert manifests.dataset_split(spark, folder).select("group").distinct().count() == scenes > 200
