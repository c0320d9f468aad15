import os

import pytest

duckdb = pytest.importorskip("duckdb")
from siftwell.plans import catalog  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    df = df[sorted(df.columns)]
    show = lambda v: round(v, 9) if isinstance(v, float) else v.tolist() if hasattr(v, "tolist") else v
    return list(df.columns), sorted(repr([show(v) for v in r]) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows_of(got) == rows_of(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_sources_are_spread(spark):
    """The part table is one small file; the work on the sources made of it goes to all cores."""
    rows = catalog._sources(spark, SF)
    per_task = [n for n in rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert len(per_task) >= spark.sparkContext.defaultParallelism and max(per_task) < sum(per_task) / 4
    assert rows.filter("content is null").count() == 0


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
