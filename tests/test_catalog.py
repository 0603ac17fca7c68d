"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from riverbed.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def shown(v):
    return repr(round(v, 6) if isinstance(v, float) else int(v) if type(v).__name__ == "Decimal" else v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLES:
        assert rows
        return
    found = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(shown(r[k]) for k in at) for r in found.fetchall())


def test_no_cartesian_products(spark):
    for name in ("flow_list_service_ua_contains", "matches_projected", "raw_suppressed", "rule_longest_prefix"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_spool_totals_beyond_bigint(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    pages = spark.createDataFrame([(5_000_000_000, "http://a/b", ""), (5_000_000_001, "http://a/c", "")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    run = catalog.QUERIES["spool_read_back"]
    rows = {r["table"]: (r["rows"], r["total"]) for r in run(spark, str(tmp_path)).collect()}
    assert rows["http_messages"] == (2, 10_000_000_001_000_000_000) and rows["flows"][0] > 0
    pages.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    empty = run(spark, str(tmp_path))
    assert dict(empty.dtypes)["total"] == "bigint" and {r["table"]: r["total"] for r in empty.collect()} == {t: None if t == "http_messages" else int(n[1]) for t, n in rows.items()}
