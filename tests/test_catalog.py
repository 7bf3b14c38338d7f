"""Every registered query of the facts engine against its SQL twin."""

import math

import duckdb
import pytest

from factline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in values:
        cells = [r[i] for i in order]
        out.append(tuple(round(x, 6) if isinstance(x, float) and not math.isnan(x) else x for x in cells))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SMALL)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["scan_symbols"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_brand), EqualTo(p_brand,Brand#7)]" in plan
    assert "p_retailprice" not in plan
    for name in ("change_detection", "owning_resource", "innermost_symbol", "unique_match", "factory_calls"):
        plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_batch_equals_single_queries(spark):
    from factline.plans.service import batch

    names = ["file_count", "kind_histogram", "no_such_query", "throttle_levels", "scored_results"]
    got = {a.name: a for a in batch(spark, SMALL, names)}
    for n in names[:2]:
        assert not got[n].truncated and sorted(map(tuple, got[n].rows)) == sorted(map(tuple, catalog.QUERIES[n](spark, SMALL).collect()))
    assert isinstance(got["no_such_query"].error, KeyError)
    assert len(got["throttle_levels"].rows) == 1000 and not got["throttle_levels"].truncated  # exactly as many
    assert len(got["scored_results"].rows) == 1000 and got["scored_results"].truncated
    with pytest.raises(ValueError):
        batch(spark, SMALL, ["file_count"] * 11)
