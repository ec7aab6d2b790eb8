import compare
import pytest

from stratafile.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, name):
    compare.same(spark, name, catalog.QUERIES[name], catalog.SQL[name])


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark).toPandas()
    assert len(found) == 46 and found["location_count"].sum() == 96
    assert found["reclaimable_bytes"].sum() == 81_285


def test_registry_equality_sees_a_missing_key(spark, monkeypatch):
    from stratafile.operators import analyzers
    from stratafile.plans import catalog

    count = lambda: catalog.QUERIES["u7_registry_equality"](spark, "/root/testdata/sf0.001").first()["differences"]
    assert count() == 0
    monkeypatch.setattr(analyzers, "REGISTRY", analyzers.REGISTRY[1:])
    assert count() == 3
