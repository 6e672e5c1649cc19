"""Every registered query against its SQL."""

import pytest

from codelode.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, sf_dir, same, name):
    same(catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df())


def test_representative_cycles_close(spark, sf_dir):
    for row in catalog.QUERIES["representative_cycles"](spark, sf_dir).collect():
        path = row["cycle"].split(" -> ")
        assert len(path) >= 2 and path[0] == path[-1] and len(set(path[:-1])) == len(path) - 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["src", "dst", "edge_kind", "scc_id", "rank", "hint"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
