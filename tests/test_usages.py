"""References and ambiguities: odd rows against SQL, and how many rows their joins make."""

import time

import pandas as pd
import pytest

from codelode.operators import relations

SQL = """
WITH seen AS (SELECT lower(unit) AS unit, lower(used) AS used FROM uses UNION SELECT lower(unit), lower(unit) FROM u),
found AS (SELECT u.usage_id, u.unit, u.name, s.symbol_id, s.unit || '.' || s.name AS candidate FROM u JOIN s ON lower(u.name) = lower(s.name)
  JOIN seen ON seen.unit = lower(u.unit) AND lower(s.unit) = seen.used),
counted AS (SELECT *, count(*) OVER (PARTITION BY usage_id) AS n FROM found)
"""
REFS = "SELECT usage_id, unit, name, symbol_id FROM counted WHERE n = 1"
AMBIGUOUS = "SELECT usage_id, unit, name, string_agg(candidate, '; ' ORDER BY candidate) AS candidates FROM counted WHERE n > 1 GROUP BY ALL"


def join_rows(spark, began):
    """The most rows that one join has made in the queries from number ``began`` on."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    time.sleep(1)  # the store hears of a query after its end
    for number in range(began, store.executionsCount()):
        values = store.executionMetrics(number)
        nodes = store.planGraph(number).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def frames(spark, usages, symbols, uses):
    return (
        spark.createDataFrame(usages, "usage_id long, unit string, name string"), spark.createDataFrame(symbols, "symbol_id long, unit string, name string"),
        spark.createDataFrame(uses, "unit string, used string"),
    )


def test_odd_usages(spark, same):
    import duckdb

    usages = [
        (1, "A", "x"), (2, "A", "X"), (2, "A", "X"),  # a row that repeats
        (3, "a", "y"), (3, "B", "y"),  # one id, two units, one candidate each
        (4, "B", "x"), (4, "B", "x"), (5, "B", "nothing"), (6, None, "x"), (7, "A", None), (None, "A", "z"), (None, "C", "z"), (8, "C", "z"), (9, "C", "Y"), (10, "A", "z"),
    ]
    symbols = [(1, "a", "X"), (2, "b", "x"), (3, "B", "x"), (4, "b", "Y"), (5, "c", "z"), (6, None, "x"), (7, "a", None), (8, "d", "y")]
    uses = [("A", "B"), ("a", "b"), ("A", "c"), ("c", "D"), (None, "a"), ("a", None)]
    con = duckdb.connect()
    for name, rows, columns in (("u", usages, ["usage_id", "unit", "name"]), ("s", symbols, ["symbol_id", "unit", "name"]), ("uses", uses, ["unit", "used"])):
        con.register(name + "_", pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns if c.endswith("_id")}))
        con.execute(f"create table {name} as select * from {name}_")
    refs, ambiguous = relations.resolve_usages(*frames(spark, usages, symbols, uses))
    expected = [con.execute(SQL + q).df() for q in (REFS, AMBIGUOUS)]
    assert all(len(x) > 2 for x in expected)
    same(refs.toPandas().astype({"usage_id": "Int64"}), expected[0].astype({"usage_id": "Int64"}))
    same(ambiguous.toPandas().astype({"usage_id": "Int64"}), expected[1].astype({"usage_id": "Int64"}))


@pytest.mark.parametrize("which", [0, 1])
def test_usages_do_not_multiply_symbols(spark, which):
    """400 usages that see 300 symbols each: 120,000 candidates, no row for each."""
    usages = [(i, f"unit{i % 2}", "x") for i in range(400)] + [(1000 + i, "unit0", f"y{i}") for i in range(50)]
    symbols = [(i, f"UNIT{i % 3}", "X") for i in range(300)] + [(1000 + i, "unit1", f"y{i}") for i in range(50)]
    uses = [(f"unit{i}", f"unit{j}") for i in range(2) for j in range(3)]
    began = spark._jsparkSession.sharedState().statusStore().executionsCount()
    rows = relations.resolve_usages(*frames(spark, usages, symbols, uses))[which].collect()
    assert len(rows) == (50, 400)[which]
    if which:
        assert all(len(r.candidates.split("; ")) == 300 for r in rows)
    assert join_rows(spark, began) <= 1000
