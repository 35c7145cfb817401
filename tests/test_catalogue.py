"""Every registered query of the main library against its DuckDB SQL, at the smallest scale."""

import duckdb
import pytest

from tsveil.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF).toPandas()
    theirs = duck.sql(catalogue.ORACLE_SQL[name]).df()
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (ours, theirs))
    assert len(a) and a.astype(str).equals(b.astype(str))


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_audit_finds_nothing(spark):
    assert [r for r in catalogue.anonymity_audit(spark, SF).collect() if r["rows"]] == []


def test_reports(spark):
    out = catalogue.stat_pivot(spark, SF).collect()
    assert {r["metric"] for r in out} == {"eta", "tot_pattern_loss", "avg_pattern_loss", "tot_value_loss", "avg_value_loss"}
    assert all(r["value_first"] is not None and r["pattern_first"] is not None for r in out)


def test_series_are_normalised_once_a_row(spark):
    plan = catalogue.reconstruct_fv(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT(") == 1  # one standard deviation, neither in a filter nor for each value


def test_exploded_leaves_out_empty_arrays(spark):
    rows = spark.createDataFrame([(1, [0.5, None]), (2, []), (3, None)], "id long, v array<double>")
    assert sorted(map(tuple, catalogue.exploded(rows, "v", "id").collect())) == [(1, 0, 0.5), (1, 1, None)]
