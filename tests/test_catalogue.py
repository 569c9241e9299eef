"""Every query of the catalogue against its SQL."""

import duckdb
import pytest

from lumenary.plans import catalogue

from .oracle import difference


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf_dir, name):
    """Queries that SQL can't express; their operators are held against plain versions in test_rules."""
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert difference(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], sf_dir) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "rank", "id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "a|b\nfoo"), (2, "")],
        [(1, "a|b\nfoo"), (2, None)],
        [(1, "a|b\nfoo"), (None, "x" * 300 + "\n|"), (None, "|\ny")],
        [(1, "a|b\nfoo\n" + "y" * 250)] * 3 + [(2, "z" * 120 + "\n")],
        [(1, "a|b\nfoo\n" + "y" * 250), (1, None), (1, "")],
        [(1, ""), (2, None)],
    ],
    ids=["empty text", "null text", "null ids", "repeated rows", "repeated ids", "no text"],
)
def test_status_transitions_of_odd_documents(spark, tmp_path, rows):
    """Only documents that meet by their ids count, each with all of its id."""
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLES["status_transitions"]).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES["status_transitions"](spark, str(tmp_path)).collect())) == sorted(want)
