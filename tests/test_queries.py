import pytest

from tests.compare import connect, rows_of, rows_of_sql

from tessera.oracle import ORACLE_SQL
from tessera.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, con, name):
    names, rows = rows_of(QUERIES[name](spark, FOLDER))
    if name in ORACLE_SQL:
        assert (names, rows) == rows_of_sql(con, ORACLE_SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_metrics_takes_every_user_turn(spark):
    folder = "/root/testdata/sf0.1"
    turns = spark.read.parquet(f"{folder}/conversations.parquet").where("role = 'user'").count()
    row = QUERIES["import_metrics"](spark, folder).first()
    assert (row["scanned"], row["considered"], row["truncated"]) == (turns, turns, False) and turns > 500
