"""Each testbed query against the same question asked in SQL of another engine."""

import os

import pytest
from pyspark.sql import functions as F

from strandline import testbed
from strandline.testbed_oracle import ORACLE
from strandline.testbed_queries import QUERIES

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(
    not os.path.isdir(SF_DIR), reason="driver tables are not here"
)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in ("lineitem", "documents", "orders", "region"):
        connection.execute(
            f"create view {table} as select * from '{SF_DIR}/{table}.parquet'"
        )
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    ours = QUERIES[name](spark, SF_DIR).toArrow()
    database.register("ours", ours)
    database.execute(f"create or replace temp table theirs as {ORACLE[name]}")
    names = [row[0] for row in database.execute("describe theirs").fetchall()]
    assert sorted(ours.column_names) == sorted(names)
    columns = ", ".join(f'"{column}"' for column in sorted(names))
    for left, right in (("ours", "theirs"), ("theirs", "ours")):
        rest = database.execute(
            f"select count(*) from (select {columns} from {left}"
            f" except all select {columns} from {right})"
        )
        assert rest.fetchall() == [(0,)]


def test_reads_and_pairs_hold_whole_texts(spark, database):
    total = database.execute("select sum(length(text)) from documents").fetchone()[0]
    reads = testbed.view(spark, SF_DIR, "reads")
    assert reads.agg(F.sum(F.length("seq"))).first()[0] == total
    # mates overlap by less than either, and all of an insert is in one of them
    pairs = testbed.view(spark, SF_DIR, "read_pairs").select(
        (F.length("seq1") + F.length("seq2")).alias("n")
    )
    n = pairs.agg(F.sum("n"), F.count("*")).first()
    assert total <= n[0] <= 1.3 * total + 2 * n[1]
