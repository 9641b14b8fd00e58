"""The registered queries on the driver's tables: SQL, held-out rows, and the pipeline."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from brute import contamination, fingerprint, groups

import corpus_pipeline
from strandline.llm.queries import ORACLE, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")
tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "conversations"):
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, database, name):
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


def test_language_of_held_out_rows(spark, database):
    lang = dict(database.execute("select doc_id, lang from documents").fetchall())
    rows = QUERIES["op2_language"](spark, SF_DIR).filter("held_out").collect()
    right = [row.lang_pred == lang[row.doc_id] for row in rows]
    assert len(right) > 40 and np.mean(right) > 0.95


def test_main_text_of_all_pages(spark, database):
    pages = database.execute("select count(*) from pages").fetchone()[0]
    found = QUERIES["op3_html_text"](spark, SF_DIR)
    assert found.count() == pages and not found.filter("n_chars = 0").count()
    marks = "text like '%<p>%' or text like '%track(%' or text like '%&copy;%'"
    assert not found.filter(marks).count()


def test_pipeline(spark, database):
    from tokenizers import Tokenizer

    documents = database.execute("select doc_id, text, source from documents order by 1").fetchall()
    items = database.execute("select item_id, text from benchmark").fetchall()
    judged = QUERIES["op2_language"](spark, SF_DIR).filter("lang_pred <> 'und'")
    known = {row.doc_id for row in judged.collect()}
    rows = [row for row in documents if row[0] in known]
    least = groups([fingerprint(text) for _, text, _ in rows])
    rows = [row for i, row in enumerate(rows) if least[i] == i]
    rows = [row for row in rows if not contamination(row[1], items)[1]]
    kept = spark.createDataFrame(rows, "doc_id long, text string, source string")
    database.register("kept", kept.toArrow())
    sql = ORACLE["op5_mixing"].replace("FROM documents", "FROM kept")
    taken = database.execute(f"select doc_id, taken // size from ({sql}) where taken > 0").fetchall()
    copies = {doc: int(n) for doc, n in taken}
    library = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for doc, text, _ in rows:
        for _ in range(copies.get(doc, 0)):
            ids = [*library.encode(text, add_special_tokens=False).ids, 2]
            want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    found = corpus_pipeline.run(spark, SF_DIR).orderBy("start").collect()
    assert [tuple(row) for row in found] == want


def test_toxic_words_of_held_out_rows(spark):
    larger = "/root/testdata/sf0.01"
    if not os.path.isdir(larger):
        pytest.skip("driver tables are not here")
    toxic = dict(duckdb.execute(f"select doc_id, toxic from '{larger}/labels.parquet'").fetchall())
    rows = QUERIES["op10_toxicity"](spark, larger).filter("held_out").collect()
    known = [(row.score, toxic[row.doc_id]) for row in rows if row.doc_id in toxic]
    bad = [score for score, label in known if label]
    good = [score for score, label in known if not label]
    above = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert above > 0.7
