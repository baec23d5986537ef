import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from netsift.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_pass_documents_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()


def test_stages_on_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (3, "x y"), (None, "x y"), (4, None)], "doc_id long, text string")
    left = corpus_pipeline.ngram_jaccard_join(spark, docs, SF).collect()
    assert sorted((r.doc_id is not None, r.doc_id) for r in left if r.doc_id) == [(True, 1), (True, 3), (True, 4)] and sum(r.doc_id is None for r in left) == 1


def test_one_id_with_different_texts(spark):
    near, clean, own = "a b c d e f g h", "other words that stand nowhere else at all", "one two three four five six seven"
    rows = [(1, near), (2, near.upper()), (2, clean), (5, own), (5, own.upper()), (5, own), (6, None), (6, None), (7, ""), (7, "")]
    left = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert left.columns == ["doc_id", "text"]
    got = sorted((r.doc_id, r.text if r.doc_id != 5 else "own") for r in left.collect() if r.text)
    assert got == [(1, near), (2, clean), (5, "own")]
    assert sorted((r.doc_id, r.text) for r in left.collect() if not r.text) == [(6, None), (6, None), (7, ""), (7, "")]


EXTRA = ("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "found", "carried", "row", "count", "component_id", "id", "first", "n_shingles", "lang_pred", "score", "item_id", "sequence_id", "piece", "_row_of_id_and_text", "_Row_Of_Id_And_Text_")


def test_extra_columns_named_like_those_of_stages_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    more = docs.withColumns({name: F.concat(F.lit(f"{name}:"), "doc_id") for name in EXTRA})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns, name
        plain = stage(spark, docs, SF)
        rows = sorted(map(str, out.select(*docs.columns, *[f"`{c}`" for c in EXTRA]).collect()))
        assert rows == sorted(map(str, plain.withColumns({c: F.concat(F.lit(f"{c}:"), "doc_id") for c in EXTRA}).collect())), name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, more, SF).count() == last(spark, docs, SF).count()


@pytest.mark.parametrize("name", queries.ORACLES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())
