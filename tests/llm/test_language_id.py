import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsift.llm import language_id as L

SF = "/root/testdata/sf0.001"


def _bucket(gram):
    value = len(gram)
    for c in gram:
        value = (value * 0x100000001B3 + ord(c)) % 2**64
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        value = (value ^ value >> shift) * factor % 2**64
    return (value ^ value >> 31) >> (64 - L.BUCKET_BITS)


def _grams(text):
    text = text.lower()
    return Counter(_bucket(text[i : i + n]) for n in L.ORDERS for i in range(len(text) - n + 1))


def _by_force(rows):
    """A plain naive Bayes: language and probability by text."""
    labelled = [(t, g) for t, g in rows if t is not None and g is not None]
    sizes = Counter(g for _, g in labelled)
    sums = {g: Counter() for g in sorted(sizes)}
    for t, g in labelled:
        sums[g].update(_grams(t))
    logs = {g: (c, math.log(c.total() + L.BUCKETS)) for g, c in sums.items()}

    def predicted(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        at = {g: math.log(sizes[g] / len(labelled)) + sum(n * (math.log(1 + c[b]) - whole) for b, n in _grams(text).items()) for g, (c, whole) in logs.items()}
        best = max(at, key=lambda g: (at[g], [-ord(x) for x in g]))
        return best, 1 / sum(math.exp(v - at[best]) for v in at.values())

    return predicted


def test_against_a_plain_naive_bayes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    learned = spark.createDataFrame([r for r in rows if r.doc_id % 2], docs.select("doc_id", "text", "lang").schema)
    predicted = _by_force([(r.text, r.lang) for r in rows if r.doc_id % 2])
    got = {r.doc_id: r for r in L.predict(docs, L.train(learned)).collect()}
    for r in rows:
        language, score = predicted(r.text)
        assert got[r.doc_id].lang_pred == language and got[r.doc_id].score == pytest.approx(score, abs=1e-3)


@pytest.mark.parametrize("chunk", [7, 50, 500_000])
def test_chunks_count_as_the_whole(monkeypatch, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    texts = ["", "a", "ab", "abc" * 40, "é漢\U0001f600 x", "z" * 123]
    got = [Counter() for _ in texts]
    for text, bucket, n in L.sparse_counts(texts):
        for t, b, k in zip(text.tolist(), bucket.tolist(), n.tolist()):
            got[t][b] += k
    assert got == [_grams(t) for t in texts]


def test_memory_of_a_long_text_and_many_languages():
    rnd = np.random.default_rng(1)
    model = L.Model([f"l{i:03}" for i in range(100)], rnd.normal(size=(L.BUCKETS, 100)).astype(np.float32), np.zeros(100))
    text = "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(100_000)) * 50
    tracemalloc.start()
    model.score([text])
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_ties_nulls_and_rows_that_repeat(spark):
    rows = [(1, "ab", "y", 1), (1, "ab", "x", 2), (2, "cd", None, 3), (2, None, "x", 4), (None, "", None, 5), (None, "12", None, 6), (3, "ab", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred long")
    got = sorted((r.doc_id or 0, r.lang_pred, round(r.score, 3)) for r in L.identify_languages(docs).collect())
    assert [x for x in got if x[0] == 3] == [(3, "x", 0.5)] and len(got) == 7
    assert sum(x[1] == "und" for x in got) == 3
    kept = L.in_known_language(docs, L.train(docs))
    assert kept.columns == docs.columns and kept.count() == 4


def test_a_rare_label_is_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "LEAST_ROWS", 5)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4, "xyzzy zyx").otherwise("abba cab").alias("text"), F.when(F.col("id") < 4, "rare").otherwise("common").alias("lang"))
    model = L.train(docs, sample_rows=100)
    assert model.languages == ["common", "rare"] and model.score(["zyx xyz"])[0] == ["rare"]


def test_the_stage_of_the_pipeline_tells_every_language(spark):
    """Into lang, for rows without a label and for those with a wrong one, and on to the packed pieces; und go."""
    import corpus_pipeline

    rows = [(i, *(("abba cab", "a"), ("xyzzy zyx", "x"))[i % 2]) for i in range(40)] + [(40, "abba", None), (42, "zyx zyx zyx", "a"), (43, "123", "a"), (44, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.language_id(spark, docs, "")
    assert out.columns == docs.columns and {r.doc_id: r.lang for r in out.collect()} == {**{i: "ax"[i % 2] for i in range(40)}, 40: "a", 42: "x"}
    packed = corpus_pipeline.best_fit_packing(spark, out.where("doc_id >= 40"), "")
    assert {r.doc_id: r.lang for r in packed.collect()} == {40: "a", 42: "x"}


def test_all_labelled_rows_are_learned_from(spark):
    """One more than the 20,000 of the sample that was the default, and the only one of its letters."""
    docs = spark.range(20_201).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 20_200, "qqqq").otherwise("ab").alias("text"), F.lit("a").alias("lang"))
    docs = docs.union(spark.createDataFrame([(-1, "b", "b")], docs.schema))
    rows = L.train(docs.where("doc_id <> 20200")).rows, L.train(docs).rows
    assert not np.array_equal(*rows)
