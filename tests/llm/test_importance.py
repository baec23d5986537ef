import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from netsift.llm import importance
from netsift.llm.importance import Crc, draw, features, resample

CLASH = "id long, row string, carried string, bucket int, n long, more string, all int, number int, enough string, band int, rank long, score string"


def words_of(text):
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def by_force(docs, target, orders=(1, 1), buckets=10_000, seed=2024, percent=10, least=20):
    """doc_id, n_features, weight, score by plain counting, and the ranks by (score, id)."""
    hashed = lambda t: [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for w in [words_of(t)] for n in range(orders[0], orders[1] + 1) for k in range(len(w) - n + 1)]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for into, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for b in hashed(text):
                into[b] += 1
    gains = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = hashed(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[b] for b in f) // len(f) if f else 0
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words_of(text)) >= least))
    enough = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, enough[: percent * len(enough) // 100]


def test_crc_of_spans_of_any_length():
    rnd = random.Random(5)
    crc, data = Crc(8), np.frombuffer(bytes(rnd.randrange(256) for _ in range(5000)), np.uint8)
    spans = [(a, rnd.randrange(1, 60)) for a in range(0, 4900, 13)] + [(0, 5000), (1, 4096), (7, 8), (7, 9), (0, 16)]
    start, length = np.array(spans).T
    assert crc.of(data, start, length).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in spans]


@pytest.mark.parametrize("orders", [(1, 1), (1, 3), (2, 2)])
@pytest.mark.parametrize("at_once", [64, 2_000_000])
def test_features_are_runs_of_words(orders, at_once, monkeypatch):
    monkeypatch.setattr(importance, "BYTES_AT_ONCE", at_once)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abXYZ019 .-é中\n_") for _ in range(rnd.randrange(300))) for _ in range(100)] + ["", "a", "é" * 5000, "Z" * 64, "q" * 65, "x y " * 90]
    got, words = [[] for _ in texts], np.zeros(len(texts), np.int64)
    for row, value in features(pa.array(texts), orders, Crc(), words):
        for r, x in zip(row.tolist(), value.tolist(), strict=True):
            got[r].append(x)
    for text, found, n in zip(texts, got, words.tolist(), strict=True):
        w = words_of(text)
        assert n == len(w) and sorted(found) == sorted(zlib.crc32(" ".join(w[k : k + m]).encode()) for m in range(orders[0], orders[1] + 1) for k in range(len(w) - m + 1))


def corpus():
    rnd = random.Random(7)
    text = lambda n: " ".join(rnd.choice(["the", "River", "stone", "él", "w1", "x9", "LIGHT"]) + str(rnd.randrange(4)) for _ in range(n))
    same = text(40)
    rows = [(i, text(rnd.randrange(0, 60))) for i in range(300)] + [(1000 + i, same) for i in range(50)]
    return [*rows, (2000, None), (2001, ""), (2002, " \n-"), (2003, "y" * 30_000), (2004, text(20_000)), (5, text(30)), (1000, same), (1000, same), (None, text(25)), (-3, text(19)), (-4, text(20))]


@pytest.mark.parametrize("orders", [(1, 1), (1, 2)])
def test_resampling_against_plain_counting(spark, orders):
    docs, target = corpus(), ["the1 river2 Stone3", None, "", "unknown words", "él0 " * 30]
    df = spark.createDataFrame([(i, t, *[None] * 12) for i, t in docs], f"doc_id long, text string, {CLASH}").repartition(7)
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resample(df, bench, orders=orders).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    want, best = by_force(docs, target, orders)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((r[:4] for r in got), key=key) == sorted((r[:4] for r in want), key=key)
    ranked = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, len(best) + 1))
    assert [r[:4] for r in ranked] == [r[:4] for r in best]


def test_carried_columns_keep_their_names(spark):
    df = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, row int, id string")
    out = resample(df, df.limit(0), carry=("row", "id"), least_words=1, percent=100).collect()
    assert [(r.doc_id, r.row, r.id, r["rank"]) for r in out] == [(1, 3, "x", 1)]


def test_nothing_to_draw_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert resample(none, none).count() == 0
    assert [r["rank"] for r in resample(some, none).collect()] == [None, None]


def test_one_id_and_text_on_a_third_of_all_rows(spark):
    """Ties beyond the id are numbered too, and the draw takes its share of them."""
    scored = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "30L AS n_words", "CASE WHEN id % 3 = 0 THEN 5000L ELSE -id END AS score")
    ranks = sorted(r["rank"] for r in draw(scored).where("rank is not null").collect())
    assert ranks == list(range(1, 301))
    assert draw(scored, percent=40).where("rank is not null and score = 5000").count() == 1000
