import random
import time
import tracemalloc

import numpy as np
import pytest

from netsift.llm import decontamination as D


def _by_force(items, text):
    """Fewest edits of any passage of each item against any string of the text, and how many passages are in budget."""
    out, points = {}, np.array(list(text))
    for number, raw in items:
        item = D.normalised(raw)
        if len(item) < D.Q:
            continue
        size = min(D.PASSAGE, len(item))
        most = max(0, min(int(D.BUDGET * size), size // D.Q - 1))
        least, many = 99, 0
        for s in range(len(item) - size + 1):
            row, step = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
            for c in item[s : s + size]:
                new = row + 1
                new[1:] = np.minimum(new[1:], row[:-1] + (points != c))
                row = np.minimum.accumulate(new - step) + step
            least, many = min(least, int(row.min())), many + int(row.min() <= most)
        if many:
            out[number] = (least, many)
    return out


@pytest.mark.parametrize("window,segment,hits", [(200_000, 1_024, 400_000), (150, 7, 60), (400, 16, 5)])
def test_filter_bands_and_budgets_against_brute_force(monkeypatch, window, segment, hits):
    monkeypatch.setattr(D, "WINDOW", window)
    monkeypatch.setattr(D, "SEGMENT", segment)
    monkeypatch.setattr(D, "HITS", hits)
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 7)))
    items = [(1, " ".join(word() for _ in range(40))), (2, " ".join(word() for _ in range(12))), (3, "ab " * 45), (4, "too short"), (5, " ".join(word() for _ in range(30)))]
    passages = D.Passages(items)
    for k in range(10):
        own = D.normalised(items[rnd.choice([0, 1, 2, 4])][1])
        cut = rnd.randrange(max(1, len(own) - 100))
        s = list(own[cut : cut + rnd.choice([60, 100, 108, 130])])
        for _ in range(rnd.choice([0, 1, 3, 6, 9])):
            s[rnd.randrange(len(s))] = rnd.choice(["q", "", "xy"])
        text = D.normalised(" ".join(word() for _ in range(rnd.randrange(60))) + "".join(s) + " ".join(word() for _ in range(rnd.randrange(30))))
        assert {i: (m[2], m[3]) for i, m in passages.matches(text).items()} == _by_force(items, text), k
        assert bool(passages.matches(text, any_of_them=True)) == bool(passages.matches(text))


def test_where_a_match_begins():
    rnd = random.Random(3)
    item = "".join(rnd.choice("abcdefghij") for _ in range(100))
    passages = D.Passages([(1, item)])
    for edited, size in ((item, 100), (item[:40] + item[43:], 97), (item[:30] + "zz" + item[30:], 102), (item[:50] + "z" + item[51:], 100)):
        assert passages.matches("q" * 37 + edited + "q" * 20)[1][:2] == [37, 37 + size]


def test_memory_does_not_follow_repetition():
    passages = D.Passages([(1, "ab " * 60), (2, "ab " * 5_000)])
    text = D.normalised("ab " * 100_000)
    tracemalloc.start()
    assert set(passages.matches(text[:3_000])) == {1, 2} and passages.matches(text, any_of_them=True)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_rows_that_repeat_and_columns_that_clash(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from the very angry bear that woke up early today in the wood"
    bench = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    rows = [(1, f"a {item} b", "x", 1), (1, f"a {item} b", "x", 1), (2, None, None, None), (None, item, "y", 2), (3, "", "z", 3), (4, "clean " * 200_000, "w", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, start long")
    got = sorted((r.doc_id or -1, r.item_id) for r in D.benchmark_matches(docs, bench).collect())
    assert got == [(-1, -1), (-1, 1), (1, -1), (1, -1), (1, 1), (1, 1)]
    clean = D.clean_documents(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4]
    assert D.clean_documents(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("unit", ["ab ", "a ", "abc abd abc abe ", "the same sentence over and over again, with a comma "])
def test_time_follows_the_text_where_both_repeat(unit):
    item, text = D.normalised(unit * (12_000 // len(unit))), D.normalised(unit * (400_000 // len(unit)))
    began = time.process_time()
    got = D.Passages([(1, item)]).matches(text)
    assert time.process_time() - began < 12  # 3 s where nothing else runs; hours if each repeat met each
    start, stop, edits, passages = got[1]
    assert (start, edits, passages) == (0, 0, len(item) - D.PASSAGE + 1) and len(text) - 20 < stop <= len(text)


def test_repeated_passages_count_as_often_as_they_stand():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 7)))
    one, two = (" ".join(word() for _ in range(60)) for _ in range(2))
    items = [(1, f"{one} {two} {one}"), (2, "xy " * 150 + two + " xy" * 120), (3, f"{two} {two}")]
    for text in (one, two, D.normalised(f"zz {one[:150]} q {two[20:190]}"), D.normalised("xy " * 90), D.normalised("xy " * 60 + two[:70])):
        got = {i: (m[2], m[3]) for i, m in D.Passages(items).matches(text).items()}
        assert got == _by_force(items, text)
