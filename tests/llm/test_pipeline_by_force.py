"""The whole pipeline, and the registered queries, against plain Python on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netsift.llm import queries
from netsift.llm.decontamination import BUDGET, PASSAGE, Q, normalised

WORDS = ["the", "of", "river", "stone", "él", "über", "and", "was", "light", "seven", "houses", "quietly"] + [f"w{i}x" for i in range(400)]


def _corpus():
    rnd = random.Random(21)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    base, passage, item = text(90), text(50), text(24)
    rows = [(1, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, "123 --- 4"), (None, text(30)), (None, text(30)), (7, text(12)), (7, text(12)), (8, "short text"), (9, "short text")]
    for k in range(10, 16):
        w = base.split()
        w[rnd.randrange(len(w))] = f"new{k}"
        rows.append((k, " ".join(w)))
    rows += [(k, f"{text(25)}\n{passage}\n{text(20)}") for k in range(20, 25)]
    rows += [(30, f"{text(20)} {item} {text(20)}"), (31, f"{text(20)} {item.upper().replace(' ', '  ')}. {text(5)}"), (32, f"{text(9)} {item[:60]}q{item[61:]} {text(9)}"), (33, text(3000)), (34, "z" * 900)]
    rows += [(k, text(rnd.randrange(5, 80))) for k in range(40, 60)]
    return rows, [(1, item), (2, "tiny"), (3, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, bench = _corpus()
    made = [(i, t, ("xx", "yy")[k % 2] if k % 3 else None, "src", None if t is None else len(t), "own") for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def _near_duplicates(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))
    find = lambda i: i if top[i] == i else find(top[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    left = []
    for members in groups.values():
        named = [i for i in members if rows[i][0] is not None and sets[i]]
        left += [i for i in members if i not in named] + named[:0]
        if named:
            left.append(min(named, key=lambda i: rows[i][0]))
    return [rows[i] for i in sorted(left)]


def _without_repeats(rows, length=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, data):
        mark = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append((doc, bytes(b for b, m in zip(d, mark) if not m).decode("utf-8", "ignore")))
    return out


def _holds(text, items):
    points = np.array(list(normalised(text)))
    for _, raw in items:
        item = normalised(raw)
        if len(item) < Q:
            continue
        size = min(PASSAGE, len(item))
        most = max(0, min(int(BUDGET * size), size // Q - 1))
        for s in range(len(item) - size + 1):
            row, step = np.zeros(len(points) + 1, np.int64), np.arange(len(points) + 1)
            for c in item[s : s + size]:
                new = row + 1
                new[1:] = np.minimum(new[1:], row[:-1] + (points != c))
                row = np.minimum.accumulate(new - step) + step
            if row.min() <= most:
                return True
    return False


def test_run_against_plain_python(spark, folder):
    rows, bench = _corpus()
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    rows = _without_repeats(_near_duplicates(rows))
    clean = [(i, t) for i, t in rows if not _holds(t, bench)]
    gone = {i for i, _ in rows} - {i for i, _ in clean}
    assert gone == {30, 31, 32}
    model, pieces, bins = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter(), defaultdict(list)
    for doc, t in clean:
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            pieces[doc, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 2048


def test_stages_keep_the_columns_and_extra_ones(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert {r.row for r in docs.collect()} == {"own"}


def test_registered_queries(spark, folder):
    """Each opN_ query of documents runs as registered on the small tables, with one row or more for every document."""
    rows, bench = _corpus()
    many = {n: queries.QUERIES[n](spark, folder).collect() for n in queries.QUERIES if n.split("_")[0] in ("op1", "op2", "op3", "op4", "op7", "op8", "op10")}
    for name, got in many.items():
        if not name.startswith(("op3", "op10")):
            assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows), name
    by = {n.split("_")[0]: {r.doc_id: r for r in got if r.doc_id not in (None, 7)} for n, got in many.items()}
    kept = dict(_without_repeats([(k, t) for k, (_, t) in enumerate(rows)]))
    for k, (i, t) in enumerate(rows):
        if i not in (None, 7):
            assert by["op1"][i].n_bytes == by["op7"][i].n_bytes == len((t or "").encode())
            assert by["op7"][i].kept_sha256 == hashlib.sha256(kept[k].encode()).hexdigest()
            assert (by["op8"][i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
            assert by["op8"][i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert {(r.doc_id, r.item_id) for r in many["op3_benchmark_decontamination"]} == {(i, 1) for i in (30, 31, 32)}
    assert {i: by["op2"][i].component_id for i in (1, 2, 3, 8, 9, 10)} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 1}


def test_registered_queries_of_other_tables(spark):
    """op5, op6 and op9 as registered, over their whole tables, against plain Python."""
    import base64

    sf = "/root/testdata/sf0.001"
    said = "<|im_end|><|im_start|>assistant ok"
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        talks[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    talks[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in queries.op5_chat_formatting(spark, sf).collect()}
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        turns.sort()
        learned = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(turns), len(learned))
        assert (got[conv].turns_sha256, got[conv].loss_sha256) == (hashlib.sha256(whole.encode()).hexdigest(), hashlib.sha256(learned.encode()).hexdigest())
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    bits, ids = np.array([r.embedding for r in rows]) > 0, [r.vec_id for r in rows]
    found = defaultdict(list)
    for r in queries.op6_exact_topk_search(spark, sf).collect():
        found[r.query_id].append((r.rank, r.distance, r.vec_id))
    assert set(found) == {i for i in ids if i % 20 == 0}
    for k, i in enumerate(ids):
        if i % 20 == 0:
            near = sorted((int(d), j) for d, j in zip((bits != bits[k]).sum(axis=1), ids))[:10]
            assert sorted(found[i]) == [(n, *x) for n, x in enumerate(near, 1)]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    last = {}
    for r in pages:
        last[r.html or ""] = max(last.get(r.html or "", r.page_id), r.page_id)
    got = {r.page_id: r for r in queries.op9_warc(spark, sf).collect()}
    assert len(got) == len(pages)
    for r in pages:
        data, response = (r.html or "").encode(), last[r.html or ""] == r.page_id
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else last[r.html or ""])
        mine = got[r.page_id]
        assert (mine.payload_bytes, mine.payload_digest, mine.record_type, mine.refers_to) == want
