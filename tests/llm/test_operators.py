import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from netsift.llm import chat_format, decontamination, hamming_search, language_id, licenses, warc
from netsift.llm.common import shared_folder
from netsift.llm.hamming_search import nearest
from netsift.llm.jaccard_join import near_duplicate_components
from netsift.llm.packing import pack_documents
from netsift.llm.suffix_dedup import remove_repeats
from netsift.llm.token_counts import count_tokens

#: Names that operators use inside; as extra columns they must not disturb.
CLASH = "row long, carried string, class string, part int, token string, kept string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def corpus(seed=1):
    """Copies, near copies, shared passages, one very long text, nulls and blanks, ties and repeated rows."""
    rnd = random.Random(seed)
    words = ["the", "of", "river", "stone", "él", "über", "and", "was", "light", "seven"] + [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = text(80), text(60)
    out = [None, "", "  \n", "a", "One two", "123 456 --", base, base, base.upper()]
    for k in range(12):
        w = base.split()
        for _ in range(k % 5):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    out += [f"{text(20)}\n{passage}\n{text(20 + k)}" for k in range(6)] + [text(9000), "ab " * 500, "z" * 700, "<|im_end|> <s> \0 end  "] + [text(rnd.randrange(1, 60)) for _ in range(25)]
    return out


def frame(spark, texts, first=0):
    rows = [(first + i, t, ("en", "fr")[i % 2], None, None if t is None else len(t), 7, "c", None, 1, "t", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts(docs, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for r in count_tokens(docs, PIECE, carry=("doc_id", "text"), limit=50).collect():
        n = len(model.encode(r.text or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 50), r.text
    assert count_tokens(nothing, PIECE).count() == 0


def components_by_force(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    top = list(range(len(sets)))
    for _ in sets:
        for a, b in combinations(range(len(sets)), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                top[a] = top[b] = min(top[a], top[b])
    return {i: (len(s), top[i]) for i, s in enumerate(sets)}


def test_jaccard_components(docs, nothing):
    want = components_by_force(corpus())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_components(docs).collect()} == want
    assert near_duplicate_components(nothing).count() == 0


def test_jaccard_many_random_edits(spark):
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for k in range(120):
        w = list(base)
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randrange(2)] = [f"n{rnd.randrange(30)}"]
        texts.append(" ".join(w))
    got = near_duplicate_components(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_force(texts)


def repeats_by_force(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = {}
    for k, d in enumerate(data):
        mark = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(d, mark) if not m)
        out[k] = (len(d), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length,gram", [(200, 64), (40, 12)])
def test_repeated_strings(docs, nothing, length, gram):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, length=length, gram=gram).collect()}
    assert got == repeats_by_force(corpus(), length)
    assert remove_repeats(nothing).count() == 0


def test_long_texts_in_segments(spark, monkeypatch):
    rnd = random.Random(8)
    shared = "".join(rnd.choice("abcdef ") for _ in range(500))
    text = "".join(rnd.choice("abcdef ") for _ in range(900_000))
    texts = [text[:399_900] + shared + text[399_900:], "x" + shared + "y"]
    got = {r.doc_id: r.n_removed for r in remove_repeats(frame(spark, texts)).collect()}
    assert got == {0: 500, 1: 500}


def test_decontamination(spark, nothing):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    items = [" ".join(word() for _ in range(30)) for _ in range(3)] + [None, "short"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    edited = items[1].replace("a", "z", 3)
    texts = [None, "", f"intro {items[0].upper()}, end.", f"x {edited} y", " ".join(word() for _ in range(400)), items[2][:70], "short"]
    found = {(r.doc_id, r.item_id): r.edits for r in decontamination.benchmark_matches(frame(spark, texts), bench).collect()}
    assert set(found) == {(2, 0), (3, 1)} and found[2, 0] == 0
    assert {r.doc_id for r in decontamination.clean_documents(frame(spark, texts), bench).collect()} == {0, 1, 4, 5, 6}
    assert decontamination.benchmark_matches(nothing, bench).count() == 0
    assert decontamination.benchmark_matches(frame(spark, texts), bench.limit(0)).count() == 0


def test_excerpts_at_any_offset():
    rnd = random.Random(7)
    item = "".join(rnd.choice("abcdefghij ") for _ in range(400)).split()
    item = " ".join(item)[:279].strip()
    passages = decontamination.Passages([(5, item), (6, "other words " * 3)])

    def by_force(text):
        best, points = 99, np.array(list(text))
        for s in range(len(item) - 99):
            row = np.zeros(len(text) + 1, np.int64)
            step = np.arange(len(text) + 1)
            for c in item[s : s + 100]:
                new = row + 1
                new[1:] = np.minimum(new[1:], row[:-1] + (points != c))
                row = np.minimum.accumulate(new - step) + step
            best = min(best, int(row.min()))
        return best

    for k in range(18):
        size, cut = (100, 110, 125, 150)[k % 4], rnd.randrange(len(item) - 150)
        s = list(item[cut : cut + size])
        for _ in range((0, 0, 4, 8, 11, 16)[k // 3]):
            s[rnd.randrange(len(s))] = rnd.choice(["q", "", "qr"])
        text = decontamination.normalised("xyz " * rnd.randrange(9) + "".join(s) + " uvw" * rnd.randrange(9))
        least, got = by_force(text), passages.matches(text)
        assert (set(got), [m[2] for m in got.values()]) == (({5}, [least]) if least <= 8 else (set(), [])), (k, cut)


def test_alignment_against_full_table():
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcde ") for _ in range(60))
    for _ in range(150):
        s = list(passage)
        for _ in range(rnd.randrange(9)):
            at = rnd.randrange(len(s))
            s[at : at + rnd.randrange(2)] = rnd.choice(["q", "", "qr"])
        text = "xyz" * rnd.randrange(9) + "".join(s) + "uvw" * rnd.randrange(9)
        row = [0] * (len(text) + 1)
        for c in passage:
            new = [row[0] + 1]
            for j, d in enumerate(text):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        edits, _ = decontamination.aligned(passage, text, -10, len(text), 12)
        assert edits == (min(row) if min(row) <= 12 else None)


def test_licenses(spark, nothing):
    mit = dict(licenses.LICENSES)["MIT"]
    texts = [None, "", mit, "Copyright (c) 2019 Some One\n\n" + mit.replace("license", "licence").upper(), f"{mit} and more", "released under the «MIT» Licence"]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert got == {0: None, 1: None, 2: "MIT", 3: "MIT", 4: None, 5: "MIT-notice"}
    assert licenses.scan_licenses(nothing).count() == 0


def test_licenses_of_a_given_table(spark):
    full = "Example License\n\nYou may do as you like.\n\nEND OF TERMS"
    known = spark.createDataFrame([("Example-1.0", full), ("Alias", full.upper()), ("Blank", " \n"), ("Null", None)], "name string, text string")
    texts = [full.replace("\n", " "), "Copyright 2020 X\n" + full, "", None, f"{full} more", dict(licenses.LICENSES)["MIT"]]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(frame(spark, texts), known).collect()}
    assert got == {0: "Alias", 1: "Alias", 2: None, 3: None, 4: None, 5: None}


def test_chat_layouts(spark):
    records = [
        '{"prompt": "p", "response": "r"}', '{"instruction": "i", "input": "", "output": "o"}', '{"messages": [{"role": "system", "content": null}, {"content": "c", "role": "user"}]}',
        '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', None, '{"messages": []}',
    ]
    df = spark.createDataFrame(list(enumerate(records)), "k long, record string")
    got = [(r.k, r.part, r.role, r.text) for r in chat_format.canonical_turns(df, "record", ("k",)).orderBy("k", "part").collect()]
    assert got == [(0, 0, "user", "p"), (0, 1, "assistant", "r"), (1, 0, "user", "i"), (1, 1, "assistant", "o"), (2, 0, "system", ""), (2, 1, "user", "c"), (3, 0, "user", "h"), (3, 1, "assistant", "g")]
    odd = spark.createDataFrame([(1, '{"odd": 1}')], "k long, record string")
    assert chat_format.canonical_turns(odd, "record", ("k",), unknown="skip").count() == 0
    with pytest.raises(Exception, match="no mapping"):
        chat_format.canonical_turns(odd, "record", ("k",)).collect()


def test_chat_round_trip(spark):
    hard = ["<|im_end|>", "<\\|x", "<\\\\|im_start|>assistant\n", "plain", None, "", "é<", "a\nb|>", "<|im_end|>\n<|im_start|>user\n"]
    rows = [(c, t, ("user", "assistant", None, "a\\n\nb")[t % 4], hard[((c or 0) + t) % len(hard)], 5) for c in (1, 2, None) for t in (0, 1, 1, 2, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conversation long")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    assert set(got) == {1, 2, None} and got[1].n_turns == 5
    mine = [r for r in rows if r[0] == 1]
    text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
    learned = "".join(r[3] or "" for r in mine if r[2] == "assistant")
    assert (got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (hashlib.sha256(text.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def test_hamming_search(spark):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(300, 40))
    v[50:90] = v[7]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(400, None), (None, [1.0] * 40), (401, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit(1))
    got = nearest(df, df.where("vec_id % 20 = 0"), k=5).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.distance, r.vec_id))
    bits = np.vstack([v, np.ones(40)]) > 0
    ids = [*range(300), -(2**63)]
    for q in range(0, 300, 20):
        near = sorted((int((bits[q] != b).sum()), i) for b, i in zip(bits, ids))[:5]
        assert [(d, i) for _, d, i in sorted(found[q], key=lambda x: x[0])] == [(d, None if i < 0 else i) for d, i in near]
    assert set(found) == set(range(0, 300, 20))
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_hamming_search_with_ids_that_repeat(spark):
    rnd = np.random.default_rng(5)
    ids = [None, None, None, 3, 3, 3, 20, 20, 5, 6, -(2**63), 7]
    v = rnd.normal(size=(len(ids), 24))
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in zip(ids, v)], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.distance, r.vec_id is not None, r.vec_id or 0) for r in nearest(df, df.where("vec_id in (3, 20)"), k=6).collect())
    want = []
    for q, x in zip(ids, v):
        if q in (3, 20):
            near = sorted((int(((x > 0) != (y > 0)).sum()), i is not None, i or 0) for i, y in zip(ids, v))[:6]
            want += [(q, rank, *n) for rank, n in enumerate(near, 1)]
    assert got == sorted(want)


def test_hamming_search_of_several_lengths(spark):
    rnd = np.random.default_rng(6)
    sizes = [24] * 30 + [25] * 3 + [8] * 4 + [65]
    rows = [(i, [float(x) for x in rnd.normal(size=n)]) for i, n in enumerate(sizes)] + [(50, []), (60, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in nearest(df, df, k=5).select("query_id", "rank", "distance", "vec_id").collect())
    want = []
    for i, n in enumerate(sizes):
        near = sorted((sum((x > 0) != (y > 0) for x, y in zip(rows[i][1], rows[j][1])), j) for j, m in enumerate(sizes) if m == n)[:5]
        want += [(i, rank, *d) for rank, d in enumerate(near, 1)]
    assert got == want


def test_language_id(spark, docs, nothing):
    rnd = random.Random(1)
    say = {"xx": "abcde", "yy": "vwxyz"}
    rows = [(i, " ".join("".join(rnd.choice(say[k]) for _ in range(5)) for _ in range(20)), k) for i in range(200) for k in [rnd.choice(["xx", "yy"])]]
    df = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 34!", "yy"), (902, "abcd", None)], "doc_id long, text string, lang string").withColumn("carried", F.lit(1))
    got = {r.doc_id: r for r in language_id.identify_languages(df).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "xx"
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert language_id.identify_languages(nothing).count() == 0


def test_warc(spark):
    rnd = random.Random(6)
    big = "".join(rnd.choice("<p>é \r\n") for _ in range(90_000))
    html = ["a", "a", None, "", "WARC/1.1\r\n\r\n", big, big, "0\r\n\r\n", "u"]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\n" if i else None, h, 1) for i, h in enumerate(html)] + [(None, "n", "only", 1)], "page_id long, url string, html string, origin long")
    folder = f"{shared_folder(spark)}/warc-test"
    warc.write_archives(pages, folder, segment=4096, per_file=5)
    got = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert len(got) == 10
    for i, h in enumerate(html):
        data = (h or "").encode()
        best = max(k for k, x in enumerate(html) if (x or "") == (h or ""))
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if best == i else "revisit", None if best == i else best)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    empty = f"{shared_folder(spark)}/warc-empty"
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORD)
    rows = pack_documents(docs, WORD, length=64, open_bins=4).collect()
    texts = dict(enumerate(corpus()))
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in texts.items():
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert sorted(pieces[i]) == [(k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    for placed in bins.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 64
    assert pack_documents(nothing, WORD).count() == 0


def test_hamming_search_in_split_parts(spark):
    """A segment value that most codes share, parts of a few codes, and a query that is far from all others."""
    rnd = np.random.default_rng(9)
    v = rnd.normal(size=(400, 48))
    v[:300, :20] = 1.0
    v[380:, :] = -1.0
    v[380:, :6] = rnd.normal(size=(20, 6))
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 20 = 0").unionByName(spark.createDataFrame([(1000, [-1.0, 1.0] * 24)], df.schema))
    got = sorted((r.query_id, r.rank, r.distance, r.vec_id) for r in nearest(df, asked, k=7, per_part=16).collect())
    want = []
    for i, x in [(r.vec_id, r.embedding) for r in asked.collect()]:
        near = sorted((int(((np.array(x) > 0) != (y > 0)).sum()), j) for j, y in enumerate(v))[:7]
        want += [(i, rank, *n) for rank, n in enumerate(near, 1)]
    assert got == sorted(want)


def test_hamming_search_hands_on_asked_parts_only(spark):
    """One query at radius 0 meets one part of each segment, at radius 1 those of its neighbours; all codes stay reachable."""
    rnd = np.random.default_rng(10)
    codes = [(24).to_bytes(4, "big") + rnd.integers(0, 256, 3, np.uint8).tobytes() for _ in range(3000)]
    classes = spark.createDataFrame([(24, i, c) for i, c in enumerate(sorted(set(codes)))], "bits int, first long, code binary")
    layout = hamming_search.Layout.of(24, 3000, 100)
    index, salts = hamming_search.index_parts(classes, {24: layout}, 100)
    asks = spark.createDataFrame([(24, codes[0])], "bits int, ask binary")
    own = [int.from_bytes(codes[0][4:], "big") >> (24 - b) & (1 << (b - a)) - 1 for a, b in zip(layout.edges, layout.edges[1:])]
    for radius in range(layout.upper + 1):
        near = {(j, u) for j, (a, b) in enumerate(zip(layout.edges, layout.edges[1:])) for u in range(1 << layout.upper) if ((own[j] >> (b - a - layout.upper)) ^ u).bit_count() <= radius}
        got = hamming_search.asked_parts(index, salts, asks, {24: layout}, radius, 0).groupBy("segment", "upper").count().collect()
        told = hamming_search.asked_parts(index, salts, asks, {24: layout}, radius, 1000).groupBy("segment", "upper").count().collect()
        assert sorted(map(tuple, told)) == sorted(map(tuple, got))
        assert {(r.segment, r.upper) for r in got} <= near
        read, whole = sum(r["count"] for r in got), index.count()
        assert read == index.where(F.concat_ws(",", "segment", "upper").isin([f"{j},{u}" for j, u in near])).count()
        assert read < whole / 8 if radius == 0 else read <= whole
    assert layout.upper > 3 and read == whole


def _foreign(kind, block, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    sha = lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode()
    records = [
        _foreign("warcinfo", b"software: x\r\n", WARC_Record_ID="<i>"), _foreign("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<q>"), _foreign("response", http + b"plain", WARC_Record_ID="<a>"),
        _foreign("response", http + b"other", WARC_Record_ID="<b>", WARC_Payload_Digest="md5:abc"), _foreign("response", http + b"lower", WARC_Record_ID="<c>", WARC_Payload_Digest="sha1:" + sha(b"lower").lower()),
        _foreign("revisit", http, WARC_Record_ID="<d>"), _foreign("revisit", b"", WARC_Record_ID="<e>", WARC_Payload_Digest="sha1:XYZ"), _foreign("response", b"dns answer", WARC_Record_ID="<f>", Content_Type="text/dns"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = sorted((str(r.payload_bytes), str(r.payload_digest), r.record_type, r.page_id, r.refers_to) for r in warc.read_archives(spark, str(tmp_path)).collect())
    want = [("5", sha(b), "response", None, None) for b in (b"plain", b"other", b"lower")] + [("10", sha(b"dns answer"), "response", None, None), ("None", "None", "revisit", None, None), ("None", "XYZ", "revisit", None, None)]
    assert got == sorted(want)
    for name, bad in (("digest", _foreign("response", http + b"x", WARC_Record_ID="<x>", WARC_Payload_Digest="sha1:" + sha(b"y"))), ("length", b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <y>\r\n\r\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "b.warc.gz").write_bytes(gzip.compress(bad))
        with pytest.raises(Exception, match="not whole|Content-Length"):
            warc.read_archives(spark, str(tmp_path / name)).collect()


def test_archives_say_what_the_standard_asks(spark):
    pages = spark.createDataFrame([(1, "http://x/1", "same"), (2, "http://x/2", "same"), (2, "http://x/2", "same")], "page_id long, url string, html string")
    folder = f"{shared_folder(spark)}/warc-standard"
    warc.write_archives(pages.coalesce(1), folder)
    (data,) = (r.content for r in spark.read.format("binaryFile").load(folder).select("content").collect() if r.content)
    records = [f for f, _ in warc.archive_records(bytes(data))]
    assert records[0]["warc-type"] == "warcinfo" and len({f["warc-record-id"] for f in records}) == len(records)
    (revisit,) = (f for f in records if f["warc-type"] == "revisit")
    assert revisit["warc-refers-to-target-uri"] == "http://x/2" and revisit["warc-refers-to-date"] == revisit["warc-date"]
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect()) == [(1, "revisit", 2), (2, "response", None), (2, "response", None)]


def test_packing_by_another_tokenizers_rules(spark, tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(WORD)
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Whitespace(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    other.save(str(tmp_path / "other.json"))
    texts = ["abc123 don't x--y", "12 345", None, ""]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in pack_documents(frame(spark, texts), str(tmp_path / "other.json")).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*other.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_packing_of_repeated_ids_and_few_long_texts(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e"), (None, "f"), (None, "f")] + [(k, "word " * 20_000) for k in range(2, 6)]
    rows = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORD, per_task=5).collect()
    assert sum(r.doc_id == 1 for r in rows) == 3 and sum(r.doc_id is None for r in rows) == 2
    assert len({r.sequence_id >> 40 for r in rows}) > 2
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_packing_fills_sequences(spark):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, "a " * rnd.randrange(1, 1200)) for i in range(6000)], "doc_id long, text string")
    rows = pack_documents(docs, WORD).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in sorted(b)[:k]) == sorted(b)[k][0] for b in bins.values() for k in range(len(b)))
    assert sum(r.length for r in rows) / (2048 * len(bins)) > 0.96


@pytest.mark.parametrize("hot_in_flush,hot_in_part", [(3, 20_000), (500, 2), (1, 1)])
def test_repeated_strings_around_hot_triggers(spark, monkeypatch, hot_in_flush, hot_in_part):
    """A line shorter than the strings, in ever different company, and some whole copies of that."""
    from netsift.llm import suffix_dedup

    rnd = random.Random(14)
    line = "this line stands in very many texts and is the reason for it "
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    around = [text(60) + line + text(60) for _ in range(40)]
    texts = around + [text(30) + around[3] + text(30), around[5][10:] + text(50), around[5], text(20) + around[7][:-9]]
    data = [t.encode() for t in texts]
    for length, gram in ((100, 30),):
        blocks = []
        with monkeypatch.context() as m:
            m.setattr(suffix_dedup, "HOT_IN_FLUSH", hot_in_flush)
            m.setattr(suffix_dedup, "HOT_IN_PART", hot_in_part)
            import pyarrow as pa

            parts = 3
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["row", "text"])
            halves = [batch.slice(0, 20), batch.slice(20)]

            def grouped(batches):
                out = {}
                for b in batches:
                    for part, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        out.setdefault(part, []).append(payload)
                return [((pa.scalar(k),), pa.table({"part": [k] * len(v), "payload": pa.array(v, pa.binary())})) for k, v in out.items()]

            blocks = [b for half in halves for b in suffix_dedup._parse_blocks(length, gram, parts)(iter([half]))]
            places = pa.concat_tables([suffix_dedup._sorted_places(parts)(k, t) for k, t in grouped(blocks)]).to_pylist()
            assert any(p["kind"] == suffix_dedup.HOT for p in places)
            mark = [bytearray(len(d)) for d in data]
            opened = {}
            for p in places:
                if p["kind"] == suffix_dedup.REPEATED:
                    mark[p["row"]][p["lo"] : p["lo"] + p["n"] + length - 1] = b"\1" * (p["n"] + length - 1)
                else:
                    opened.setdefault(p["row"], []).append(p)
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("n", pa.int32()), ("kind", pa.int32()), ("trigger", pa.int64())]))
            rows = [(r, texts[r], [{k: p[k] for k in ("lo", "n", "kind", "trigger")} for p in ps]) for r, ps in opened.items()]
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], kind)], names=["row", "text", "phrases"])
            equal = [suffix_dedup._equal_suffixes(parts, 2, length)(k, t) for k, t in grouped(suffix_dedup._dictionary_blocks(length, parts)(iter([batch])))]
            for table in equal:
                for r in suffix_dedup._suffix_spans(length)(table).to_pylist() if table.num_rows else ():
                    mark[r["row"]][r["lo"] : r["hi"]] = b"\1" * (r["hi"] - r["lo"])
        want = repeats_by_force(texts, length)
        assert [(len(d), sum(m)) for d, m in zip(data, mark)] == [want[i][:2] for i in range(len(texts))]


def test_repeats_of_repeated_rows_and_ids(spark):
    text = "".join(random.Random(4).choice("abcdef ") for _ in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text[50:]), (2, text[:199]), (2, None), (2, "other")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(docs).collect())
    assert got == [(0, 250, 250, 1), (1, 300, 300, 1), (1, 300, 300, 1), (2, 0, 0, 0), (2, 5, 0, 0), (2, 199, 0, 0)]


def test_suffix_order():
    from netsift.llm.suffix_dedup import suffix_order

    rng = np.random.default_rng(1)
    for length in (200, 40, 13, 8, 5):
        for letters in (2, 26):
            data = rng.integers(97, 97 + letters, 1200).astype(np.uint8)
            data[500:800], data[900:1100] = data[:300], 97
            got, new = suffix_order(data, np.arange(len(data) - length + 1), length)
            strings = [data.tobytes()[i : i + length] for i in got]
            assert strings == sorted(strings) and all((a != b) == n for a, b, n in zip(strings, strings[1:], new[1:]))


@pytest.mark.parametrize("hot", [2, 5, 10**6])
def test_shared_tokens_with_hot_ones(monkeypatch, hot):
    """Each class gets the tokens that another one has, each with the same number under all of them."""
    import pyarrow as pa

    from netsift.llm import jaccard_join, repeats
    from netsift.llm.common import mix, unpack

    monkeypatch.setattr(repeats, "HOT_IN_FLUSH", hot)
    rng, parts = np.random.default_rng(3), 3
    sets = {int(k): np.unique(np.concatenate((mix(np.arange(rng.integers(1, 12), dtype=np.uint64)), mix(rng.integers(0, 400, 30).astype(np.uint64))))) for k in rng.integers(1, 2**62, 40)}
    blocks = []
    for task in (list(sets)[:25], list(sets)[15:]):
        made = repeats.Blocks(parts)
        for k, name in enumerate(task):
            made.add(name, len(sets[name]), sets[name])
            made.note(np.array([k]), np.array([0], np.uint8), np.array([len(sets[name])]), np.array([name]))
            if k % 9 == 8:
                blocks += made.flush()
        blocks += made.flush()
    by = {}
    for b in blocks:
        for part, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(part, []).append(payload)
    back, told = {}, []
    for part, payloads in by.items():
        out = repeats.shared_tokens(parts, 2)((pa.scalar(part),), pa.table({"part": pa.array([part] * len(payloads), pa.int32()), "payload": pa.array(payloads, pa.binary())}))
        for to, payload in zip(out.column("part").to_pylist(), out.column("payload").to_pylist()):
            if to >= 2:
                told.append(len(unpack(payload)[0]))
            else:
                back.setdefault(to, []).append(payload)
    assert sum(told) == 25 + 25
    got, numbers = {}, {}
    for payloads in back.values():
        for payload in payloads:
            names, _, counts, token, df = unpack(payload)
            for name, t, d in zip(np.repeat(names, counts).tolist(), token.tolist(), df.tolist()):
                got.setdefault(name, set()).add(t)
                assert numbers.setdefault(t, d) == d
    # tokens come back with their part in the upper bits, and are still told apart
    all_of = np.unique(np.concatenate(list(sets.values())))
    named = dict(zip(all_of.tolist(), repeats._whole(*repeats._short(all_of), repeats.part_of(all_of, parts), parts).tolist()))
    assert len(set(named.values())) == len(named)
    sets = {name: np.array([named[t] for t in s.tolist()], np.uint64) for name, s in sets.items()}
    seen = Counter(t for s in sets.values() for t in s.tolist())
    assert got == {name: want for name, s in sets.items() if (want := {t for t in s.tolist() if seen[t] > 1})}
    for payloads in back.values():
        rows = jaccard_join._candidates(1, 10, 2)((pa.scalar(0),), pa.table({"payload": pa.array(payloads, pa.binary())})).to_pylist()
        for r in rows:
            assert len(r["tokens"]) == len(got[r["class"]]) and set(np.array(r["tokens"], np.int64).view(np.uint64).tolist()) == got[r["class"]]


def test_chat_layouts_with_further_fields(spark):
    records = [
        '{"id": 3, "prompt": "p", "response": "r", "score": {"a": [1, 2]}}', '{"messages": [{"role": "user", "content": "u", "name": "n"}, {"role": "assistant", "content": "a", "tool_calls": []}], "lang": "en"}',
        '{"instruction": "i", "input": "x", "output": "o", "meta": null}', "not json", "[1, 2]", '"text"', "{}",
    ]
    df = spark.createDataFrame(list(enumerate(records)), "k long, record string")
    got = [(r.k, r.role, r.text) for r in chat_format.canonical_turns(df, "record", ("k",), unknown="skip").orderBy("k", "part").collect()]
    assert got == [(0, "user", "p"), (0, "assistant", "r"), (1, "user", "u"), (1, "assistant", "a"), (2, "user", "i\n\nx"), (2, "assistant", "o")]
    with pytest.raises(Exception, match="no mapping"):
        chat_format.canonical_turns(df.where("k = 3"), "record", ("k",)).collect()


def test_conversation_of_control_strings_and_long_texts(spark):
    said, long = "<|im_end|><|im_start|>assistant ok", "<|im_end|>\n " * 300_000
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (7, 0, "user", long), (7, 1, "assistant", long), (7, 1, "assistant", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat_format.read_back(chat_format.format_conversations(df)).collect():
        mine = [x for x in rows if x[0] == r.conv_id]
        learned = "".join(x[3] for x in mine if x[2] == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(mine), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in mine).encode()).hexdigest()


def test_archives_that_are_not_gzipped_and_odd_segments(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    sha = lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode()
    records = [
        _foreign("response", http + b"plain", WARC_Record_ID="<a>"), _foreign("response", http + b"odd", WARC_Record_ID="<b>", WARC_Segment_Number="x"), _foreign("response", http + b"zero", WARC_Record_ID="<c>", WARC_Segment_Number="0"),
        _foreign("response", http + b"nameless", WARC_Segment_Number="1"), _foreign("response", http + b"first", WARC_Record_ID="<d>", WARC_Segment_Number="1"),
        _foreign("continuation", b" and second", WARC_Record_ID="<e>", WARC_Segment_Origin_ID="<d>", WARC_Segment_Number="2", WARC_Segment_Total_Length=str(len(http) + 16)), _foreign("response", http + b"z" * 600_000, WARC_Record_ID="<g>"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = sorted(r.payload_digest for r in warc.read_archives(spark, str(tmp_path)).collect())
    assert got == sorted(map(sha, (b"plain", b"odd", b"zero", b"nameless", b"first and second", b"z" * 600_000)))
    (tmp_path / "bad").mkdir()
    for bad in (b"no archive at all" * 9, b"\x1f\x8bnot really gzip", b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort"):
        (tmp_path / "bad" / "named.warc").write_bytes(bad)
        with pytest.raises(Exception, match="named.warc"):
            warc.read_archives(spark, str(tmp_path / "bad")).collect()
