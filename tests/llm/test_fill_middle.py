import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netsift.llm import fill_middle
from netsift.llm.fill_middle import Chunks, boundaries, fill_in_middle, restored


def by_force(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)], len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rnd = random.Random(3)
    out = [None, "", "\n", "a", "a\n", "\n\n\n", "é\nb", "x" * 200_000, "\n" * 5000, "<P", "<P>", "a<S>b", "<<M>", "<P<S", "P>a\n<"]
    out += ["".join(rnd.choice("ab<PSM>\n é中") for _ in range(rnd.randrange(300))) for _ in range(200)]
    out += ["".join(rnd.choice("abcdefgh\n é中𝄞") for _ in range(rnd.randrange(30_000))) for _ in range(20)]
    out += ["q" * k + "<P>" + "z" * 5000 for k in (65533, 65534, 65535, 65536)]
    return out + ["same\nlines\n" * 900] * 3


@pytest.mark.parametrize(("bits", "longest"), [(11, 1 << 16), (2, 64)])
def test_chunks_find_what_whole_texts_show(bits, longest, monkeypatch):
    monkeypatch.setattr(fill_middle, "BITS", bits)
    monkeypatch.setattr(fill_middle, "LONGEST", longest)
    some = texts()
    digests = [hashlib.sha256(f"7:{i}".encode()).hexdigest() for i in range(len(some))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some), pa.array([[int(d[8 * k : 8 * k + 8], 16) for k in range(4)] for d in digests])], names=["c", "t", "h"])
    got = [r for part in fill_middle._transform(100, 50)(iter([batch])) for r in zip(*[c.to_pylist() for c in part.columns], strict=True)]
    assert [(*r[1:5], r[5].decode()) for r in got] == [by_force(i, t) for i, t in enumerate(some)]


def test_shared_passages_share_their_chunks():
    rnd = random.Random(1)
    passage = bytes(rnd.randrange(97, 122) for _ in range(40_000))
    chunks = Chunks()
    for head in (b"", b"one ", b"another begin " * 50):
        data = head + passage
        (ends,) = chunks.cut(np.frombuffer(data, np.uint8), np.array([len(data)]))
        fill_middle.Text(data, ends, chunks)
    assert chunks.hits > 20 and sum(map(len, chunks.known)) < 1.5 * len(passage)


def test_boundaries_do_not_depend_on_blocks(monkeypatch):
    data = np.frombuffer(random.Random(2).randbytes(50_000), np.uint8)
    whole = boundaries(data, fill_middle._table())
    monkeypatch.setattr(fill_middle, "BYTES_AT_ONCE", 1000)
    assert boundaries(data, fill_middle._table()).tolist() == whole.tolist()


@pytest.mark.parametrize("rate", [100, 60])
def test_forms_and_round_trip(spark, rate):
    rows = [(i, t, 1, "c", None, 2, "h") for i, t in enumerate(texts())] + [(None, "no id\nat all", 1, "c", None, 2, "h"), (3, "twice\n", 1, "c", None, 2, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, carried string, output string, id int, h string").repartition(5)
    out = fill_in_middle(df, carry=("text",), rate=rate).withColumn("back", restored(F.col("output"), F.col("form")))
    for r in out.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_force(r.doc_id, r.text, rate=rate)
        assert r.back == (r.text or "")
    assert fill_in_middle(df.limit(0)).count() == 0
