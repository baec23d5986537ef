import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from netsift.llm import personal_data as pd_
from netsift.llm.personal_data import KINDS, candidates, classifier, counted, digests, estimated, personal_data

# the base patterns as they are stated
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CLASH = "start int, stop string, m string, email string, ip int, votes string, spans string, x int, n long"


def passes_luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else None, "card": 16 <= len(d) <= 19 and passes_luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base_by_force(text):
    return [(kind, m.start(), m.end()) for kind in KINDS for m in re.finditer(STATED[kind], text or "") if good(kind, m[0])]


def card(prefix, size, rnd):
    d = prefix + "".join(rnd.choice("0123456789") for _ in range(size - len(prefix) - 1))
    return next(d + c for c in "0123456789" if passes_luhn(d + c))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, *[None] * 9) for i, t in enumerate(texts)], f"doc_id long, text string, {CLASH}").repartition(5)


def noise(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("aZ09..  @@+-_%()\n:é中𝄞1234567890") for _ in range(rnd.randrange(200))) for _ in range(n)]


def hand_made():
    rnd = random.Random(4)
    out = [None, "", " ", "a@b.c", "é a.b+c@d-e.f.g, x@y@z.com a@b.com_x@c.org", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0000003.4 1.2.3", "+1 (988) 555-2485 4524132264652876", "+12 +1234567 +12345678 +1----9 +1234567890123456"]
    out += [f"{card('4', 16, rnd)} {card('51', 16, rnd)[:-1]}0 {card('4', 19, rnd)}", "4111 1111 1111 1111-", "4111-1111-1111-1111 1", "a@b.co(at)c.org q@b(at)c.org x(at)y.com@z.org"]
    return out


def test_base_spans_are_those_of_the_stated_patterns(spark):
    texts = hand_made() + noise(1, 400)
    got = {r.doc_id: r.spans for r in personal_data(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.stop) for s in got[i] if s.base] == base_by_force(t), t


def test_digest_columns(spark):
    texts = hand_made()
    for r in digests(personal_data(frame(spark, texts))).collect():
        base = base_by_force(texts[r.doc_id])
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert set(written) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s.split(":")[0]), int(s.split(":")[1])))


def labelled(seed=2, n=300):
    """Texts with data written in other ways, and look-alikes; what is to be found in each."""
    rnd, out = random.Random(seed), []
    words = lambda: " ".join(rnd.choice(["the", "river", "stone", "was", "light"]) for _ in range(rnd.randrange(3, 9)))
    number = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    for i in range(n):
        amex = card("37", 15, rnd)
        bad = number(15)
        while passes_luhn(bad):
            bad = number(15)
        told, kind = rnd.choice([
            (f"{rnd.choice(['ana', 'bo.lee', 'kim7'])} [at] mail{i % 7} [dot] {rnd.choice(['com', 'org', 'de'])}", "email"), (f"my phone ({rnd.randrange(200, 990)}) {rnd.randrange(230, 990)}-{number(4)}", "phone"),
            (f"pay by card {amex[:4]} {amex[4:10]} {amex[10:]}", "card"), (f"from host 2001:db8:{i:x}::{rnd.randrange(1, 99)}", "ip"), (f"order {bad}", ""), (f"version {rnd.randrange(256, 999)}.{i}.3.{rnd.randrange(9)}", ""),
            (f"write to x{i}@mail.example.com", "base"), (f"call +1 (212) 555-{number(4)}", "base"), (f"server 10.2.{i % 256}.7", "base"), (f"visa {card('4', 16, rnd)}", "base"),
        ])
        out.append((f"{words()} {told} {words()}", kind))
    return out


def test_other_ways_to_write_are_found_and_look_alikes_left(spark):
    texts = labelled()
    got = {r.doc_id: [s.kind for s in r.spans if not s.base] for r in personal_data(frame(spark, [t for t, _ in texts])).collect()}
    wanted, right = [i for i, (_, k) in enumerate(texts) if k not in ("", "base")], 0
    for i in wanted:
        right += texts[i][1] in got[i]
    assert right >= 0.95 * len(wanted)
    wrong = [texts[i][0] for i, (_, k) in enumerate(texts) if k in ("", "base") and got[i]]
    assert len(wrong) <= 0.03 * len(texts), wrong[:5]


def test_clean_texts_have_no_span(spark):
    clean = ["At 12:30:45 we met 3 of 10 people", "In 1999, 2000 and 2001 - 1,234,567.89", "section 3.2.1 of chapter 4.5", "ratio 3:4:5, a::b, std::vector", "10 - 20 - 30 apples", "f(x) = x@y", "1234 5678 9012 3456 7890 1234"]
    texts = [t for t, _ in labelled()] + clean
    got = {r.doc_id: r.spans for r in personal_data(frame(spark, texts)).collect()}
    assert [texts[i] for i in range(len(texts) - len(clean), len(texts)) if got[i]] == []


def test_estimation_tells_good_labelers_from_bad():
    """Votes drawn from known reliabilities: the chances found are near those of the true model."""
    rnd, cells, truth = random.Random(6), {}, {}
    rates = [(0.1, 0.9), (0.2, 0.8), (0.5, 0.5), (0.3, 0.6), (0.1, 0.95)]
    for _ in range(20_000):
        true = rnd.random() < 0.5
        v = "".join("+" if rnd.random() < r[true] else "-" for r in rates)
        cells[False, v] = cells.get((False, v), 0) + 1
        truth.setdefault(v, []).append(true)
    chance = estimated(cells)
    for v, seen in truth.items():
        if len(seen) > 400:
            assert abs(chance[v] - sum(seen) / len(seen)) < 0.12, (v, chance[v])
    # the labeler that guesses does not matter
    assert abs(chance["++++ +".replace(" ", "")[:5]] - chance["++-++"]) < 0.1


def test_counts_and_model_do_not_depend_on_partitions(spark):
    texts = [t for t, _ in labelled(9, 120)]
    one, many = (counted(candidates(frame(spark, texts).repartition(n))) for n in (1, 7))
    assert one == many and classifier(one) == classifier(many)


def test_empty_table(spark):
    out = digests(personal_data(frame(spark, ["x"]).limit(0)))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] and out.count() == 0


@pytest.mark.parametrize("unit", ["a", "1", "1 ", "1.", "a.", "@a", "+1 ", "+", "1:", "a@b.c", "1.2.3.4 ", "(at)", ".(dot)", "+1" + " " * 50])
def test_long_runs_take_time_in_proportion(spark, unit):
    text = (unit * 400_000)[:400_000]
    began = time.time()
    (row,) = personal_data(frame(spark, [text])).select(F.filter("spans", lambda x: x["base"]).alias("spans")).collect()
    assert time.time() - began < 40
    if unit in ("a@b.c", "1.2.3.4 ", "+1 "):
        assert [(s.kind, s.start, s.stop) for s in row.spans] == base_by_force(text)


def test_no_python_in_the_plan(spark):
    plan = candidates(frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert pd_.LABELERS == tuple(pd_.votes("ip", F.struct(F.lit("").alias("m"), F.lit("").alias("before"), F.lit("").alias("after"))))
