"""Personal data in whole texts: exact base spans, and further spans found by weak supervision.

Native throughout: candidates, votes, counts, the decision and the digests are Spark SQL functions; the driver fits the model on a
table of counts whose size follows from the labelers (KINDS, 3 to the number of labelers, and the values of features), not from the data.

Method: for each kind one pattern finds candidates, among them the base spans (a fixed pattern and a check: octets, Luhn, digits).
Labelers vote for or against each candidate or abstain: a regular expression on its layout, a check, a gazetteer (top-level domains,
issuers, dialling codes, address ranges), the words before it, and the characters beside it. Expectation-maximisation estimates how
often each labeler votes how on true and on false candidates; base spans are known to be true. Its probabilities train
the final classifier, naive Bayes on votes, layout and neighbours, which decides on all candidates that are no base spans.

The base patterns are as stated for leftmost, non-overlapping matches, written so that no text makes them go back over what they have read:
a run of characters is taken whole, and a match begins at the begin of its run or where the match before ended. What else is a
candidate can neither hide nor overlap a base span of its kind: it stands beside it in one pattern, and guards keep it off.

Null and empty texts have no span. Repeated rows each get their row. Other columns are ignored, whatever their names. Positions come from the
lengths of what stands between matches, added up in blocks of the square root of their number, so a text with many matches takes no square of them. An
empty table gives an empty result. Ties need no rule; an even chance (0.5) counts as personal data.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import checkpointed

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("layout", "check", "gazetteer", "context", "edges")
#: Characters before and after a candidate that labelers see.
BEFORE, AFTER = 32, 2
#: Pseudo-counts with which reliabilities start, rounds of estimation, and the share of true ones expected among candidates beyond the base.
PRIOR_WEIGHT, ROUNDS, PRIOR_SHARE = 20.0, 60, 0.4

_LOCAL, _LABEL, _HEX = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]", "[0-9A-Fa-f]{1,4}"
_AT, _DOT = r"[\[({]at[\])}]", r"(?:\.|[\[({]dot[\])}])"
_BASE_IP, _BASE_CARD, _BASE_PHONE = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9](?:[ -]?[0-9])++", r"\+[0-9][ ().0-9-]+[0-9]"
_NOT_BESIDE = "[0-9A-Fa-f:.]"
#: Candidates by kind: the base pattern, and other ways to write the same.
CANDIDATES = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++(?:@{_LABEL}++(?:\.{_LABEL}++)++| ?{_AT} ?{_LABEL}++(?: ?{_DOT} ?{_LABEL}++)++(?!{_LOCAL}*+@))",
    "ip": rf"{_BASE_IP}|(?<!{_NOT_BESIDE})(?=[0-9A-Fa-f]{{1,4}}:)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?!{_NOT_BESIDE})",
    "card": rf"(?<![0-9])(?<![0-9][ -])[0-9]{{4}}(?:\.[0-9]{{4}}){{3}}(?![ -]?[0-9])|{_BASE_CARD}",
    "phone": rf"{_BASE_PHONE}|(?<![0-9+().-])(?<![0-9] )(?:\([2-9][0-9]{{2}}\) ?|[2-9][0-9]{{2}}[ .-])[2-9][0-9]{{2}}[ .-][0-9]{{4}}(?![0-9])(?![ .-][0-9])",
}
# fixed values: gazetteers
DOMAINS = ("com", "org", "net", "edu", "gov", "int", "mil", "info", "biz", "io", "dev", "app", "co", "de", "fr", "es", "it", "uk", "nl", "be", "at", "ch", "se", "no", "dk", "fi", "pl", "pt", "cz", "eu", "us", "ca", "mx", "br", "ar", "cl", "au", "nz", "jp", "cn", "in", "kr", "ru", "za", "ie")
FILES = ("png", "jpg", "jpeg", "gif", "svg", "css", "js", "py", "txt", "html", "zip", "exe", "dll")
DIALLING = "1|7|20|27|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-9][0-9]|3[5789][0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|69[0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9]"
ISSUERS = r"4[0-9]{12}(?:[0-9]{3})?(?:[0-9]{3})?|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|(?:6011|65[0-9]{2})[0-9]{12}|35[0-9]{14}|62[0-9]{14,17}"
# fixed values: words before personal data, and before what only looks like it
CUES = {
    "email": ("e-?mail|mail|contact|write|reach|address", "file|path|import|module"),
    "ip": (r"\bips?\b|address|host|server|login|logged|client|from", r"version|release|build|section|chapter|\bv"),
    "card": ("card|visa|master|amex|credit|debit|payment|pay|charge", r"order|invoice|isbn|serial|tracking|article|\bid\b|number of|account id"),
    "phone": (r"phone|call|\btel\b|mobile|\bcell\b|fax|contact|dial|ring|whatsapp|\bsms\b", r"order|invoice|part|serial|version|\bid\b|page"),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def _before(lengths: Column) -> Column:
    """For each element the sum of those before it, in blocks of about the square root of their number."""

    def placed(x: Column) -> Column:
        block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x["n"]))).cast("int"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(x["n"]) - 1) / block).cast("int"))
        of = lambda k: _sum(F.slice(x["n"], k * block + 1, block))
        return _let(F.struct(x["n"].alias("n"), block.alias("b"), F.transform(blocks, of).alias("sums")), headed)

    def headed(x: Column) -> Column:
        heads = F.transform(x["sums"], lambda _, k: _sum(F.slice(x["sums"], 1, k)))
        return _let(F.struct(x["n"].alias("n"), x["b"].alias("b"), heads.alias("heads")), lambda y: F.transform(y["n"], lambda _, i: each(y, i)))

    def each(y: Column, i: Column) -> Column:
        k = F.floor(i / y["b"]).cast("int")
        return F.get(y["heads"], k) + _sum(F.slice(y["n"], k * y["b"] + 1, i % y["b"]))

    return _let(F.struct(lengths.alias("n")), placed)


FOUND = "array<struct<start: bigint, stop: bigint, m: string, before: string, after: string>>"


def _found(text: Column, pattern: str) -> Column:
    """Start, end, text and neighbourhood of each match, positions in characters from 0."""

    def placed(x: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        both = F.struct(x["m"].alias("m"), gaps.alias("gaps"))
        return _let(both, lambda y: _let(F.struct(y["m"].alias("m"), y["gaps"].alias("gaps"), _before(F.zip_with(y["m"], F.slice(y["gaps"], 1, F.size(y["m"])), lambda a, b: (F.length(a) + F.length(b)).cast("long"))).alias("at")), spelled))

    def spelled(y: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            gap = F.get(y["gaps"], i)
            start = F.get(y["at"], i) + F.length(gap)
            return F.struct(start.alias("start"), (start + F.length(m)).alias("stop"), m.alias("m"), F.lower(F.right(gap, F.lit(BEFORE))).alias("before"), F.left(F.get(y["gaps"], i + 1), F.lit(AFTER)).alias("after"))

        return F.transform(y["m"], one)

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m")), lambda x: F.when(F.size(x["m"]) > 0, placed(x)).otherwise(F.array().cast(FOUND)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the check of card numbers."""
    doubled = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), lambda d, i: _let(d.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.coalesce(_sum(doubled) % 10 == 0, F.lit(False))


OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"


def is_base(kind: str, m: Column) -> Column:
    """Whether a candidate is a base span."""
    n = F.length(_digits(m))
    if kind == "email":
        return F.contains(m, F.lit("@"))
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return ~F.contains(m, F.lit(".")) & n.between(16, 19) & luhn(_digits(m))
    return F.startswith(m, F.lit("+")) & n.between(8, 15)


def _vote(good: Column, bad: Column | None = None) -> Column:
    """1 for, -1 against, 0 for no opinion; without `bad`, whatever is not good is bad."""
    return F.when(good, 1).when(~good if bad is None else bad, -1).otherwise(0)


def votes(kind: str, x: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate."""
    m, d = x["m"], _digits(x["m"])
    last = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
    v6 = F.contains(m, F.lit(":"))
    if kind == "email":
        layout = _vote(m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:@| ?[\[({]at)") & ~F.contains(m, F.lit("..")))
        check, gazetteer = _vote(last.rlike("^[a-z]{2,24}$")), _vote(last.isin(*DOMAINS), last.isin(*FILES))
    elif kind == "ip":
        layout = _vote(~m.rlike(r"(^|\.)0[0-9]") & (~v6 | m.rlike("^(?:[^:]*:){3}")))
        check = _vote(F.when(v6, m.rlike("::") != m.rlike(f"^(?:{_HEX}:){{7}}{_HEX}$")).otherwise(m.rlike(OCTETS)))
        gazetteer = _vote(m.rlike(r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.|^[23][0-9A-Fa-f]{3}:|^[Ff][CcDdEe]"), m.rlike(r"^(?:0|127|255)\.") | v6)
    elif kind == "card":
        layout = _vote(m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ .-][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"))
        check, gazetteer = _vote(luhn(d)), _vote(d.rlike(f"^(?:{ISSUERS})$"))
    else:
        layout = _vote(m.rlike(r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,5}(?:[ .-][0-9]{2,5}){0,5}$|^\+[0-9]{8,15}$"))
        check = _vote(F.length(d).between(8, 15) & ~d.rlike(r"^(.)\1*$"))
        gazetteer = F.when(F.startswith(m, F.lit("+")), _vote(d.rlike(f"^(?:{DIALLING})"))).otherwise(_vote(F.lit(False), d.rlike("^[2-9]11")))
    good, bad = CUES[kind]
    context = _vote(x["before"].rlike(good), x["before"].rlike(bad))
    beside = x["before"].rlike(r"[\p{L}\p{N}_=/.-]$") | x["after"].rlike(r"^(?:[\p{L}\p{N}_=/@%]|[.-][\p{L}\p{N}])")
    return {"layout": layout, "check": check, "gazetteer": gazetteer, "context": context, "edges": _vote(~beside)}


def features(x: Column) -> dict[str, Column]:
    """What the final classifier sees of a candidate besides votes; each has few values."""
    m = x["m"]
    kind_of = lambda c: F.when(c.rlike(r"^\p{L}"), "letter").when(c.rlike("^[0-9]"), "digit").when(c.rlike(r"^\s"), "blank").when(c == "", "none").otherwise("mark")
    marks = F.regexp_replace(m, "[0-9A-Za-z]", "")
    return {
        "digits": F.least(F.length(_digits(m)), F.lit(20)).cast("string"), "mark": F.left(marks, F.lit(1)), "marks": F.least(F.size(F.array_distinct(F.split(marks, ""))), F.lit(4)).cast("string"),
        "left": kind_of(F.right(x["before"], F.lit(1))), "right": kind_of(F.left(x["after"], F.lit(1))),
    }


def candidates(documents: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and, by kind, the candidates: start, stop, base, votes (a letter for each labeler) and features."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def told(kind: str) -> Callable[[Column], Column]:
        def one(x: Column) -> Column:
            said = F.concat(*[F.when(v > 0, "+").when(v < 0, "-").otherwise("0") for v in votes(kind, x).values()])
            return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), is_base(kind, x["m"]).alias("base"), said.alias("votes"), F.struct(*[v.alias(k) for k, v in features(x).items()]).alias("features"))

        return one

    found = {kind: _found(F.col("text"), CANDIDATES[kind]) for kind in KINDS}
    found["card"] = F.filter(found["card"], lambda x: F.length(_digits(x["m"])).between(13, 19))
    return docs.select("doc_id", *[F.transform(found[kind], told(kind)).alias(kind) for kind in KINDS])


FEATURES = ("digits", "mark", "marks", "left", "right")
Counts = dict[tuple[str, bool, str, str, str], int]


def counted(found: DataFrame) -> Counts:
    """How many candidates of each kind, base or not, have which votes and which value of each feature; feature "" counts them all."""
    told = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["base"].alias("base"), x["votes"].alias("votes"), x["features"].alias("f")))
    each = found.select(F.inline(F.concat(*map(told, KINDS))))
    values = F.array(F.struct(F.lit("").alias("feature"), F.lit("").alias("value")), *[F.struct(F.lit(f).alias("feature"), F.col(f"f.{f}").alias("value")) for f in FEATURES])
    rows = each.select("kind", "base", "votes", F.inline(values)).groupBy("kind", "base", "votes", "feature", "value").count().collect()
    return {(r["kind"], r["base"], r["votes"], r["feature"], r["value"]): r["count"] for r in rows}


#: How often a labeler is expected to vote against, not at all and for, on false and on true candidates.
EXPECTED = {"layout": ((5, 3, 2), (1, 3, 6)), "check": ((6, 2, 2), (1, 1, 8)), "gazetteer": ((4, 4, 2), (1, 4, 5)), "context": ((2, 7, 1), (1, 6, 3)), "edges": ((4, 1, 5), (1, 1, 8))}


def estimated(cells: dict[tuple[bool, str], int]) -> dict[str, float]:
    """By votes, how likely a candidate of one kind beyond the base is true: expectation-maximisation, base spans being true."""
    said = {"-": 0, "0": 1, "+": 2}
    expected = [[[PRIOR_WEIGHT * x / sum(row) for x in row] for row in EXPECTED[name]] for name in LABELERS]
    chance, rates, share = {}, [[[x / PRIOR_WEIGHT for x in row] for row in rows] for rows in expected], PRIOR_SHARE
    order = sorted(cells)
    for _ in range(ROUNDS):
        for _, v in order:
            odds = math.log(share / (1 - share)) + sum(math.log(rates[k][1][said[c]] / rates[k][0][said[c]]) for k, c in enumerate(v))
            chance[v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        sums, true, beyond = [[list(row) for row in rows] for rows in expected], PRIOR_SHARE * PRIOR_WEIGHT, PRIOR_WEIGHT
        for base, v in order:
            n, p = cells[base, v], 1.0 if base else chance[v]
            for k, c in enumerate(v):
                sums[k][0][said[c]] += n * (1 - p)
                sums[k][1][said[c]] += n * p
            if not base:
                true, beyond = true + n * p, beyond + n
        rates, share = [[[x / sum(row) for x in row] for row in rows] for rows in sums], true / beyond
    return chance


def classifier(counts: Counts) -> dict[tuple[str, str, str], float]:
    """Log-odds that a kind ("", ""), a labeler's vote or a feature's value adds, from the estimated chances."""
    out = {}
    for kind in KINDS:
        chance = estimated({(base, v): n for (k, base, v, f, _), n in counts.items() if k == kind and f == ""})
        sums = defaultdict(lambda: [0.0, 0.0])
        for (k, base, v, f, value), n in sorted(counts.items()):
            if k != kind:
                continue
            p = 1.0 if base else chance[v]
            for name, x in [(f, value)] if f else [("", "beyond")] * (not base) + [(name, c) for name, c in zip(LABELERS, v, strict=True)]:
                sums[name, x][0] += n * (1 - p)
                sums[name, x][1] += n * p
        false, true = sums.pop(("", "beyond"), [0.0, 0.0])
        out[kind, "", ""] = math.log((true + PRIOR_SHARE * PRIOR_WEIGHT) / (false + (1 - PRIOR_SHARE) * PRIOR_WEIGHT))
        by_name = defaultdict(dict)
        for (name, x), both in sums.items():
            by_name[name][x] = both
        for name, rows in by_name.items():
            expected = dict(zip("-0+", zip(*[[PRIOR_WEIGHT * y / sum(row) for y in row] for row in EXPECTED[name]], strict=True), strict=True)) if name in EXPECTED else dict.fromkeys(rows, (1.0, 1.0))
            totals = [sum(r[y] for r in rows.values()) + sum(e[y] for e in expected.values()) for y in (0, 1)]
            for x in expected:
                had = rows.get(x, (0.0, 0.0))
                out[kind, name, x] = math.log((had[1] + expected[x][1]) / totals[1]) - math.log((had[0] + expected[x][0]) / totals[0])
    return out


def _score(kind: str, model: dict[tuple[str, str, str], float], x: Column) -> Column:
    """The classifier's log-odds of a candidate."""

    def of(name: str, value: Column) -> Column:
        rows = {v: w for (k, n, v), w in model.items() if k == kind and n == name}
        out = F.lit(0.0)
        for v, w in sorted(rows.items()):
            out = F.when(value == v, w).otherwise(out)
        return out

    parts = [of(name, F.substring(x["votes"], k + 1, 1)) for k, name in enumerate(LABELERS)] + [of(name, x["features"][name]) for name in FEATURES]
    total = F.lit(model[kind, "", ""])
    for p in parts:
        total = total + p
    return total


def personal_data(documents: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and spans of every document: kind, start, stop (characters, end exclusive), base; by kind as listed, then start.

    Candidates are kept once in the shared folder: counts and the decision must see the same ones, and texts are read once.
    """
    found = checkpointed(candidates(documents, text=text, doc_id=doc_id))
    model = classifier(counted(found))
    kept = lambda kind: F.filter(kind, lambda x: x["base"] | (_score(kind, model, x) >= 0))
    told = lambda kind: F.transform(kept(kind), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["base"].alias("base")))
    return found.select("doc_id", F.concat(*map(told, KINDS)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, base_sha256, and all spans as text."""
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(written(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
