"""Exact self-join of documents by the Jaccard similarity of their word shingles, to connected components.

Method: prefix-filtered set join that uses the relations between sets. Index lists are skipped by position (a
set that two shared shingles cannot bring to the threshold never enters the index, and an entry stands only as
long as what is left of its set suffices), and answers are derived between similar sets: a set that is linked to
a leader takes over the leader's component, so that of a group of near copies only the links to its leader
are computed, and afterwards only pairs from different components are left to verify.

1. Documents with equal shingle sets form one class; only classes are joined.
2. Every shingle meets its like in one packed shuffle (`repeats`), hot ones in the map tasks already. A class keeps the
   shingles that another class has too. One with fewer than 75 % of these has no partner.
3. What is left is ordered by rarity; the first shingles, as many as the prefix bound asks for, form the index.
4. First pass: in each index list the weightiest class leads, the one whose shingles most classes share; a class is
   verified against the weightiest of its leaders. Second pass: lists that still hold several components give pairs
   of these, then of their members, as far as bounds on size and position allow, and the pairs are verified.
5. Links between classes give components, and every document gets the smallest doc_id of its component.

Shingles are compared by all 64 bits of a fingerprint, classes by a 64-bit fingerprint of the sorted set and its size.

Nulls, empty texts and texts without words give an empty set, linked with nothing: component_id is the document's
own id. Repeated doc_ids stay as rows of their own. A null doc_id has a null component unless a link
names a smaller one. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import checkpointed, joined, mix, parts_for, spans, text_groups
from netsift.llm.repeats import BLOCKS, Blocks, notes, shared_tokens

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Distinct words whose fingerprints, and classes whose shingles have gone ahead, a Python worker remembers.
WORD_CACHE, CLASS_CACHE = 400_000, 2_000_000


class _Fingerprints(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], words: int, seen: dict) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter((seen[w] for part in split for w in part), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts)
    factors = mix(np.arange(1, words + 2, dtype=np.uint64)) | np.uint64(1)
    rolled = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    for i in range(words if len(rolled) else 0):
        rolled += flat[i : i + len(rolled)] * factors[i]
    rolled = mix(rolled)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        start = end - n
        if n >= words:
            out.append(np.unique(rolled[start : end - words + 1]))
        elif n:
            short = (flat[start:end] * factors[:n]).sum(keepdims=True) + np.uint64(n) * factors[words:]
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), len(tokens))


def _blocks(words: int, parts: int):
    """Blocks of the classes' shingles, and as notes the rows: id, whether it is null, number of shingles and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, blocks, classes = _Fingerprints(), Blocks(parts), set()
        for batch in batches:
            for group in text_groups(batch):
                sets = shingle_sets(group.column(1).to_pylist(), words, seen)
                names = [class_of(s) for s in sets]
                ids = group.column(0)
                blocks.note(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), np.array([len(s) for s in sets], np.int64), np.array(names, np.uint64).view(np.int64))
                for name, tokens in zip(names, sets, strict=True):
                    if len(tokens) and name not in classes:
                        classes.add(name)
                        blocks.add(name, len(tokens), tokens)
                if len(classes) > CLASS_CACHE:
                    classes.clear()
                if blocks.full():
                    yield from blocks.flush()
        yield from blocks.flush()

    return run


def least_overlap(n, numerator: int, denominator: int):
    """The smallest overlap that a set of n needs with any partner: ceil(n * threshold)."""
    return -(-n * numerator // denominator)


#: Classes that may have partners, and all rows, for which `prefix` is null and n the size of their set.
CLASSES = "doc_id long, class long, n long, prefix int, weight double, tokens array<long>"


def _rows(payloads: list[bytes]) -> pa.Table:
    doc, null, n, name = (np.concatenate(x) for x in zip(*notes(payloads), strict=True))
    none = lambda kind: pa.nulls(len(doc), kind)
    return pa.table({"doc_id": pa.array(doc, pa.int64(), mask=null.astype(bool)), "class": pa.array(name), "n": pa.array(n), "prefix": none(pa.int32()), "weight": none(pa.float64()), "tokens": none(pa.list_(pa.int64()))})


def _candidates(numerator: int, denominator: int, back: int):
    """A function for applyInArrow by part: classes that may have partners, their shared shingles by rarity; from part
    `back` on the rows."""

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= back:
            return _rows(table.column("payload").to_pylist())
        owners, sizes, counts, token, df = joined(table.column("payload").to_pylist())
        names, who = np.unique(owners, return_inverse=True)
        n = np.zeros(len(names), np.int64)
        n[who] = sizes
        need = least_overlap(n, numerator, denominator)
        owner = np.repeat(who.astype(np.int32), counts)
        order = np.lexsort((token, df, owner))
        owner, token, df = owner[order], token[order], df[order]
        del order
        # a hot token may come from its part and from a task that settled it
        new = np.ones(len(token), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
        owner, token, df = owner[new], token[new], df[new]
        have = np.bincount(owner, minlength=len(names))
        good = have >= need
        keep = good[owner]
        owner, token, df = owner[keep], token[keep], df[keep]
        weight = np.bincount(owner, df, len(names))[good]
        have, n, need = have[good], n[good], need[good]
        # shingles of one class only come first in rarity and use up the prefix
        prefix = np.maximum(0, (n - need + 1) - (n - have))
        offsets = np.append(0, np.cumsum(have)).astype(np.int32)
        return pa.table({
            "doc_id": pa.nulls(len(n), pa.int64()), "class": pa.array(names[good].view(np.int64)), "n": pa.array(n), "prefix": pa.array(prefix.astype(np.int32)),
            "weight": pa.array((weight + n - have) / n),
            "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(token.view(np.int64))),
        })

    return apply


def candidate_classes(docs: DataFrame, words: int, numerator: int, denominator: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """The classes that may have partners, and all rows with the class of their set; shingles are made once."""
    blocks = docs.mapInArrow(_blocks(words, parts), BLOCKS)
    shared = blocks.repartition(parts, "part").groupBy("part").applyInArrow(shared_tokens(parts, parts), BLOCKS)
    found = checkpointed(shared.repartition(parts, "part").groupBy("part").applyInArrow(_candidates(numerator, denominator, parts), CLASSES))
    return found.where("prefix is not null").drop("doc_id"), found.where("prefix is null").select("doc_id", F.col("n").alias("n_shingles"), "class")


def _entries(classes: DataFrame) -> DataFrame:
    """The index: one row for each class and shingle of its prefix, with its position among the shared ones."""
    prefix = F.slice("tokens", 1, F.col("prefix"))
    return classes.where("prefix > 0").select("class", "n", "weight", F.size("tokens").alias("m"), F.posexplode(prefix).alias("k", "token"))


def _verified(pairs: DataFrame, classes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Those of the pairs (a, b) whose similarity reaches the threshold."""
    side = lambda x: classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.where(denominator * common >= numerator * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def _least(numerator: int, denominator: int, n_a, n_b):
    return (n_a + n_b) * numerator <= F.least(n_a, n_b) * (numerator + denominator)


def star_links(entries: DataFrame, classes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """First pass: every class against the weightiest of the classes that lead its index lists.

    The weight of a class is the mean number of classes that have its shingles. In a group of near copies the text
    that they were made from has the largest, as every change brings rarer shingles.
    """
    lists = entries.groupBy("token").agg(F.count("*").alias("length"), F.max(F.struct("weight", "class", "n")).alias("lead"))
    # read back, so that the join is of two plain exchanges, which Spark splits where one list holds much of the index
    lists = checkpointed(lists.where("length > 1").drop("length"))
    named = entries.join(lists, "token").where(F.struct("weight", "class") < F.struct("lead.weight", "lead.class"))
    named = named.where(_least(numerator, denominator, F.col("n"), F.col("lead.n")))
    best = named.groupBy(F.col("class").alias("a")).agg(F.max("lead").alias("lead"))
    return _verified(best.select("a", F.col("lead.class").alias("b")), classes, numerator, denominator)


def cross_pairs(entries: DataFrame, component: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Second pass: pairs of classes of different components that share an index list and may reach the threshold.

    Lists that one component fills are skipped, and within a list only components meet, then their members.
    """
    # a set needs its whole prefix only against smaller partners; as the smaller one its first positions suffice
    position = F.col("n") - F.col("m") + F.col("k")
    short = (F.col("n") - position) * (numerator + denominator) >= 2 * numerator * F.col("n")
    entries = entries.join(component, "class", "left").withColumn("component", F.coalesce("component", "class")).withColumn("short", short)
    mixed = entries.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("short").alias("short"))
    mixed = checkpointed(mixed.where("low < high and short").select("token"))
    left = checkpointed(entries.join(mixed, "token"))
    # as the larger set, an entry has partners of at most `cap` shingles: the first that two sets share leaves no
    # more than what follows it; components meet, then their members, only as far as these bounds allow
    total, n_a, n_b = numerator + denominator, F.col("n_a"), F.col("n_b")
    left = left.withColumn("cap", F.least("n", F.floor((F.col("m") - F.col("k")) * total / numerator) - F.col("n")))
    parts_a = left.where("short").groupBy("token", F.col("component").alias("c_a")).agg(F.min("n").alias("low"))
    parts_b = left.groupBy("token", F.col("component").alias("c_b")).agg(F.max("cap").alias("high"))
    meet = parts_a.join(parts_b, "token").where("c_a <> c_b and low <= high")
    b = left.select("token", F.col("component").alias("c_b"), F.col("class").alias("b"), F.col("n").alias("n_b"), "cap")
    a = left.where("short").select("token", F.col("component").alias("c_a"), F.col("class").alias("a"), F.col("n").alias("n_a"))
    pairs = meet.join(b, ["token", "c_b"]).where("low <= cap").join(a, ["token", "c_a"]).where("n_a <= cap")
    near = _least(numerator, denominator, n_a, n_b)
    return pairs.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns class and component, the smallest class that links reach, for every class with a link.

    Alternating large-star and small-star steps; each step is a grouping and a join, kept in the checkpoint folder.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        edges = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        pull = edges.join(low, "a")
        moved = pull.where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = checkpointed(moved.union(low.select("a", F.col("low").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("a").alias("class")).agg(F.min("b").alias("component"))
        before = now


def near_duplicate_components(
    documents: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR
) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; two link at a similarity of numerator / denominator."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    classes, rows = candidate_classes(docs, words, numerator, denominator, parts_for(docs, "text"))
    entries = _entries(classes)
    links = checkpointed(star_links(entries, classes, numerator, denominator))
    pairs = cross_pairs(entries, components(links), numerator, denominator)
    component = checkpointed(components(links.union(_verified(pairs, classes, numerator, denominator))))
    rows = rows.join(component, "class", "left").withColumn("component", F.coalesce("component", "class"))
    first = checkpointed(rows.groupBy("component").agg(F.min("doc_id").alias("first")))
    named = rows.join(first, "component")
    return named.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))
