"""Removal of every byte that a long repeated string covers, over a whole corpus.

Method: prefix-free parsing. A rolling hash picks triggers: in every string of `length` bytes the smallest hash of
its grams is one, the leftmost on ties. All strings with the same trigger position form a phrase, so that neighbouring
phrases overlap by length - 1 bytes and every string of that length lies in exactly one phrase, at a place
that its own bytes decide. The dictionary is the set of distinct phrases, the parse the list of their places.

Two equal strings of that length lie in phrases with the same trigger, at the same distance from it. Hence the order of
the corpus' suffixes, as far as their first `length` bytes, follows from the dictionary alone, and the parse adds how
often and where. (What the parse's own suffix array would order are strings that agree beyond `length` bytes; nothing here asks for it.)

1. The parse is dealt by trigger. A phrase that occurs twice is repeated from end to end. One whose trigger
   occurs nowhere else holds nothing repeated. Only phrases that share a trigger, not their bytes, stay open.
2. Of the open phrases, one place each, the bytes are dealt by trigger, and a part builds the suffix array of its share of
   the dictionary by prefix doubling up to `length` bytes; neighbours that agree so far are repeated strings. Bytes
   are compared, not hashes.
3. The spans of both steps go back to their documents and are cut out.

A trigger of very many phrases, a line that a third of the documents share in ever different company, is not dealt
as one: where a map task or a part finds it hot, the strings of its phrases are dealt one by one, by a 64-bit
fingerprint, and those that agree in it are repeated.

Before either exchange a map task settles what repeats among the places it holds: all but one place of such a string
go ahead as repeated, and the one that stands for them says so. A passage that a third of the documents share thus
sends one place for each flush, not for each document, to the part of its trigger or fingerprint.

A span is decided on the input, so the first copy goes as well. Strings never cross documents. Null text counts
as empty: zero bytes, nothing removed. Texts shorter than `length` stay. Rows with the same doc_id and text
are two places. Other columns are ignored, or carried along under their own names by `carry`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import checkpointed, joined, mix, pack, parts_for, runs, spans, text_groups

LENGTH, GRAM = 200, 64
#: Longer texts are parsed in segments of so many bytes; strings never depend on where a segment ends.
SEGMENT = 400_000
#: A trigger with more different phrases in a map task's flush, or in its part, is hot.
HOT_IN_FLUSH, HOT_IN_PART = 500, 20_000
#: Bytes of phrases that one suffix array orders, whole triggers each.
ARRAY_BYTES = 1_000_000
POSITION_BITS = np.uint64(20)
PARSE = "part int, payload binary"
PLACES = "row long, kind int, lo long, n int, trigger long"
REPEATED, OPEN, HOT = 0, 1, 2
SPANS = "row long, lo long, hi long"

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 20), base, np.uint64)
        factors[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(factors)
    return have[:n]


class Rolling:
    """Polynomial hashes of any string of a buffer."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _powers(_STEP, len(data)), out=self.sums[1:])
        self.back = _powers(_BACK, len(data) + 1)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start] + mix(np.atleast_1d(np.asarray(length)).astype(np.uint64)))

    def grams(self, length: int) -> np.ndarray:
        """The hashes of all strings of that length."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n] + mix(np.array([length], np.uint64)))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of that width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def parse(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrases of the texts: index of the text, place, number of strings, hash of the trigger, hash of the phrase."""
    pieces = [(i, s) for i, t in enumerate(texts) for s in range(0, len(t) - length + 1, SEGMENT)]
    at = 0
    while at < len(pieces):
        mine, size = [], 0
        while at < len(pieces) and (not mine or size < SEGMENT):
            i, s = pieces[at]
            mine.append((i, s, min(SEGMENT + length - 1, len(texts[i]) - s)))
            size += mine[-1][2]
            at += 1
        data = np.frombuffer(b"".join(texts[i][s : s + n] for i, s, n in mine), np.uint8)
        rolling = Rolling(data)
        grams = rolling.grams(gram)
        low = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
        keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        trigger = (_least(keyed, length - gram + 1) & low).astype(np.int64)
        text, begin, n = (np.array(x, np.int64) for x in zip(*mine, strict=True))
        base = np.cumsum(n) - n
        strings = n - length + 1
        starts = spans(base, strings)
        first, count = runs(trigger[starts])
        lo = starts[first]
        piece = np.searchsorted(base, lo, side="right") - 1
        yield text[piece], lo - base[piece] + begin[piece], count, grams[trigger[lo]], rolling.of(lo, count + length - 1)


def _encoded(column: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]


def _parse_blocks(length: int, gram: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for group in text_groups(batch, limit=SEGMENT):
                row = np.array(group.column(0).to_pylist(), np.int64)
                for text, lo, count, trigger, phrase in parse(_encoded(group.column(1)), length, gram):
                    held.append((row[text], lo.astype(np.uint32), count.astype(np.uint16), trigger, phrase))
                    size += len(lo)
                if size > 200_000:
                    yield from _without_hot(held, parts)
                    held, size = [], 0
        yield from _without_hot(held, parts)

    return run


def _without_hot(held: list[tuple[np.ndarray, ...]], parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the places held; those of hot triggers go by row to parts from 2 `parts` on, and one of them,
    for which the number of strings is 0, tells the trigger's part."""
    if not held:
        return
    row, lo, count, trigger, phrase = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((phrase, trigger))
    first, n = runs(trigger[order])
    new = np.ones(len(order), np.int64)
    new[1:] = (phrase[order][1:] != phrase[order][:-1]) | (trigger[order][1:] != trigger[order][:-1])
    much = np.add.reduceat(new, first) > HOT_IN_FLUSH
    hot = np.zeros(len(order), bool)
    hot[order] = np.repeat(much, n)
    if hot.any():
        at = np.flatnonzero(hot)
        for s in range(0, len(at), 10_000):
            some = at[s : s + 10_000]
            yield _block(2 * parts + int(mix(row[some[:1]].view(np.uint64))[0] % np.uint64(parts)), row[some], lo[some], count[some], trigger[some])
        told = order[first[much]]
        count = count.copy()
        count[told] = 0
        keep = ~hot
        keep[told] = True
        row, lo, count, trigger, phrase = (a[keep] for a in (row, lo, count, trigger, phrase))
    yield from _dealt([(row, lo, count, trigger, phrase)], 4, 3, parts)


def _block(part: int, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "payload": pa.array([pack(*arrays)], pa.binary())})


def _part_of(values: np.ndarray, parts: int) -> np.ndarray:
    """A trigger is the least hash of many, so that its upper bits are small until they are mixed again."""
    return (((mix(values) >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int32)


def _dealt(held: list[tuple[np.ndarray, ...]], string: int, by: int, parts: int, by_row: bool = False, first_part: int = 0) -> Iterator[pa.RecordBatch]:
    """Packed blocks of the places held, by part from `first_part` on; the next `parts` parts hold settled places.

    Of the places whose array at `string` agrees one goes on, with an array more: 2 if it stands for several, else 1.
    A hash, the array at `by`, names its part. The others are settled. by_row: a row's number stands once in a block.
    """
    if not held:
        return
    arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
    order = np.argsort(arrays[string], kind="stable")
    first, n = runs(arrays[string][order])
    times = np.zeros(len(order), np.uint8)
    times[order[first]] = np.minimum(n, 2)
    settled = [a[times == 0] for a in arrays]
    if len(settled[0]):
        yield _block(first_part + parts + int(mix(settled[0][:1].view(np.uint64))[0] % np.uint64(parts)), *settled)
    arrays = [a[times > 0] for a in (*arrays, times)]
    part = first_part + _part_of(arrays[by], parts)
    order = np.argsort(part, kind="stable")
    arrays, part = [a[order] for a in arrays], part[order]
    for s, n in zip(*runs(part), strict=True):
        mine = [a[s : s + n] for a in arrays]
        if by_row:
            first, count = runs(mine[0])
            mine[:1] = [mine[0][first], count.astype(np.uint32)]
        yield _block(int(part[s]), *mine)


def _sorted_places(parts: int):
    """Repeated phrases, every place; open ones and those of hot triggers, a place for each distinct phrase."""

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        kind_of_block = key[0].as_py() // parts
        if kind_of_block == 2:
            row, lo, count, trigger = joined(table.column("payload").to_pylist())
            kind = np.full(len(row), HOT, np.int32)
        elif kind_of_block == 1:
            row, lo, count, trigger = joined(table.column("payload").to_pylist())[:4]
            row, lo, count, trigger = (a[count > 0] for a in (row, lo, count, trigger))
            kind = np.full(len(row), REPEATED, np.int32)
        else:
            row, lo, count, trigger, phrase, times = joined(table.column("payload").to_pylist())
            told = np.unique(trigger[count == 0])
            row, lo, count, trigger, phrase, times = (a[count > 0] for a in (row, lo, count, trigger, phrase, times))
            order = np.lexsort((lo, row, phrase, trigger))
            row, lo, count, trigger, phrase, times = (a[order] for a in (row, lo, count, trigger, phrase, times))
            new = np.ones(len(row), bool)
            new[1:] = (phrase[1:] != phrase[:-1]) | (trigger[1:] != trigger[:-1])
            s, n = runs(trigger)
            if len(s):
                same_trigger = np.repeat(np.add.reduceat(times, s, dtype=np.int64), n)
                hot = np.repeat(np.add.reduceat(new, s, dtype=np.int64) > HOT_IN_PART, n) | np.isin(trigger, told)
                s = np.flatnonzero(new)
                places = np.repeat(np.add.reduceat(times, s, dtype=np.int64), np.diff(np.append(s, len(row))))
                repeated, opened = places >= 2, new & ((same_trigger > places) | hot)
                kind = np.concatenate((np.full(int(repeated.sum()), REPEATED), np.where(hot[opened], HOT, OPEN))).astype(np.int32)
                row, lo, count, trigger = (np.concatenate((a[repeated], a[opened])) for a in (row, lo, count, trigger))
            else:
                kind = np.zeros(0, np.int32)
        return pa.table({"row": pa.array(row), "kind": pa.array(kind), "lo": pa.array(lo.astype(np.int64)), "n": pa.array(count.astype(np.int32)), "trigger": pa.array(trigger.view(np.int64))})

    return apply


def _dictionary_blocks(length: int, parts: int):
    """The bytes of open phrases, dealt by trigger, and fingerprints of the strings of hot ones, dealt by fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list[tuple[bytes, int, int, int, int]] = []
        held: list[tuple[np.ndarray, ...]] = []
        size = strings = 0
        for batch in batches:
            for group in text_groups(batch, limit=SEGMENT):
                for row, text, phrases in zip(group.column(0).to_pylist(), _encoded(group.column(1)), group.column(2).to_pylist(), strict=True):
                    hot = [p for p in phrases if p["kind"] == HOT]
                    for s in range(0, len(hot), 1_000):
                        some = hot[s : s + 1_000]
                        held.append(_fingerprints([text[p["lo"] : p["lo"] + p["n"] + length - 1] for p in some], [row] * len(some), [p["lo"] for p in some], [p["n"] for p in some], length))
                        strings += len(held[-1][0])
                        if strings > 400_000:
                            yield from _dealt(held, 2, 2, parts, by_row=True, first_part=parts)
                            held, strings = [], 0
                    for p in phrases:
                        if p["kind"] == OPEN:
                            opened.append((text[p["lo"] : p["lo"] + p["n"] + length - 1], row, p["lo"], p["n"], p["trigger"]))
                            size += p["n"] + length - 1
                            if size > 8 * SEGMENT:
                                yield from _by_trigger(opened, parts)
                                opened, size = [], 0
        yield from _by_trigger(opened, parts)
        yield from _dealt(held, 2, 2, parts, by_row=True, first_part=parts)

    return run


def _by_trigger(opened: list[tuple[bytes, int, int, int, int]], parts: int) -> Iterator[pa.RecordBatch]:
    if not opened:
        return
    trigger = np.array([x[4] for x in opened], np.int64).view(np.uint64)
    part = _part_of(trigger, parts)
    order = np.argsort(part, kind="stable")
    for s, n in zip(*runs(part[order]), strict=True):
        mine = [opened[i] for i in order[s : s + n]]
        numbers = [np.array([x[k] for x in mine], kind) for k, kind in ((1, np.int64), (2, np.uint32), (3, np.uint16), (4, np.int64))]
        yield _block(int(part[order[s]]), *numbers, np.frombuffer(b"".join(x[0] for x in mine), np.uint8))


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places `at` in the order of the `length` bytes that begin there, and where a string differs from the one before.

    Prefix doubling: strings of 8 bytes are ranked, then pairs of ranks 8, 16, ... bytes apart, and of ranks that few enough
    bytes apart overlap at last; a place whose rank no other has is settled. Ranks of strings that run over the end of a
    phrase are worth nothing, and no place in `at` looks at them.
    """
    n = len(data)
    if not len(at):
        return at, np.zeros(0, bool)
    word, width = np.zeros(n, np.uint64), min(8, length)
    for k in range(width):
        word[: n - k] |= data[k:].astype(np.uint64) << np.uint64(8 * (7 - k))
    order = np.argsort(word)
    first, size = runs(word[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    while width < length:
        step = min(width, length - width)
        shared = order[np.repeat(size > 1, size)]
        shared = shared[shared + step < n]
        key = rank[shared] << np.int64(32) | rank[shared + step]
        by = np.argsort(key)
        order, key, width = shared[by], key[by], width + step
        first, size = runs(key)
        # within its group of equal ranks a place goes behind those that are less
        group, _ = runs(key >> np.int64(32))
        rank[order] += np.repeat(first - group[np.searchsorted(group, first, side="right") - 1], size)
    by = np.argsort(rank[at], kind="stable")
    ranked = rank[at][by]
    new = np.ones(len(at), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return at[by], new


def _fingerprints(cut: list[bytes], rows: list[int], places: list[int], counts: list[int], length: int) -> tuple[np.ndarray, ...]:
    rolling = Rolling(np.frombuffer(b"".join(cut), np.uint8))
    n = np.array(counts, np.int64)
    size = n + length - 1
    base = np.cumsum(size) - size
    position = spans(np.array(places, np.int64), n)
    return np.repeat(np.array(rows, np.int64), n), position.astype(np.uint32), rolling.of(spans(base, n), length)


def _shared(row: np.ndarray, lo: np.ndarray, n: np.ndarray, trigger: np.ndarray, data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and places of strings that stand in several places of the phrases, by suffix arrays of the phrases of some
    triggers each: equal strings share their trigger, so one array over all would say the same and take more memory."""
    n = n.astype(np.int64)
    size = n + length - 1
    base = np.cumsum(size) - size
    order = np.argsort(trigger, kind="stable")
    first, _ = runs(trigger[order])
    ends = np.cumsum(size[order])
    stops = ends[np.append(first[1:], len(order)) - 1]
    yield row[:0], lo[:0]
    k = 0
    while k < len(first):
        begin = ends[first[k]] - size[order[first[k]]]
        stop = max(k + 1, int(np.searchsorted(stops, begin + ARRAY_BYTES, side="right")))
        mine = order[first[k] : first[stop] if stop < len(first) else len(order)]
        k = stop
        own = np.cumsum(size[mine]) - size[mine]
        at, new = suffix_order(data[spans(base[mine], size[mine])], spans(own, n[mine]), length)
        s = np.flatnonzero(new)
        many = np.repeat(np.diff(np.append(s, len(at))), np.diff(np.append(s, len(at))))
        at = np.sort(at[many > 1])
        phrase = np.searchsorted(own, at, side="right") - 1
        yield row[mine[phrase]], (lo[mine[phrase]] + (at - own[phrase])).astype(np.uint32)


def _equal_suffixes(parts: int, back: int, length: int):
    def apply(key: tuple, table: pa.Table) -> pa.Table:
        kind = key[0].as_py() // parts
        arrays = joined(table.column("payload").to_pylist())
        if kind == 2:
            row, place = arrays[:2]
        elif kind == 1:
            row, count, place, suffix, times = arrays
            row = np.repeat(row, count)
            order = np.argsort(suffix, kind="stable")
            s, n = runs(suffix[order])
            found = order[np.repeat(np.add.reduceat(times[order], s, dtype=np.int64), n) >= 2]
            row, place = row[found], place[found]
        else:
            found = list(_shared(*arrays, length))
            row, place = (np.concatenate(x) for x in zip(*found, strict=True))
        part = (row.view(np.uint64) % np.uint64(back)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        row, place, part = row[order], place[order], part[order]
        at = list(zip(*runs(part), strict=True))
        return pa.table({
            "part": pa.array([int(part[s]) for s, _ in at], pa.int32()),
            "payload": pa.array([pack(row[s : s + n], place[s : s + n]) for s, n in at], pa.binary()),
        })

    return apply


def _suffix_spans(length: int):
    """Runs of neighbouring repeated strings of a row, as spans of bytes."""

    def apply(table: pa.Table) -> pa.Table:
        row, place = joined(table.column("payload").to_pylist())
        order = np.lexsort((place, row))
        row, place = row[order], place[order].astype(np.int64)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (place[1:] > place[:-1] + 1)
        s = np.flatnonzero(new)
        last = np.append(s[1:], len(row)) - 1
        return pa.table({"row": pa.array(row[s]), "lo": pa.array(place[s]), "hi": pa.array(place[last] + length)})

    return apply


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group in text_groups(batch, limit=SEGMENT):
            sizes, removed, count, digests, kept = [], [], [], [], []
            for text, found in zip(_encoded(group.column(1)), group.column(2).to_pylist(), strict=True):
                end, gone, n, rest = 0, 0, 0, []
                for lo, hi in sorted((x["lo"], x["hi"]) for x in found or ()):
                    if lo > end or not n:
                        rest.append(text[end:lo])
                        n += 1
                    gone += max(0, hi - max(lo, end))
                    end = max(end, hi)
                rest = b"".join(rest) + text[end:]
                sizes.append(len(text))
                removed.append(gone)
                count.append(n)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [group.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, count)), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                names=["carried", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def repeated_spans(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """row, lo, hi of the spans of repeated strings; rows has row, text and what is carried.

    All columns go through the join with open phrases, so that its exchange of texts is the one that a later join
    of the same rows uses again.
    """
    parts = parts_for(rows, "text")
    by_part = lambda df: df.repartition(parts, "part").groupBy("part")
    blocks = rows.select("row", "text").mapInArrow(_parse_blocks(length, gram, parts), PARSE)
    places = checkpointed(by_part(blocks).applyInArrow(_sorted_places(parts), PLACES))
    opened = places.where(F.col("kind") != REPEATED).groupBy("row").agg(F.collect_list(F.struct("lo", "n", "kind", "trigger")).alias("phrases"))
    dictionary = rows.join(opened, "row").select("row", "text", "phrases", "carried").mapInArrow(_dictionary_blocks(length, parts), PARSE)
    equal = by_part(dictionary).applyInArrow(_equal_suffixes(parts, parts, length), PARSE)
    spans_of = by_part(equal).applyInArrow(_suffix_spans(length), SPANS)
    whole = places.where(F.col("kind") == REPEATED).select("row", "lo", (F.col("lo") + F.col("n") + F.lit(length - 1)).alias("hi"))
    return whole.unionByName(spans_of)


def remove_repeats(documents: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The carried columns, n_bytes, n_removed, n_spans, kept_sha256 and kept, the text that is left.

    `kept` leaves out a character of which a part was removed; kept_sha256 is that of all remaining bytes.
    """
    row = F.xxhash64(F.col(doc_id), F.col(text))
    rows = documents.select(row.alias("row"), F.col(text).alias("text"), F.struct(*[F.col(c) for c in carry]).alias("carried"))
    found = repeated_spans(rows, length, gram)
    found = found.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    cut = rows.join(found, "row", "left").select("carried", "text", "found")
    kind = rows.schema["carried"].dataType.simpleString()
    out = cut.mapInArrow(_cut, f"carried {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return out.select(*[F.col("carried")[c].alias(c) for c in carry], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
