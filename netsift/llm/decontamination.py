"""Benchmark passages in documents, found within a bound on edits.

Method: q-gram lemma filtering. Text and benchmark items are lower-cased, and every run of characters other
than letters and digits becomes one blank. Every PASSAGE characters in a row of an item are a passage (an item that
is shorter is one passage). A passage of L characters with at most e edits shares L + 1 - q (e + 1) q-grams with its
place in a document, and all of them lie on diagonals at most e apart. So q-grams shared with an item are gathered in
overlapping bands of 2 (e + 1) diagonals, and passages that hold enough of a band's are verified, those of neighbouring
starts at once, by a banded alignment against the text of the band.

A passage that repeats within its item is indexed once and counts as often as it stands there. Where all passages of a
stretch are known to be held as they are, only candidates that could move the match's begin or end are verified, the outermost
first, so that text and item that both repeat take time in proportion to the text.

Texts go window by window, and a window with many shared q-grams in smaller ones and by ranges of items, so that
memory follows neither the length of a text nor how much it repeats. Neighbouring windows overlap by a passage and
its edits. Long items are held in segments for the same reason.

The edit budget of a passage is BUDGET of its length, less where the bound would fall below one q-gram. Items with
fewer than Q characters left, null ones included, match nothing; null and empty documents contain nothing. Equal
items each report their match. A match says where the first passage found begins, by an alignment from its end backwards,
and where the last one ends. Very long texts take time in proportion. No documents give no rows. Repeated documents report as often as they stand. Other columns are ignored or,
in `clean_documents`, kept. The benchmark is taken in blocks of BLOCK_CHARS, each broadcast on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import mix, runs, spans, text_groups

Q, PASSAGE, BUDGET = 10, 100, 0.08
#: Characters of benchmark text that are broadcast at once.
BLOCK_CHARS = 4_000_000
FILTER_BITS = 22
#: Bands and passages that are aligned at once.
BANDS, AT_ONCE = 8, 512
#: Characters of a text, and starts of an item, that are handled at once; shared q-grams that are gathered at once.
WINDOW, SEGMENT, HITS = 200_000, 1_024, 400_000
OTHER = regex.compile(r"[^\p{L}\p{N}]+")
MATCHES = "doc_id long, item_id long, start long, stop long, edits int, passages int"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ZERO = 1 << 32
_NONE = np.uint32(0xFFFFFFFF)


def normalised(text: str | None) -> str:
    return OTHER.sub(" ", text.lower()).strip() if text else ""


def _qgrams(points: np.ndarray, q: int) -> np.ndarray:
    n = len(points) - q + 1
    value = np.zeros(max(0, n), np.uint64)
    for i in range(q if n > 0 else 0):
        value *= _STEP
        value += points[i : i + n]
    return mix(value)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _windows(points: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of that size, put together from those of powers of two."""
    n, out, have, step = len(points), None, 0, 1
    value = points.astype(np.uint64) + np.uint64(1)
    while True:
        if size & step:
            out = value if out is None else out[: n - have - step + 1] * np.uint64(pow(int(_STEP), step, 1 << 64)) + value[have : n - step + 1]
            have += step
        if have == size:
            return mix(out)
        value = value[: n - 2 * step + 1] * np.uint64(pow(int(_STEP), step, 1 << 64)) + value[step : n - step + 1]
        step *= 2


def _distinct(text: str, points: np.ndarray, size: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Stretches of starts (first, one past the last) that together have every different passage, and for how many starts each
    start counts. Only stretches of repeated passages that are longer than a passage are left out."""
    n = len(points) - size + 1
    value = _windows(points, size)
    order = np.argsort(value, kind="stable")
    s, length = runs(value[order])
    named = np.empty(n, np.int64)
    named[order] = np.repeat(order[s], length)
    again = np.flatnonzero(named != np.arange(n))
    if len(again) <= size:
        return [(0, n)], np.ones(n, np.int64)
    again = again[[text[i : i + size] == text[k : k + size] for i, k in zip(again.tolist(), named[again].tolist(), strict=True)]]
    left_out = np.zeros(n, bool)
    new = np.flatnonzero(np.append(True, np.diff(again) > 1)) if len(again) else again
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(again)], strict=True):
        if b - a > size:
            left_out[again[a:b]] = True
    weight = (~left_out).astype(np.int64)
    np.add.at(weight, named[left_out], 1)
    kept = np.flatnonzero(~left_out)
    new = np.flatnonzero(np.append(True, np.diff(kept) > 1))
    return [(int(kept[a]), int(kept[b - 1]) + 1) for a, b in zip(new.tolist(), [*new[1:].tolist(), len(kept)], strict=True)], weight


class Passages:
    """Benchmark items, all of whose passages count, and an index from the hash of a q-gram to where it stands in them."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, length: int = PASSAGE, budget: float = BUDGET) -> None:
        self.q, self.item, self.text, edits, sizes = q, [], [], [], []
        self.weight: dict[int, np.ndarray] = {}
        for nth, (number, raw) in enumerate(items):
            text = normalised(raw)
            if len(text) >= q:
                size = min(length, len(text))
                stretches, self.weight[nth] = _distinct(text, _points(text), size)
                for begin, end in ((b, min(b + SEGMENT, last)) for first, last in stretches for b in range(first, last, SEGMENT)):
                    self.item.append((number, nth, begin))
                    self.text.append(text[begin : end + size - 1])
                    edits.append(max(0, min(int(budget * size), size // q - 1)))
                    sizes.append(size)
        self.points = [_points(t) for t in self.text]
        grams = [_qgrams(p, q) for p in self.points]
        self.edits = np.array(edits, np.int64)
        self.size = np.array(sizes, np.int64)
        self.last = np.array([len(t) for t in self.text], np.int64) - self.size
        self.least = self.size + 1 - q * (self.edits + 1)
        self.overlap = int((self.size + 2 * self.edits).max(initial=0)) + q
        lengths = np.array([len(g) for g in grams], np.int64)
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        first, self.count = runs(flat[order])
        self.gram, self.first = flat[order][first], first
        # entries by q-gram, then by owner
        self.owner = np.repeat(np.arange(len(grams)), lengths)[order]
        self.place = spans(np.zeros(len(grams), np.int64), lengths)[order]
        self.key = np.repeat(np.arange(len(first)), self.count) * len(grams) + self.owner
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[(self.gram >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of q-grams that items have, and entries of the index for them, a bounded number at once."""
        grams = _qgrams(points, self.q)
        at = np.flatnonzero(self.bits[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.gram):
            return
        slot = np.minimum(np.searchsorted(self.gram, grams[at]), len(self.gram) - 1)
        same = self.gram[slot] == grams[at]
        at, slot = at[same], slot[same]
        upto, begin = np.append(0, np.cumsum(self.count[slot])), 0
        while begin < len(at):
            # as many places as have so many entries, but no fewer than two overlaps of text
            stop = max(int(np.searchsorted(upto, upto[begin] + HITS, side="right")) - 1, int(np.searchsorted(at, at[begin] + 2 * self.overlap)))
            stop = min(stop, len(at))
            many, owners = int(upto[stop] - upto[begin]), len(self.text)
            step = max(1, owners * HITS // max(1, many))
            some, mine = at[begin:stop], slot[begin:stop]
            for o in range(0, owners, step):
                if step >= owners:
                    low, count = self.first[mine], self.count[mine]
                else:
                    low = np.searchsorted(self.key, mine * owners + o)
                    count = np.searchsorted(self.key, mine * owners + min(o + step, owners)) - low
                if count.any():
                    yield np.repeat(some, count), spans(low, count)
            if stop == len(at):
                return
            begin = max(begin + 1, int(np.searchsorted(at, at[stop - 1] - self.overlap)))

    def candidates(self, points: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Item, first and last start of passages, first and last diagonal, where enough q-grams are shared."""
        for at, entry in self.hits(points):
            found = self._dense(at, entry)
            # the outermost of each stretch first
            starts = [*(i for i, x in enumerate(found) if not i or x[0] != found[i - 1][0]), len(found)]
            for a, b in zip(starts, starts[1:], strict=False):
                yield from (found[a], *found[b - 1 : max(a, b - 2) : -1], *found[a + 1 : b - 1])

    def _dense(self, at: np.ndarray, entry: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        owner, place = self.owner[entry], self.place[entry]
        band = (at - place + _ZERO) // (self.edits[owner] + 1)
        # owner, band and place in one number, so that one sort brings them into order
        least_band, least_owner = int(band.min()) - 1, int(owner.min())
        low, middle = int(place.max()).bit_length(), int(band.max() - least_band).bit_length()
        packed = ((owner - least_owner) << middle | (band - least_band)) << low | place
        # a diagonal lies in the band that starts at its own multiple of the width and in the one before
        packed = np.sort(np.concatenate((packed, packed - (1 << low))))
        first, n = runs(packed >> low)
        key = packed[first] >> low
        owner = (key >> middle) + least_owner
        good = n >= self.least[owner]
        if not good.any():
            return []
        key = np.repeat((owner << 40 | ((key & ((1 << middle) - 1)) + least_band))[good], n[good])
        place = packed[np.repeat(good, n)] & ((1 << low) - 1)
        # from each q-gram to the one that makes them enough: the passages that hold both
        owner = key >> 40
        end = np.arange(len(key)) + self.least[owner] - 1
        inside = np.flatnonzero(end < len(key))
        end = end[inside]
        enough = (key[end] == key[inside]) & (place[end] - place[inside] <= self.size[owner[inside]] - self.q)
        inside, end = inside[enough], end[enough]
        key, owner = key[inside], owner[inside]
        low = np.maximum(0, place[end] - (self.size[owner] - self.q))
        high = np.minimum(place[inside], self.last[owner])
        if not len(key):
            return []
        new = np.append(True, (key[1:] != key[:-1]) | (low[1:] > high[:-1] + 1))
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(key)) - 1
        out: list[list[int]] = []
        for k, s, t in zip(key[start].tolist(), low[start].tolist(), high[stop].tolist(), strict=True):
            item, band = k >> 40, k & ((1 << 40) - 1)
            old = next((o for o in reversed(out[-4:]) if o[0] == item and o[4] in (band - 1, band) and o[1] <= t and s <= o[2] and band - o[3] < BANDS), None)
            if old:
                old[1:] = min(old[1], s), max(old[2], t), old[3], band
            else:
                out.append([item, s, t, band, band])
        width = (self.edits + 1).tolist()
        return [(item, s, t, b * width[item] - _ZERO, (c + 2) * width[item] - 1 - _ZERO) for item, s, t, b, c in out]

    def matches(self, text: str, any_of_them: bool = False) -> dict[int, list[int]]:
        """Start, end, least edits and number of passages of each item that the normalised text holds.

        any_of_them: the first passages found are enough.
        """
        found: dict[int, list[int]] = {}
        held: dict[tuple[int, int], set[int]] = {}
        for begin in range(0, len(text), WINDOW):
            self._matched(text[begin : begin + WINDOW + self.overlap], begin, found, held, any_of_them)
            if any_of_them and found:
                break
        return found

    def _matched(self, text: str, begin: int, found: dict[int, list[int]], held: dict[tuple[int, int], set[int]], any_of_them: bool) -> None:
        points = _points(text)
        for item, first, last, low, high in self.candidates(points):
            size, most = int(self.size[item]), int(self.edits[item])
            if any_of_them and found:
                return
            number, nth, base = self.item[item]
            mine = held.setdefault((number, nth), set())
            old = found.get(number)
            if old and old[2] == 0 and begin + first + low - most >= old[0] and begin + last + size + high + most <= old[1] and mine.issuperset(range(base + first, base + last + 1)):
                continue  # it can tell nothing new
            for s in range(first, last + 1, AT_ONCE):
                t = min(last, s + AT_ONCE - 1)
                whole = self.text[item][s : t + size]
                where, later = (max(0, s + low - most), max(0, s + high + most + len(whole))), 0
                at = text.find(whole, *where)
                if at >= 0:
                    later = text.rfind(whole, *where) - at
                    edits, ends = np.zeros(t - s + 1, np.int64), at + size + np.arange(t - s + 1)
                else:
                    edits, ends = window_edits(self.points[item], size, s, t, points, low, high, most)
                good = np.flatnonzero(edits <= most)
                if not len(good):
                    continue
                fresh = [x for x in (base + s + good).tolist() if x not in mine]
                mine.update(fresh)
                many = int(self.weight[nth][fresh].sum()) if fresh else 0
                k = good[ends[good].argmin()]
                start = int(ends[k]) - reach_back(self.points[item][s + k : s + k + size], points[: ends[k]], int(edits[k]))
                span = begin + start, begin + int(ends[good].max()) + later, int(edits[good].min()), many
                if (old := found.get(number)) is None:
                    found[number] = list(span)
                else:
                    old[:] = min(old[0], span[0]), max(old[1], span[1]), min(old[2], span[2]), old[3] + span[3]


def reach_back(passage: np.ndarray, text: np.ndarray, edits: int) -> int:
    """How many of the last characters of the text the passage makes with so few edits; the fewest if several do."""
    if not edits:
        return len(passage)
    text = text[::-1][: len(passage) + edits]
    step = np.arange(len(text) + 1)
    row = step.copy()
    for c in passage[::-1]:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != c))
        row = np.minimum.accumulate(new - step) + step
    return int(row.argmin())


def window_edits(item: np.ndarray, size: int, first: int, last: int, text: np.ndarray, low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each passage of `size` that starts at first to last of the item: the fewest edits that turn it into a string
    of the text within the diagonals low - most to high + most, and where that string ends. More than `most` edits
    may be more than the fewest."""
    low, high = low - most, high + most
    n, lanes, begin = last - first + 1, high - low + 1, first + low
    # what is outside the text equals nothing, so that to use it never takes fewer edits than to leave it
    around = np.full(n + lanes + size - 2, _NONE, np.uint32)
    a, b = max(0, begin), min(len(text), begin + len(around))
    if a < b:
        around[a - begin : b - begin] = text[a:b]
    shifted = np.lib.stride_tricks.sliding_window_view(around, n)
    step = np.arange(lanes, dtype=np.min_scalar_type(-2 * (lanes + size)))[:, None]
    # row i holds the edits less the lane, for the text position begin + i + lane + passage
    row = np.repeat(-step, n, axis=1)
    for i in range(size):
        new = row + (shifted[i : i + lanes] != item[first + i : first + i + n])
        np.minimum(new[:-1], row[1:] + 2, out=new[:-1])
        # the least of all lanes up to each, in steps that double
        reach = 1
        while reach < lanes:
            np.minimum(new[reach:], new[:-reach].copy(), out=new[reach:])
            reach *= 2
        row = new
        if i % 16 == 15 and (row + step).min() > most:
            break
    row = row + step
    best = row.argmin(axis=0)
    edits = row[best, np.arange(n)].astype(np.int64)
    if i < size - 1:
        edits[:] = most + 1
    return edits, np.clip(begin + np.arange(n) + best + size, 0, len(text))


def aligned(passage: str, text: str, low: int, high: int, most: int) -> tuple[int | None, int]:
    """The fewest edits, if at most `most`, that turn the passage into a string of the text within the diagonals
    low - most to high + most, and where that string ends."""
    edits, ends = window_edits(_points(passage), len(passage), 0, 0, _points(text), low, high, most)
    return (int(edits[0]), int(ends[0])) if edits[0] <= most else (None, 0)


def _find(passages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2
        for batch in batches:
            for group in text_groups(batch):
                rows = []
                for doc, text in zip(group.column(0).to_pylist(), group.column(1).to_pylist(), strict=True):
                    rows += [(doc, item, *span) for item, span in sorted(passages.value.matches(normalised(text)).items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "start", "stop", "edits", "passages"])

    return run


def _keep(passages, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in text_groups(batch, text):
                clean = [not passages.value.matches(normalised(t), any_of_them=True) for t in group.column(text).to_pylist()]
                yield group.filter(pa.array(clean, pa.bool_()))

    return run


def _blocks(benchmark: DataFrame, text: str, item_id: str) -> Iterator:
    """The benchmark as broadcast passages, block by block."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        rows = sorted((r["item"] if r["item"] is not None else -1, r["text"]) for r in mine.collect())
        yield benchmark.sparkSession.sparkContext.broadcast(Passages(rows))


def benchmark_matches(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """A row per document and item of which it holds a passage: where in the normalised text, with how many edits."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for passages in _blocks(benchmark, item_text, item_id):
        found = docs.mapInArrow(_find(passages), MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def clean_documents(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The documents, whole rows, that hold no passage of the benchmark."""
    for passages in _blocks(benchmark, item_text, item_id):
        documents = documents.mapInArrow(_keep(passages, documents.columns.index(text)), documents.schema)
    return documents
