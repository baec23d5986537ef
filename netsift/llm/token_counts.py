"""Exact token counts of whole texts under a piece-wise BPE vocabulary with byte fallback.

Method: rank-synchronous merging of arrays. A text is cut into units at blanks, and each distinct unit is counted once
per worker. Units of a batch lie end to end in one array of symbols, which is cut further where no piece of the
vocabulary that stands in it spans two neighbouring characters. In every round each sequence between cuts applies its
pair of lowest rank, all sequences at once. In a long sequence every other pair goes along that is lowest as far as
pieces standing there could reach it: only merges of lower rank come before its own, and if none within that reach is
lower, none can take away one of its two symbols. So an unbroken text of a million characters takes few rounds, and a
round touches only places that can still merge. What survives are the tokens; a symbol without a piece counts its UTF-8 bytes.

Pieces of one repeated symbol that all have the last rank (here those of blanks) merge strictly from the left, one after the other: long
after the begin of a run each piece takes as many symbols as the one before, so all but a bounded part of a long run is counted by division.

Ranks come from the model file through its library; no text goes through the library's encoder. The model's
conventions hold: a blank before the text, blanks written as U+2581, nothing trimmed or normalised, strings of
control pieces inside a text are plain text. A very long text is counted group by group of units; one unbroken unit needs
about 100 bytes of memory a character. Null and empty texts have 0 bytes and 0 tokens. Repeated rows, ties
and other columns need no care: every row is counted by itself. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import runs, text_groups

LIMIT = 4096
BLANK = "\u2581"
#: Distinct units whose counts a Python worker remembers, and their characters; units that are merged in one array, by characters.
UNIT_CACHE, CACHE_CHARS, ARRAY_CHARS = 400_000, 16_000_000, 1_000_000
PIECE_BITS = 22
NONE = np.iinfo(np.int32).max
ODD = re.compile(r"\n|[ \u2581]+[^ \u2581\n]*|[^ \u2581\n]+")


class Pieces:
    """The vocabulary as arrays: symbols are numbers, a pair of symbols makes a symbol of a rank."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        text = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.newline_is_alone = not any("\n" in p for p in text)
        rank_of = {s: r for r, s in enumerate(sorted(set(text.values()), reverse=True))}
        chars = sorted({c for p in text for c in p})
        self.symbol = {c: i for i, c in enumerate(chars)}
        for p in text:
            self.symbol.setdefault(p, len(self.symbol))
        whole = np.zeros(len(self.symbol), bool)
        rank = np.full(len(self.symbol), NONE, np.int32)
        for p, score in text.items():
            whole[self.symbol[p]], rank[self.symbol[p]] = True, rank_of[score]
        self.char = np.full(max(map(ord, chars)) + 1, -1, np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(len(chars))
        self.bytes = np.array([0 if whole[i] else len(c.encode()) for i, c in enumerate(chars)] + [0] * (len(self.symbol) - len(chars)))
        self.inside = np.zeros((len(chars), len(chars)), bool)
        pairs = {}
        for p in text:
            number = self.symbol[p]
            at = [self.symbol[c] for c in p]
            self.inside[at[:-1], at[1:]] = True
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = number
        keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in keys.tolist()], np.int32)
        self.rank = rank[self.made]
        # a power of two of slots, each with at most one key after probing `reach` places
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.slot = np.full((1 << self.bits) + 64, -1, np.int64)
        self.at = np.zeros(len(self.slot), np.int32)
        self.reach = 0
        for i, k in enumerate(keys.tolist()):
            s = self._first(k)
            d = 0
            while self.slot[s + d] != -1:
                d += 1
            self.slot[s + d], self.at[s + d] = k, i
            self.reach = max(self.reach, d)
        # merges after which no pair of the same or a lower rank can arise beside them
        lowest = np.full(len(self.symbol), NONE, np.int64)
        np.minimum.at(lowest, keys >> 20, self.rank)
        np.minimum.at(lowest, keys & ((1 << 20) - 1), self.rank)
        self.calm = lowest > np.where(rank == NONE, 0, rank)
        # strings that may be pieces, by a hash of their characters; others may look like one
        self.longest = max(map(len, text))
        self.maybe = np.zeros(1 << PIECE_BITS, bool)
        for size in range(2, self.longest + 1):
            some = [p for p in text if len(p) == size]
            points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).reshape(len(some), size)
            self.maybe[self._spot(next(x for n, x in self._grams(points.ravel()) if n == size)[::size])] = True

        self.periods = self._periods()

    def _periods(self) -> list[tuple[re.Pattern, int, int]]:
        """For each symbol whose pieces merge from the left only: a pattern of its long runs, how much of a run is to be
        merged in any case, and how many symbols each further token takes."""
        names, only = list(self.symbol), {}
        for made, rank in zip(self.made.tolist(), self.rank.tolist(), strict=True):
            if len(set(names[made])) == 1:
                only.setdefault(names[made][0], []).append((rank, len(names[made])))
        out, last, self.periods = [], int(self.rank.max()), []
        for sign, found in only.items():
            most = max(n for _, n in found)
            if any(rank < last for rank, _ in found) or most < 3:
                continue
            # every piece has the same rank, so a run is the same from some place on whatever stands before or after it
            counts = merge_counts([sign * n for n in range(2 * most, 5 * most + 1)], self)
            for step in range(1, most + 1):
                if (counts[step:] - counts[:-step] == 1).all():
                    out.append((re.compile(f"{re.escape(sign)}{{{5 * most},}}"), 4 * most, step))
                    break
        return out

    def shortened(self, unit: str) -> tuple[str, int]:
        """A unit whose long runs are cut to what must be merged, and the tokens that this leaves out."""
        less = 0
        for runs_of, keep, step in self.periods:

            def cut(run: re.Match, keep: int = keep, step: int = step) -> str:
                nonlocal less
                out = (len(run[0]) - keep) // step
                less += out
                return run[0][: len(run[0]) - out * step]

            unit = runs_of.sub(cut, unit)
        return unit, less

    def _grams(self, points: np.ndarray):
        """For each length from 2 the hashes of the strings of that length."""
        value = points.astype(np.uint64)
        for size in range(2, min(self.longest, len(points)) + 1):
            value = value[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[size - 1 :] + np.uint64(size)
            yield size, value

    def _spot(self, value: np.ndarray) -> np.ndarray:
        return ((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - PIECE_BITS)

    def reaches(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the longest piece ends that may start at each place, and where that starts which may end before it."""
        ends = np.arange(1, len(points) + 2, dtype=np.int32)
        starts = np.arange(-1, len(points), dtype=np.int32)
        for size, value in self._grams(points):
            at = np.flatnonzero(self.maybe[self._spot(value)]).astype(np.int32)
            ends[at] = at + size
            starts[at + size] = at
        return ends, starts

    def _first(self, key):
        return (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of the pair a, b in made and rank, or -1."""
        key = a.astype(np.int64) << 20 | b
        s = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.full(len(key), -1, np.int32)
        for d in range(self.reach + 1):
            hit = self.slot[s + d] == key
            found[hit] = self.at[s[hit] + d]
        return found


def merge_counts(units: list[str], pieces: Pieces) -> np.ndarray:
    """How many tokens each unit has."""
    less, whole = np.zeros(len(units), np.int64), "".join(units)
    if any(p.search(whole) for p, _, _ in pieces.periods):
        units, less = zip(*map(pieces.shortened, units), strict=True)
        whole = "".join(units)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, units), np.int64, len(units))
    unit = np.repeat(np.arange(len(units), dtype=np.int32), size)
    known = np.where(points < len(pieces.char), pieces.char[np.minimum(points, len(pieces.char) - 1)], -1)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    cost = np.where(known < 0, width, np.where(pieces.bytes[known] > 0, pieces.bytes[known], 1))
    alive, merged = _merged(points, known, unit, pieces)
    cost[merged] = 1
    return np.bincount(unit[alive], cost[alive], len(units)).astype(np.int64) + np.array(less, np.int64)


def _merged(points: np.ndarray, known: np.ndarray, unit: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The first characters of what is left when no pair can be merged, and those of merged ones."""
    n = len(points)
    right, left = pieces.reaches(points)
    # a sequence ends where the unit does, at an unknown character, and where no piece that stands here goes on
    cut = np.ones(n, bool)
    cut[1:] = (unit[1:] != unit[:-1]) | (known[1:] < 0) | (known[:-1] < 0) | (np.maximum.accumulate(right[: n - 1]) <= np.arange(1, n))
    start, length = runs(np.cumsum(cut, dtype=np.int32))
    end = np.append(np.repeat(start + length, length), n).astype(np.int32)
    right, left = np.minimum(right, end), np.maximum(left, np.append(np.repeat(start, length), n).astype(np.int32))
    # symbols by their first characters, as linked lists; the last element stands for what is before and after all
    symbol, stop = np.append(known, -1).astype(np.int32), np.arange(1, n + 2, dtype=np.int32)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[n], before[0] = n, n
    rank, made = np.full(n + 1, NONE, np.int32), np.zeros(n + 1, np.int32)
    alive, merged, touched = np.ones(n, bool), np.zeros(n, bool), np.zeros(n + 1, bool)
    fresh = np.flatnonzero(~cut[1:]).astype(np.int32)
    while len(fresh):
        pair = pieces.pair(symbol[fresh], symbol[after[fresh]])
        rank[fresh] = np.where(pair >= 0, pieces.rank[pair], NONE)
        made[fresh] = pieces.made[pair]
        at = np.flatnonzero(rank != NONE).astype(np.int32)
        if not len(at):
            break
        mine, safe = rank[at], np.ones(len(at), bool)
        # pairs after this one that could grow to take its second symbol
        some, reach = np.arange(len(at)), right[after[at]]
        other = after[at]
        while len(some):
            inside = stop[after[other]] <= reach
            some, other, reach = some[inside], other[inside], reach[inside]
            low = rank[other] < mine[some]
            safe[some[low]] = False
            some, other, reach = some[~low], after[other[~low]], reach[~low]
        # pairs before it that could grow to take its first symbol; one of the same rank comes earlier
        some = np.flatnonzero(safe)
        reach, other, step = left[stop[at[some]]], before[at[some]], 1
        while len(some):
            inside = (other < n) & (other >= reach)
            some, other, reach = some[inside], other[inside], reach[inside]
            low = (rank[other] < mine[some]) | ((rank[other] == mine[some]) & (step > 1) & ~pieces.calm[made[at[some]]])
            safe[some[low]] = False
            some, other, reach, step = some[~low], before[other[~low]], reach[~low], step + 1
        # of pairs of one rank that overlap every other one, from the left, as far as all before are safe
        new = np.ones(len(at), bool)
        new[1:] = (after[at[:-1]] != at[1:]) | (mine[1:] != mine[:-1])
        first = np.flatnonzero(new)
        begin = np.repeat(first, np.diff(np.append(first, len(at))))
        unsafe = np.cumsum(~safe)
        good = safe & (unsafe == unsafe[begin]) & safe[begin] & ((np.arange(len(at)) - begin) % 2 == 0)
        at = at[good]
        gone = after[at]
        symbol[at], stop[at], after[at] = made[at], stop[gone], after[gone]
        before[after[gone]] = at
        before[n] = n
        alive[gone], merged[at], rank[gone], rank[at] = False, True, NONE, NONE
        touched[at] = touched[before[at]] = True
        fresh = np.flatnonzero(touched[:n]).astype(np.int32)
        touched[fresh] = touched[n] = False
        rank[fresh] = NONE
        fresh = fresh[stop[fresh] < end[fresh]]
    return np.flatnonzero(alive), np.flatnonzero(merged & alive)


def _units(text: str) -> list[str]:
    """A text as units, each with its blank in front unless it begins a line; a line break is written in front."""
    spread = text.replace("\n", " \n")
    if "  " in spread or BLANK in text or " " in (text[0], text[-1]):
        return [u.replace(" ", BLANK) if u[0] in (" ", BLANK) else u if u == "\n" else "\0" + u for u in ODD.findall(" " + text)]
    return spread.split(" ")


class Counter:
    """Counts of units, remembered up to a bound.

    A unit as `_units` gives it stands for: a line break and what follows it; a run of U+2581 and what follows it;
    after a NUL, that text alone; anything else, U+2581 and that text. A text with NULs goes without these forms.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.known, self.chars = pieces, {}, 0

    def count(self, texts: list[str]) -> np.ndarray:
        plain = [i for i, t in enumerate(texts) if "\0" not in t and self.pieces.newline_is_alone]
        out = np.zeros(len(texts), np.int64)
        odd = sorted(set(range(len(texts))).difference(plain))
        if odd:
            out[odd] = merge_counts([BLANK + texts[i].replace(" ", BLANK) for i in odd], self.pieces)
        units = [_units(texts[i]) for i in plain]
        fresh = list({u for part in units for u in part}.difference(self.known))
        if len(self.known) + len(fresh) > UNIT_CACHE or self.chars > CACHE_CHARS:
            self.known.clear()
            self.chars = 0
            fresh = list({u for part in units for u in part})
        self.chars += sum(map(len, fresh))
        at = 0
        while at < len(fresh):
            stop, size = at, 0
            while stop < len(fresh) and size < ARRAY_CHARS:
                size += len(fresh[stop]) + 1
                stop += 1
            some = fresh[at:stop]
            written = [u if u[:1] in ("\n", BLANK) else u[1:] if u[:1] == "\0" else BLANK + u for u in some]
            self.known.update(zip(some, merge_counts(written, self.pieces).tolist(), strict=True))
            at = stop
        get = self.known.__getitem__
        out[plain] = [sum(map(get, part)) for part in units]
        return out


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Pieces(path))
        for batch in batches:
            for group in text_groups(batch):
                texts = [t or "" for t in group.column(1).to_pylist()]
                tokens, some = np.zeros(len(texts), np.int64), [i for i, t in enumerate(texts) if t]
                tokens[some] = counter.count([texts[i] for i in some])
                yield pa.RecordBatch.from_arrays([group.column(0), pa.array(tokens)], names=["carried", "n_tokens"])

    return run


def count_tokens(documents: DataFrame, model: str, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """The carried columns, n_bytes, n_tokens, and over_limit where there are more tokens than the limit."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    rows = documents.select(F.struct(*[F.col(c) for c in carry], size).alias("carried"), F.col(text).alias("text"))
    kind = rows.schema["carried"].dataType.simpleString()
    out = rows.mapInArrow(_count(model, limit), f"carried {kind}, n_tokens long")
    return out.select(*[F.col("carried")[c].alias(c) for c in (*carry, "n_bytes")], "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
