"""Fill-in-the-middle forms of documents, cut at line ends, with counts remembered by content-defined chunks.

Method: a rolling hash over the last 16 bytes cuts each text where its high bits are zero, so that a passage which many
documents share falls into the same chunks wherever it stands. What a chunk adds to a document is a small summary: its lines,
its characters, whether a marker stands in it, and the two bytes at each end, by which markers across a boundary are found. A
worker remembers summaries by the chunk's content itself (the table compares bytes, not hashes), up to a bound. Running sums
of the chunks' counts tell in which chunk the wanted line ends, and only there it is looked for.

A document of n lines (a line break belongs to its line) is cut after two numbers of lines that its id's digest gives. It
stays plain if it is empty, holds a marker, or the digest says so; else its parts are written with markers, suffix first or
prefix first. As a marker begins with "<" and has it nowhere else, no marker arises where parts meet, and `restored` finds
the text by the first place of each.

Null texts count as empty. Repeated rows and ids are formatted each for itself. A null id is hashed as if its digits were
none. Other columns are ignored, whatever their names. A text without a place to cut (one long run of a letter) is cut every
LONGEST bytes. Memory for one text is a few times its size. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import text_groups

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
#: A chunk ends where so many high bits of the hash are zero (2 kB apart on average), or after LONGEST bytes.
BITS, WINDOW, LONGEST = 11, 16, 1 << 16
#: Bytes of chunks whose summaries a worker remembers (speed only); bytes that are hashed at once.
REMEMBERED, BYTES_AT_ONCE = 32 << 20, 4 << 20
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))


class Summary(NamedTuple):
    """Of a chunk: line breaks, characters, whether a marker stands in it, its first and last two bytes."""

    breaks: int
    chars: int
    marked: bool
    head: bytes
    tail: bytes


def _table() -> np.ndarray:
    """A fixed scrambling of byte values."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


def boundaries(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where chunks end in an array of bytes, from the hash of the WINDOW bytes before; the end of data is none."""
    out = []
    for first in range(0, len(data), BYTES_AT_ONCE):
        back = min(first, WINDOW - 1)
        value = table[data[first - back : first + BYTES_AT_ONCE]]
        step = 1
        while step < WINDOW:  # twice as many bytes each time
            grown = value.copy()
            grown[step:] += value[:-step] * np.uint32(pow(0x01000193, step, 1 << 32))
            value, step = grown, 2 * step
        at = np.flatnonzero(value[back:] >> np.uint32(32 - BITS) == 0) + first
        out.append(at[at >= WINDOW - 1] + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Chunks:
    """Summaries of chunks by their content."""

    def __init__(self) -> None:
        self.table, self.known, self.size, self.hits = _table(), {}, 0, 0

    def cut(self, data: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """For each text, given by its end in data, the ends of its chunks from its own begin."""
        at, out, start = boundaries(data, self.table), [], 0
        for end in ends.tolist():
            lo, hi = np.searchsorted(at, start + WINDOW, "left"), np.searchsorted(at, end, "left")
            mine, last = [], start
            for stop in [*at[lo:hi].tolist(), end]:
                while stop - last > LONGEST:
                    last += LONGEST
                    mine.append(last - start)
                if stop > last:
                    mine.append(stop - start)
                    last = stop
            out.append(mine)
            start = end
        return out

    def summary(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        letters = np.frombuffer(chunk, np.uint8)
        found = Summary(chunk.count(b"\n"), int(np.count_nonzero((letters & 0xC0) != 0x80)), any(m in chunk for m in _MARKS), chunk[:2], chunk[-2:])
        if self.size + len(chunk) > REMEMBERED:
            self.known.clear()
            self.size = 0
        self.known[chunk] = found
        self.size += len(chunk)
        return found


class Text:
    """A text by its chunks: lines, whether it holds a marker, and where lines end."""

    def __init__(self, data: bytes, ends: list[int], chunks: Chunks) -> None:
        self.data, self.ends = data, ends
        self.parts = [chunks.summary(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        self.breaks = np.cumsum([p.breaks for p in self.parts])
        self.chars = np.cumsum([p.chars for p in self.parts])
        self.lines = (int(self.breaks[-1]) if self.parts else 0) + bool(data and not data.endswith(b"\n"))

    def marked(self) -> bool:
        if any(p.marked for p in self.parts):
            return True
        rest = b""
        for p in self.parts:
            joint = rest + p.head
            if any(m in joint for m in _MARKS):
                return True
            rest = (rest + p.tail)[-2:]
        return False

    def after(self, lines: int) -> tuple[int, int]:
        """Bytes and characters of the first so many lines."""
        if lines <= 0:
            return 0, 0
        if not self.parts or lines > self.breaks[-1]:
            return len(self.data), int(self.chars[-1]) if self.parts else 0
        k = int(np.searchsorted(self.breaks, lines))
        start, at = (self.ends[k - 1] if k else 0), (int(self.breaks[k - 1]) if k else 0)
        chunk = np.frombuffer(self.data, np.uint8, self.ends[k] - start, start)
        stop = int(np.flatnonzero(chunk == 10)[lines - at - 1]) + 1
        return start + stop, (int(self.chars[k - 1]) if k else 0) + int(np.count_nonzero((chunk[:stop] & 0xC0) != 0x80))


def formatted(text: Text, h: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple[str, int | None, int | None, bytes]:
    """Form, characters of prefix and middle (None if plain), and the output."""
    n, data = text.lines, text.data
    if not data or h[2] % 100 >= rate or text.marked():
        return "plain", None, None, data
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (a, a_chars), (b, b_chars) = text.after(first), text.after(second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = _MARKS
    if h[3] % 100 < spm_rate:
        return "spm", a_chars, b_chars - a_chars, b"".join((s, suffix, p, prefix, m, middle))
    return "psm", a_chars, b_chars - a_chars, b"".join((p, prefix, s, suffix, m, middle))


def _transform(rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        for batch in batches:
            for group in text_groups(batch):
                col = group.column(1).cast(pa.large_binary()).fill_null(b"")
                ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
                first, ends = int(ends[0]), ends[1:] - ends[0]
                data = np.frombuffer(col.buffers()[2], np.uint8, int(ends[-1]), first) if ends[-1] else np.zeros(0, np.uint8)
                out, start = [], 0
                hashes = group.column(2).to_pylist()
                for stop, cuts, h in zip(ends.tolist(), chunks.cut(data, ends), hashes, strict=True):
                    text = Text(data[start:stop].tobytes(), cuts, chunks)
                    out.append((text.lines, *formatted(text, h, rate, spm_rate)))
                    start = stop
                n, form, prefix, middle, output = zip(*out, strict=True)
                made = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
                yield pa.RecordBatch.from_arrays([group.column(0), *made], names=["carried", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(documents: DataFrame, *, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = (), seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, the carried columns, n (lines), form, prefix_chars, middle_chars and output of every document.

    `rate` percent of texts are not left plain, and of these `spm_rate` percent have the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("carried.id").cast("string"), F.lit(""))), 256)
    numbers = F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])
    carried = F.struct(F.col(doc_id).alias("id"), F.struct(F.lit(0).alias("none"), *[F.col(c) for c in carry]).alias("more"))
    rows = documents.select(carried.alias("carried"), F.col(text).alias("text")).withColumn("h", numbers)
    kind = rows.schema["carried"].dataType.simpleString()
    out = rows.mapInArrow(_transform(rate, spm_rate), f"carried {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.select(F.col("carried.id").alias(doc_id), *[F.col("carried.more")[c].alias(c) for c in carry], "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of which an output was made."""
    at = lambda mark: F.instr(output, mark)
    piece = lambda a, b=None: F.substring(output, a, (F.length(output) + 1 if b is None else b) - a)
    s, p, m = at(SUFFIX), at(PREFIX), at(MIDDLE)
    psm = F.concat(piece(F.lit(4), s), piece(m + 3), piece(s + 3, m))
    spm = F.concat(piece(p + 3, m), piece(m + 3), piece(F.lit(4), p))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
