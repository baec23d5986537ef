"""Capture files by ranges of bytes: several tasks read one file, whatever its size.

A classic capture file is a chain of records, and where a range begins no record need begin. So ranges are read twice. In the first
reading each range looks for a place from which plausible records follow one another, follows them to the first one that begins in a later range, and
counts. What it guessed is then held against the end of the range before: a payload may look like records, so a range whose
begin disagrees is counted again from the true place, until all agree. The second reading gives the frames, numbered from the
counts of the ranges before. Blocks of a pcapng file depend on what its section stated before, so one task reads such a file, block by block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.sources.folders import checkpointed

RANGE_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: Records that must follow one another before a place is taken for a begin, and the most bytes of a plausible record.
CHAIN, MOST = 12, 1 << 18
HEAD, RECORD = 24, 16
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
SECTION = b"\x0a\x0d\x0d\x0a"
BOUNDS = "path string, length long, nth long, ranges long, start long, stop long, n long"


def opened(path: str) -> BinaryIO:
    """A file that Python workers can reach, for reading at any place."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    system, at = (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def reachable(path: str) -> bool:
    return path.startswith(("file:", "/")) or path.split("://")[0] in ("s3", "gs", "gcs", "hdfs")


class Records:
    """Records of a classic capture file from some place on."""

    def __init__(self, file: BinaryIO, length: int) -> None:
        self.file, self.length = file, length
        head = self.read(0, HEAD)
        self.order, self.unit = CLASSIC.get(head[:4], ("", 0))
        self.section, self.head = head[:4] == SECTION, head
        if self.order:
            self.link = struct.unpack_from(f"{self.order}I", head.ljust(HEAD, b"\0"), 20)[0] & 0xFFFF
        self.at, self.data = 0, b""

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def bytes(self, at: int, size: int) -> bytes:
        """Bytes out of a block that is read ahead."""
        if not self.at <= at or at + size > self.at + len(self.data):
            self.at, self.data = at, self.read(at, max(size, READ_BYTES))
        return self.data[at - self.at : at - self.at + size]

    def follow(self, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """Place, seconds, fraction and size of each record that begins before `end`, from one at `at`; ends at a cut one."""
        while at < end and at + RECORD <= self.length:
            seconds, part, kept, _ = struct.unpack(f"{self.order}IIII", self.bytes(at, RECORD))
            if at + RECORD + kept > self.length:
                return
            yield at, seconds, part, kept
            at += RECORD + kept

    def _plausible(self, data: bytes) -> np.ndarray:
        """Places in data at which a record's head may stand."""
        n = len(data) - RECORD + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        raw = np.frombuffer(data, np.uint8).astype(np.uint32)
        shifts = (0, 8, 16, 24) if self.order == "<" else (24, 16, 8, 0)
        word = lambda k: sum(raw[k + i : k + i + n] << np.uint32(s) for i, s in enumerate(shifts))
        kept, stated = word(8), word(12)
        return np.flatnonzero((word(4) < 1_000_000 * self.unit) & (kept <= MOST) & (stated >= kept) & (stated <= MOST))

    def begin(self, at: int) -> int:
        """The first place from `at` on where records seem to begin; the file's length if there is none."""
        while at + RECORD <= self.length:
            data = self.read(at, MOST)
            for place in self._plausible(data).tolist():
                if self._chained(at + place):
                    return at + place
            at += max(1, len(data) - RECORD + 1)
        return self.length

    def _chained(self, at: int) -> bool:
        for _ in range(CHAIN):
            if at == self.length:
                return True
            head = self.bytes(at, RECORD)
            if len(head) < RECORD:
                return False
            _, part, kept, stated = struct.unpack(f"{self.order}IIII", head)
            if part >= 1_000_000 * self.unit or kept > MOST or not kept <= stated <= MOST:
                return False
            at += RECORD + kept
            if at > self.length:
                return False
        return True


def _counted(range_bytes: int):
    """Begin, end and number of records of ranges; the begin is looked for where it isn't given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                with opened(r["path"]) as file:
                    records, n = Records(file, r["length"]), 0
                    if records.section:
                        start = stop = 0
                    elif not records.order:
                        raise ValueError(f"{r['path']} is no capture file")
                    else:
                        end = min((r["nth"] + 1) * range_bytes, r["length"])
                        start = r["start"] if r["start"] is not None else HEAD if r["nth"] == 0 else records.begin(r["nth"] * range_bytes)
                        stop = start
                        for at, _, _, kept in records.follow(start, end):
                            n, stop = n + 1, at + RECORD + kept
                        if stop < end:  # what follows is no whole record
                            stop = r["length"]
                    out.append(r | {"start": start, "stop": stop, "n": n})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in BOUNDS.split(", ")]))

    return run


def ranges_of(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The ranges of files (path and length) with the records in them: where they begin and end, how many, and `first`, the number of
    those before. A file in sections is one range."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = F.greatest(F.lit(1), F.ceil(F.col("length") / range_bytes)).cast("long")
    rows = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("nth"), many.alias("ranges"))
    rows = rows.select("*", *[F.lit(None).cast("long").alias(c) for c in ("start", "stop", "n")])
    total = files.agg(F.sum(many)).first()[0] or 0
    told = checkpointed(rows.repartition(max(1, min(int(total), 64 * parts)), "path", "nth").mapInArrow(_counted(range_bytes), BOUNDS))
    by_file = Window.partitionBy("path").orderBy("nth")
    while True:
        seen = told.withColumn("due", F.lag("stop").over(by_file))
        wrong = (F.col("due") > 0) & (F.col("due") != F.col("start"))
        if seen.where(wrong).isEmpty():
            break
        again = seen.where(wrong).withColumn("start", F.col("due")).drop("due").mapInArrow(_counted(range_bytes), BOUNDS)
        told = checkpointed(seen.where(~F.coalesce(wrong, F.lit(False))).drop("due").unionByName(again))
    first = F.coalesce(F.sum("n").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return told.withColumn("first", first)


def stream_blocks(file: BinaryIO, length: int) -> Iterator[tuple[int, str, bytes]]:
    """Kind, byte order and body of each whole block of a file in sections, one at a time."""
    at, order = 0, "<"
    while at + 12 <= length:
        file.seek(at)
        head = file.read(12)
        if head[:4] == SECTION:
            order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        kind, size = struct.unpack_from(f"{order}II", head)
        if size < 12 or at + size > length:
            return
        file.seek(at + 8)
        yield (0 if head[:4] == SECTION else kind), order, file.read(size - 12)
        at += size
