"""Small helpers shared by the corpus operators: batches of text, packed arrays, checkpoints."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from netsift.sources.folders import checkpointed, shared_folder

__all__ = ["checkpointed", "joined", "mix", "pack", "parts_for", "runs", "shared_folder", "shuffle_parts", "spans", "text_groups", "unpack"]

#: Texts are handled in groups of about so many characters, so that memory in a Python worker is bounded.
GROUP_CHARS = 600_000


def text_groups(batch: pa.RecordBatch, text: int = 1, limit: int = GROUP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text column holds about `limit` bytes each; a longer text stands alone."""
    if not batch.num_rows:
        return
    col = batch.column(text)
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    ends = np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + len(col) + 1]
    start = 0
    while start < len(col):
        stop = int(np.searchsorted(ends, int(ends[start]) + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(col))
        yield batch.slice(start, stop - start)
        start = stop


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of plain numbers as one byte string."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sI", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays that `pack` was given."""
    (n,), at, out = struct.unpack_from("<B", data), 1, []
    heads = [struct.unpack_from("<2sI", data, at + 6 * i) for i in range(n)]
    at += 6 * n
    for kind, size in heads:
        out.append(np.frombuffer(data, "<" + kind.decode(), size, at))
        at += out[-1].nbytes
    return out


def joined(payloads: list[bytes]) -> list[np.ndarray]:
    """The packed arrays of many rows, each column of arrays end to end."""
    return [np.concatenate(x) for x in zip(*map(unpack, payloads), strict=True)]


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return starts, np.diff(np.append(starts, len(sorted_values)))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every span, end to end."""
    if not len(starts) or not (total := int(lengths.sum())):
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts.astype(np.int64) - first, lengths) + np.arange(total)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts_for(df: DataFrame, column: str, bytes_per_part: int = 16 << 20) -> int:
    """How many parts of about that much of a string or binary column df has; no fewer than Spark shuffles into."""
    from pyspark.sql import functions as F

    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(shuffle_parts(df.sparkSession), -(-total // bytes_per_part))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
