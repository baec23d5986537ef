"""Documents drawn by how much their words resemble those of a target: importance resampling on hashed word n-grams.

Method: features are counted in buckets by the CRC-32 of their bytes, which is made from a position table. The CRC is
linear but for a constant of the length, so each byte of a feature contributes what a table holds for its value and its
distance from the feature's end; the contributions of all features of a group of texts are looked up at once and XORed
by `bitwise_xor.reduceat` over the features' spans. A feature longer than the table is cut into blocks from its end, and the
blocks are folded in pairs, the earlier one moved on by tables of its own.

One pass counts buckets (each task adds up its own and gives a row for each bucket), one more scores documents. A bucket's
gain is a log-ratio of target and corpus in thousandths; a document's weight is the mean gain of its features, and a
Gumbel term made from the id's hash turns the best scores into a draw without replacement. The draw finds the band of scores
in which it ends from a histogram, whose rows are bounded by the range of scores, and numbers the rows above by ranges.

Null and empty texts have no feature, weight 0, and are never drawn. Repeated rows are documents of their own; rows with one score
and one id come in any order among themselves. A null id is hashed as if its digits were none and comes after the others on ties.
Other columns are ignored, whatever their names. A very long text is worked off in blocks of words, a very long word is folded. An empty
corpus gives an empty result, an empty target counts as a target without features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import checkpointed, runs, spans, text_groups
from netsift.operators.numbering import ranked

ORDERS, BUCKETS, SEED, PERCENT, LEAST_WORDS = (1, 1), 10_000, 2024, 10, 20
#: Distances from the end that the position table holds; bytes of features that are looked up at once.
WIDTH, BYTES_AT_ONCE = 64, 2_000_000
#: Scores that share a row of the histogram by which the draw finds its end.
BAND = 64


class Crc:
    """CRC-32 of many spans of one array of bytes."""

    def __init__(self, width: int = WIDTH) -> None:
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
        rows = [one]
        for _ in range(width - 1):
            rows.append(rows[-1] >> 8 ^ one[rows[-1] & 255])
        self.width, self.table = width, np.concatenate(rows)
        self.constant = np.array([zlib.crc32(bytes(n)) for n in range(width + 1)], np.uint32)
        # a value moved on by `width` bytes, by each of its four bytes; then by twice as many, and so on
        ahead = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        for _ in range(width):
            ahead = ahead >> 8 ^ one[ahead & 255]
        self.ahead = [ahead]

    def _moved(self, value: np.ndarray, level: int) -> np.ndarray:
        while level >= len(self.ahead):
            self.ahead.append(self._moved(self.ahead[-1], len(self.ahead) - 1))
        t = self.ahead[level]
        return t[0][value & 255] ^ t[1][value >> 8 & 255] ^ t[2][value >> 16 & 255] ^ t[3][value >> 24]

    def _sums(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The contributions of spans of at most `width` bytes, without their constants."""
        first = np.cumsum(length) - length
        distance = np.repeat(first + length - 1, length) - np.arange(int(length.sum()))
        return np.bitwise_xor.reduceat(self.table[distance << 8 | data[spans(start, length)]], first)

    def of(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The CRCs of the spans, none of which is empty."""
        out, short = np.zeros(len(start), np.uint32), length <= self.width
        if short.any():
            out[short] = self._sums(data, start[short], length[short]) ^ self.constant[length[short]]
        for i in np.flatnonzero(~short).tolist():
            out[i] = self._folded(data[start[i] : start[i] + length[i]]) ^ zlib.crc32(bytes(int(length[i])))
        return out

    def _folded(self, data: np.ndarray) -> int:
        """The contributions of one long span: its blocks from the last, folded in pairs."""
        end = np.arange(len(data), 0, -self.width)
        length = np.minimum(end, self.width)
        step = BYTES_AT_ONCE // self.width
        value = np.concatenate([self._sums(data, (end - length)[i : i + step], length[i : i + step]) for i in range(0, len(end), step)])
        level = 0
        while len(value) > 1:
            value[1::2] = self._moved(value[1::2], level)
            value, level = np.bitwise_xor.reduceat(value, np.arange(0, len(value), 2)), level + 1
        return int(value[0])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(texts: pa.Array, orders: tuple[int, int], crc: Crc, words: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of features and their hashes, block by block; adds each row's number of words to `words`."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if ends[-1] == ends[0]:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _WORD[data]
    open_, shut = inside.copy(), inside.copy()
    open_[1:] &= ~inside[:-1]
    shut[:-1] &= ~inside[1:]
    at = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    open_[at] = inside[at]
    shut[at - 1] = inside[at - 1]
    start, stop = np.flatnonzero(open_), np.flatnonzero(shut) + 1
    del open_, shut
    row = np.searchsorted(ends, start, side="right") - 1
    if words is not None:
        words += np.bincount(row, minlength=len(texts)).astype(np.int64)
    # words in small letters with one blank after each, so that a run of words is one span
    length = stop - start
    total, most, first = np.cumsum(length), max(1, BYTES_AT_ONCE // orders[1]), 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + most, side="right")))
        reach = min(len(start), last + orders[1] - 1)  # runs of words that begin in this block may end beyond it
        n, of = length[first:reach], row[first:reach]
        begin = np.cumsum(n + 1) - (n + 1)
        line = np.full(int((n + 1).sum()), 32, np.uint8)
        line[spans(begin, n)] = _LOWER[data[spans(start[first:reach], n)]]
        for order in range(orders[0], orders[1] + 1):
            head = np.arange(min(last - first, max(0, reach - first - order + 1)))
            head = head[of[head] == of[head + order - 1]]
            if len(head):
                tail = head + order - 1
                yield of[head], crc.of(line, begin[head], begin[tail] + n[tail] - begin[head])
        first = last


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    for batch in batches:
        for group in text_groups(batch):
            yield group.column(0), group.column(1).fill_null("")


def _counted(orders: tuple[int, int], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, sums = Crc(), np.zeros(buckets, np.int64)
        for _, texts in _text_batches(batches):
            for _, value in features(texts, orders, crc):
                sums += np.bincount(value % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    return run


def bucket_counts(documents: DataFrame, *, text: str = "text", orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, how many features of the texts fall into it; buckets without any are left out."""
    rows = documents.select(F.lit(0).alias("carried"), F.col(text).alias("text"))
    return rows.mapInArrow(_counted(orders, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket the thousandths of the log-ratio of the target's smoothed share to the corpus's, floored.

    The driver reads a number for each bucket: their size is that parameter, not the data's.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for table, into in ((corpus, s), (target, t)):
        for bucket, n in table.select("bucket", "n").collect():
            into[bucket] = n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weighed(orders: tuple[int, int], gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = Crc()
        for carried, texts in _text_batches(batches):
            words, many, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for row, value in features(texts, orders, crc, words):
                first, length = runs(row)
                many[row[first]] += length
                total[row[first]] += np.add.reduceat(gains[value % np.uint32(len(gains))], first)
            weight = total // np.maximum(many, 1)
            yield pa.RecordBatch.from_arrays([carried, *map(pa.array, (words, many, weight))], names=["carried", "n_words", "n_features", "weight"])

    return run


def importance_scores(documents: DataFrame, target: DataFrame, *, text: str = "text", target_text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = (), orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, the carried columns, n_words, n_features, weight and score of every document."""
    same = dict(orders=orders, buckets=buckets)
    gains = bucket_gains(bucket_counts(documents, text=text, **same), bucket_counts(target, text=target_text, **same), buckets)
    rows = documents.select(F.struct(F.col(doc_id).alias("id"), F.struct(F.lit(0).alias("none"), *[F.col(c) for c in carry]).alias("more")).alias("carried"), F.col(text).alias("text"))
    kind = rows.schema["carried"].dataType.simpleString()
    out = rows.mapInArrow(_weighed(orders, gains), f"carried {kind}, n_words long, n_features long, weight long")
    score = F.col("weight") + _gumbel(F.col("carried.id"), seed)
    return out.select(F.col("carried.id").alias(doc_id), *[F.col("carried.more")[c].alias(c) for c in carry], "n_words", "n_features", "weight", score.alias("score"))


def _gumbel(doc_id: Column, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, doc_id: str = "doc_id") -> DataFrame:
    """The rows with their rank in the draw, null if not drawn: of those with enough words so many percent, rounded down, by score, then id.

    Rows are kept once in the shared folder, as the histogram, the numbering and the result must see the same ones.
    """
    rows = scored.select(F.struct(*[F.col(f"`{c}`") for c in scored.columns]).alias("row"), F.col(doc_id).alias("id"), "score", (F.col("n_words") >= least_words).alias("enough"))
    rows = checkpointed(rows.withColumns({"band": F.expr(f"score div {BAND}"), "number": F.monotonically_increasing_id()}))
    held = sorted(((r["band"], r["count"]) for r in rows.where("enough").groupBy("band").count().collect()), reverse=True)
    take, above, lowest = percent * sum(n for _, n in held) // 100, 0, None
    for lowest, n in held:
        above += n
        if above >= take:
            break
    top = F.col("enough") & (F.col("band") >= lowest) if take else F.lit(False)
    order = (F.desc("score"), F.asc_nulls_last("id"), F.col("number"))
    numbered = ranked(rows.where(top).withColumn("all", F.lit(0)), "rank", *order, group="all")
    drawn = numbered.select("row.*", F.when(F.col("rank") <= take, F.col("rank")).cast("long").alias("rank"))
    return drawn.unionByName(rows.where(~top).select("row.*", F.lit(None).cast("long").alias("rank")))


def resample(documents: DataFrame, target: DataFrame, *, text: str = "text", target_text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = (), orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document's doc_id, the carried columns, n_words, n_features, weight, score, and rank where it is drawn."""
    scored = importance_scores(documents, target, text=text, target_text=target_text, doc_id=doc_id, carry=carry, orders=orders, buckets=buckets, seed=seed)
    return draw(scored, percent=percent, least_words=least_words, doc_id=doc_id)
