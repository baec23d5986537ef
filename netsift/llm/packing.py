"""Packing of tokenised documents into sequences of bounded length.

Method: bounded-space online best-fit. A task keeps a fixed number of open bins, found through a bitset keyed by free
space: the lowest set bit at or above a piece's length is the fullest bin that takes it. When one bin too many is
open, the fullest closes. Pieces come in the order of a hash of their document's id, in tasks of about PER_TASK pieces, so that
the bins left open at the end of a task are few beside those it closed. Long documents make more pieces, hence more tasks.

A document's ids are those of the tokenizer for its whole text, then END. Only documents longer than a sequence are
cut, into full pieces and a last one. Null text counts as empty: one piece that holds END alone. Repeated rows are
packed as often as they stand; rows with equal ids are one document to no one but the reader. Columns named by `carry`
follow the pieces, others are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import spans, text_groups

LENGTH, END = 2048, 0
OPEN_BINS = 256
PER_TASK = 100_000
#: By which the pieces of long documents are estimated, for the number of tasks only.
BYTES_PER_ID = 4
#: Distinct words whose ids a Python worker remembers, but for those of one batch.
WORD_CACHE = 400_000
WORD_END = "</w>"
# fixed values: the rules of a tokenizer's file under which words can be told apart as WORD does
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
# fixed values: how these rules split lower-cased text, for the characters that OTHER leaves
WORD = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ÿ0-9]+")
OTHER = re.compile(r"[^\n -;=-~À-ÖØ-öø-ÿ]")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


class _Numbered(dict):
    """Words by number in the order they come; `new` are those without ids so far."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordIds:
    """Token ids of texts, by the ids of the words that the tokenizer splits them into.

    Where the tokenizer's file says what RULES says, it works word by word, and the last token of a word, and no other,
    ends in the word-end mark. Words recur, and each is given to the tokenizer once, many in one text. Texts with characters
    outside ASCII and the Latin-1 letters, or with a `<`, which may begin a special token, go to the tokenizer as
    they are; so do all texts where the file has other rules.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        self.by_word = all(said[k] == v for k, v in RULES.items()) and said["model"]["end_of_word_suffix"] == WORD_END and all(t["content"].startswith("<") for t in said["added_tokens"])
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.known = _Numbered()
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        words, self.known.new = self.known.new, []
        sizes, ids_of = [self.sizes], [self.flat]
        joined = [words[i : i + 500] for i in range(0, len(words), 500)]
        for some, ids in zip(joined, self._ids([" ".join(x) for x in joined]), strict=True):
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(some):
                sizes.append(np.diff(last, prepend=-1))
                ids_of.append(ids)
            else:
                each = self._ids(some)
                sizes.append(np.array([len(x) for x in each], np.int64))
                ids_of += each
        self.sizes, self.flat = np.concatenate(sizes), np.concatenate(ids_of)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > WORD_CACHE:
            self.known.clear()
            self.sizes, self.flat = self.sizes[:0], self.flat[:0]
        get, places, whole = self.known.__getitem__, {}, []
        for i, t in enumerate(texts):
            if not self.by_word or OTHER.search(t):
                whole.append(i)
            else:
                part = WORD.findall(t.lower())
                places[i] = np.fromiter(map(get, part), np.int64, len(part))
        if self.known.new:
            self._learn()
        begin = np.cumsum(self.sizes) - self.sizes
        direct = dict(zip(whole, self._ids([texts[i] for i in whole]), strict=True)) if whole else {}
        return [direct[i] if i in direct else self.flat[spans(begin[places[i]], self.sizes[places[i]])] for i in range(len(texts))]


@functools.cache
def word_ids(path: str) -> WordIds:
    """One memory of words for all tasks of a Python worker."""
    return WordIds(path)


def _pieces(path: str, length: int, end: int, carry: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            for group in text_groups(batch, limit=500_000):
                out, row = [], []
                ids_of = words.encode([t or "" for t in group.column(1).to_pylist()])
                for i, (doc, ids) in enumerate(zip(group.column(0).to_pylist(), ids_of, strict=True)):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), length)):
                        piece = ids[start : start + length]
                        row.append(i)
                        out.append((doc, k, start, len(piece), zlib.crc32(piece.tobytes())))
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)]
                columns += [group.column(2 + k).take(pa.array(row, pa.int64())) for k in range(len(carry))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *carry])

    return run


class Bins:
    """Open bins by free space; numbers of closed ones are never given out again."""

    def __init__(self, length: int, open_bins: int) -> None:
        self.length, self.most = length, open_bins
        self.free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits = 0
        self.count = self.next = 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of that size."""
        fitting = self.bits >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.length, self.next
            self.next += 1
        rest = space - size
        if rest:
            self.free[rest].append(number)
            self.bits |= 1 << rest
            self.count += 1
            if self.count > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.length - space

    def _take(self, space: int) -> int:
        number = self.free[space].pop()
        if not self.free[space]:
            self.bits ^= 1 << space
        self.count -= 1
        return number


def _place(length: int, open_bins: int, carry: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = Bins(length, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array([base + number for number, _ in placed], pa.int64()), pa.array([offset for _, offset in placed], pa.int64())]
            columns += [batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *carry])

    return run


def pack_documents(
    documents: DataFrame, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, end: int = END, open_bins: int = OPEN_BINS, per_task: int = PER_TASK, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per piece: where it comes from, its checksum, its place in a sequence, and the carried columns of its document."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *carry)
    more = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    tasks = max(1, round((size["n"] + size["bytes"] / BYTES_PER_ID / length) / per_task))
    pieces = rows.mapInArrow(_pieces(tokenizer, length, end, carry), PIECES + more)
    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "start")).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(_place(length, open_bins, carry), PLACED + more)
