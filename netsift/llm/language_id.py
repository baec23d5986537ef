"""Language of whole texts by multinomial naive Bayes over hashed character n-grams.

The counts of all labelled rows, or of a sample if one is asked for, are gathered by Spark; the matrix of log-probabilities, languages x
BUCKETS numbers whatever the corpus, is broadcast. Batches of texts become sparse counts, how often each n-gram bucket
occurs in each text, and these times the rows of the matrix are added up by text.

A prediction rests on the text alone. Null text and text without a letter (Unicode category L) give `und` with
score 0. Rows with a null label or null text are not learned from. Ties go to the language first in order. A very long text is
counted in chunks, so that memory follows neither its length nor the number of languages.
Without any labelled row everything is `und`. Repeated rows count as often as they stand; repeated ids are thinned
together. Other columns are ignored. An empty table gives an empty result, and a model of nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import mix, runs, text_groups

ORDERS = (1, 2, 3)
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: A sample of labelled rows is thinned by a hash of their id, to the same number of each label, but to no fewer of a
#: label than this.
LEAST_ROWS = 500
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Characters that are counted at once, and numbers of the matrix that are taken at once.
CHUNK, TAKEN = 500_000, 2_000_000


def _chunks(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Numbers of texts, strings of them of bounded total length, and at how many places of each n-grams may begin."""
    numbers, strings, places, held = [], [], [], 0
    for number, text in enumerate(texts):
        for begin in range(0, len(text), CHUNK):
            some = text[begin : begin + CHUNK + ORDERS[-1] - 1]
            if numbers and (held + len(some) > CHUNK or len(numbers) >> (32 - BUCKET_BITS)):
                yield numbers, strings, places
                numbers, strings, places, held = [], [], [], 0
            numbers.append(number)
            strings.append(some)
            places.append(min(CHUNK, len(text) - begin))
            held += len(some)
    if numbers:
        yield numbers, strings, places


def sparse_counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, bucket and count of the n-grams of the texts, each sorted by text; a long text may come several times."""
    for numbers, strings, places in _chunks(texts):
        points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        length = np.array([len(x) for x in strings], np.int64)
        string = np.repeat(np.arange(len(strings), dtype=np.uint32) << np.uint32(BUCKET_BITS), length)
        # places from here on to the end of their string, and to where n-grams may begin
        left = np.repeat(np.cumsum(length), length) - np.arange(len(points))
        last = np.repeat(length - np.array(places, np.int64), length)
        keys = []
        for n in ORDERS:
            value = np.full(max(0, len(points) - n + 1), n, np.uint64)
            for i in range(n if len(value) else 0):
                value *= np.uint64(0x100000001B3)
                value += points[i : i + len(value)]
            bucket = (mix(value) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32)
            keys.append((string[: len(value)] | bucket)[left[: len(value)] >= np.maximum(n, last[: len(value)] + 1)])
        key = np.sort(np.concatenate(keys))
        first, count = runs(key)
        pair = key[first]
        yield np.array(numbers)[pair >> np.uint32(BUCKET_BITS)], (pair & np.uint32(BUCKETS - 1)).astype(np.int64), count


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for group in text_groups(batch):
            names, labels = np.unique(np.array(group.column(0).to_pylist(), object), return_inverse=True)
            for text, bucket, n in sparse_counts([t.lower() for t in group.column(1).to_pylist()]):
                for k, name in enumerate(names):
                    mine = labels[text] == k
                    sums = total.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums += np.bincount(bucket[mine], n[mine], BUCKETS).astype(np.int64)
    for label, sums in total.items():
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(at)), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(sums[at])})


class Model:
    """Languages, and for each n-gram bucket their log-probabilities less the mean over languages."""

    def __init__(self, languages: list[str], rows: np.ndarray, prior: np.ndarray) -> None:
        self.languages, self.rows, self.prior = languages, rows, prior

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The most probable language of each text and its probability."""
        total, step = np.tile(self.prior, (len(texts), 1)), max(1, TAKEN // len(self.languages))
        for text, bucket, n in sparse_counts([t.lower() for t in texts]):
            for s in range(0, len(text), step):
                some = text[s : s + step]
                first, _ = runs(some)
                total[some[first]] += np.add.reduceat(self.rows[bucket[s : s + step]] * n[s : s + step, None].astype(np.float32), first, axis=0, dtype=np.float64)
        best = total.argmax(axis=1)
        total -= total.max(axis=1, keepdims=True)
        return [self.languages[i] for i in best], 1 / np.exp(total).sum(axis=1)


def train(labelled: DataFrame, *, text: str = "text", label: str = "lang", doc_id: str = "doc_id", sample_rows: int | None = None) -> Model | None:
    """A model from all labelled rows, None without any; the shares of the labels are the prior.

    With sample_rows from about so many, or all if there are fewer: each label keeps up to an equal share of the
    sample, or LEAST_ROWS if that is more.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).withColumn(label, F.col(label).cast("string"))
    sizes = dict(rows.groupBy(label).count().collect())
    if not sizes:
        return None
    languages = sorted(sizes)
    most = max(sizes.values()) if sample_rows is None else max(LEAST_ROWS, sample_rows // len(sizes))
    if any(n > most for n in sizes.values()):
        whole = 1 << 30
        share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(whole, whole * most // n))])
        rows = rows.where(F.pmod(F.xxhash64(doc_id), F.lit(whole)) < F.element_at(share, F.col(label)))
    counts = rows.select(F.col(label).alias("label"), F.col(text).alias("text")).mapInArrow(_counts, "label string, bucket int, n long")
    table = counts.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    labels, bucket, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("label", "bucket", "n"))
    matrix = np.ones((BUCKETS, len(languages)))
    matrix[bucket, np.searchsorted(np.array(languages, object), labels)] += n
    logs = np.log(matrix / matrix.sum(axis=0))
    prior = np.log(np.array([sizes[x] for x in languages], float) / sum(sizes.values()))
    return Model(languages, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32), prior)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in text_groups(batch):
                texts = group.column(1).to_pylist()
                named, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                at = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
                if model is not None and at:
                    languages, score[at] = model.value.score([texts[i] for i in at])
                    for i, language in zip(at, languages, strict=True):
                        named[i] = language
                yield pa.RecordBatch.from_arrays([group.column(0), pa.array(named, pa.string()), pa.array(score)], names=["carried", "lang_pred", "score"])

    return run


def predict(documents: DataFrame, model: Model | None, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred and score."""
    rows = documents.select(F.struct(*[F.col(c) for c in carry]).alias("carried"), F.col(text).alias("text"))
    sent = None if model is None else documents.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["carried"].dataType.simpleString()
    out = rows.mapInArrow(_predict(sent), f"carried {kind}, lang_pred string, score double")
    return out.select(*[F.col("carried")[c].alias(c) for c in carry], "lang_pred", "score")


def _known(model, text: int, label: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in text_groups(batch, text):
                texts = group.column(text).to_pylist()
                at = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model is not None else []
                kept = group.take(pa.array(at, pa.int64()))
                told = pa.array(model.value.score([texts[i] for i in at])[0] if at else [], kept.schema.field(label).type)
                yield kept.set_column(label, kept.schema.field(label), told)

    return run


def in_known_language(documents: DataFrame, model: Model | None, *, text: str = "text", label: str = "lang") -> DataFrame:
    """The documents, whole rows, that `predict` doesn't call `und`; their label becomes the language that it tells from the
    text. Labels are only what the model learned from: rows without one get theirs, and a wrong one does not stay."""
    sent = None if model is None else documents.sparkSession.sparkContext.broadcast(model)
    return documents.mapInArrow(_known(sent, documents.columns.index(text), documents.columns.index(label)), documents.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(documents: DataFrame, *, text: str = "text", label: str = "lang", doc_id: str = "doc_id", sample_rows: int | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those that are not held out."""
    model = train(documents.where(~held_out(doc_id)), text=text, label=label, doc_id=doc_id, sample_rows=sample_rows)
    out = predict(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
