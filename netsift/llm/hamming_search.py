"""Exact nearest neighbours of vectors under the Hamming distance of their binary codes.

Method: incremental multi-index hashing. Codes are cut into m segments of about log2(n) bits, n being the number of
different codes, and every segment has an index from its value to codes. All queries look up their own values and those at
distance 1 first, then the values at distance 2, 3, and so on. After radius r every code within m (r + 1) - 1 of a query has been met,
so a query is over once its kth verified distance is at most that; only the others go on to the next radius. At the
radius of a whole segment everything is covered, so each query ends by what its radius covers.

A code holds the signs of a vector's components (1 for a positive one). Equal codes form one class, named by the
code itself: it is searched for and found once, with its k smallest ids, enough for any answer.

On Spark: a segment's index is dealt by the upper bits of its values into parts of about PER_PART codes; a part
that holds more than twice that is split by a hash of the code. A query goes to the parts whose upper bits are no
farther than the radius, and looks up there what is left of it in the lower bits; parts that no query goes to are left
out of a round before its exchange. What a part verifies is cut to k
a query and to the query's kth distance so far, and a code that several segments find is reported by the one
that meets it first.

Every vector is indexed; one whose id is null can be found but asks nothing. Vectors of each
length are searched among themselves. Null or empty vectors have no code: they are neither found nor ask. Null components count as not
positive. Ties in distance go to the smaller id, null ids first, and a query finds itself. An id may stand on several
vectors: each one is found and asks on its own. Fewer than k vectors give shorter answers. Very long vectors have more
segments. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import checkpointed, spans

K = 10
#: Bytes before a code that say how many components the vector has.
LENGTH = 4
#: Codes of a part of an index, by which its upper bits are chosen.
PER_PART = 16_384
#: Names of parts, 28 bytes each, that are broadcast.
BROADCAST_PARTS = 200_000
#: Values that a task looks up at once.
AT_ONCE = 1 << 20
#: The radius up to which the first round goes; a round for radius 0 alone would cost more than it spares.
FIRST_RADIUS = 1


class Layout(NamedTuple):
    """How codes of one length are cut: where segments begin and end, and how many upper bits of them name parts."""

    edges: tuple[int, ...]
    upper: int

    @classmethod
    def of(cls, bits: int, codes: int, per_part: int) -> Layout:
        width = min(bits, max(1, round(np.log2(max(2, codes)))))
        segments = -(-bits // width)
        edges = tuple(bits * j // segments for j in range(segments + 1))
        return cls(edges, min(bits // segments, max(0, int(np.ceil(np.log2(max(1, codes) / per_part))))))

    @property
    def segments(self) -> int:
        return len(self.edges) - 1

    @property
    def width(self) -> int:
        """The widest segment's."""
        return max(b - a for a, b in zip(self.edges, self.edges[1:]))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The code of each vector, behind the number of its components; batches of one length each."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0)
        for bits in filter(None, pc.unique(sizes).to_pylist()):
            mine = batch.filter(pc.equal(sizes, bits))
            flat = mine.column(1).flatten().fill_null(0).to_numpy(zero_copy_only=False)
            packed = np.packbits(flat.reshape(-1, bits) > 0, axis=1)
            length = bits.to_bytes(LENGTH, "big")
            yield pa.RecordBatch.from_arrays(
                [mine.column(0), pa.array([bits] * len(packed), pa.int32()), pa.array([length + c.tobytes() for c in packed], pa.binary())], names=["id", "bits", "code"]
            )


def _matrix(column: pa.Array) -> np.ndarray:
    """Codes of one length as rows of bytes, filled up to whole words of 64 bits."""
    whole = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)[:, LENGTH:]
    out = np.zeros((len(whole), -(-whole.shape[1] // 8) * 8), np.uint8)
    out[:, : whole.shape[1]] = whole
    return out


def segment_values(codes: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The number that the bits begin to end - 1 of each code make."""
    bits = np.unpackbits(codes[:, begin // 8 : -(-end // 8)], axis=1)[:, begin % 8 : begin % 8 + end - begin]
    return bits @ (np.int64(1) << np.arange(end - begin - 1, -1, -1, dtype=np.int64))


def at_distance(bits: int, distance: int) -> np.ndarray:
    """All numbers of that many bits with `distance` bits set."""
    return np.array([sum(1 << b for b in some) for some in combinations(range(bits), distance)], np.int64)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    for bits in pc.unique(batch.column("bits")).to_pylist():
        yield bits, batch.filter(pc.equal(batch.column("bits"), bits))


def _indexed(layouts: dict[int, Layout]):
    """An entry for every code and segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bits, mine in _by_length(batch):
                layout, codes = layouts[bits], _matrix(mine.column("code"))
                for j, (a, b) in enumerate(zip(layout.edges, layout.edges[1:])):
                    upper = segment_values(codes, a, b) >> (b - a - layout.upper)
                    n = len(codes)
                    yield pa.RecordBatch.from_pydict({"bits": mine.column("bits"), "segment": pa.array(np.full(n, j, np.int32)), "upper": pa.array(upper), "first": mine.column("first"), "code": mine.column("code")})

    return run


def _upper_near(layout: Layout, radius: int) -> np.ndarray:
    """What the upper bits of a part within the radius may differ by."""
    return np.concatenate([at_distance(layout.upper, d) for d in range(min(radius, layout.upper) + 1)])


def _parts_within(layouts: dict[int, Layout], radius: int):
    """The parts that any query of a batch goes to, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bits, mine in _by_length(batch):
                layout, codes = layouts[bits], _matrix(mine.column("ask"))
                near = _upper_near(layout, radius)
                for j, (a, b) in enumerate(zip(layout.edges, layout.edges[1:])):
                    own = np.unique(segment_values(codes, a, b) >> (b - a - layout.upper))
                    for s in range(0, len(own), step := max(1, AT_ONCE // len(near))):
                        upper = np.unique(own[s : s + step][:, None] ^ near)
                        yield pa.RecordBatch.from_pydict({"bits": pa.array(np.full(len(upper), bits, np.int32)), "segment": pa.array(np.full(len(upper), j, np.int32)), "upper": pa.array(upper)})

    return run


def _sent(layouts: dict[int, Layout], radius: int):
    """Every query for each part whose upper bits are within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bits, mine in _by_length(batch):
                layout, codes = layouts[bits], _matrix(mine.column("ask"))
                near = _upper_near(layout, radius)
                for j, (a, b) in enumerate(zip(layout.edges, layout.edges[1:])):
                    own = segment_values(codes, a, b) >> (b - a - layout.upper)
                    for s in range(0, len(own), step := max(1, AT_ONCE // 16 // len(near))):
                        some = own[s : s + step]
                        at = pa.array(np.repeat(np.arange(s, s + len(some)), len(near)))
                        yield pa.RecordBatch.from_pydict({
                            "bits": mine.column("bits").take(at), "segment": pa.array(np.full(len(at), j, np.int32)), "upper": pa.array((some[:, None] ^ near).ravel()),
                            "ask": mine.column("ask").take(at), "bound": mine.column("bound").take(at),
                        })

    return run


def _nearest(q: np.ndarray, c: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest codes of each query, the earlier code on ties."""
    order = np.lexsort((c, d, q))
    q, c, d = q[order], c[order], d[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    keep = rank < k
    return q[keep], c[keep], d[keep]


class Part:
    """Codes with the same upper bits of a segment, found by the lower ones."""

    def __init__(self, codes: np.ndarray, layout: Layout, segment: int) -> None:
        self.codes, self.layout, self.segment = codes, layout, segment
        self.begin, self.end = layout.edges[segment : segment + 2]
        self.lower = self.end - self.begin - layout.upper
        values = segment_values(codes, self.begin, self.end)
        self.upper = int(values[0]) >> self.lower
        values &= (1 << self.lower) - 1
        self.order = np.argsort(values, kind="stable")
        # a list for each lower value: they are about as many as a part has codes
        self.counts = np.bincount(values, minlength=1 << self.lower).astype(np.int32)
        self.starts = np.cumsum(self.counts) - self.counts

    def _first_met(self, queries: np.ndarray, codes: np.ndarray, radius: int) -> np.ndarray:
        """Whether no other segment has met the pair at a smaller radius, nor an earlier one at this."""
        out = np.ones(len(queries), bool)
        apart = np.unpackbits(queries ^ codes, axis=1)
        for j, (a, b) in enumerate(zip(self.layout.edges, self.layout.edges[1:])):
            if j != self.segment:
                out &= apart[:, a:b].sum(axis=1) > radius - (j > self.segment)
        return out

    def search(self, queries: np.ndarray, bounds: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, code and distance of the k nearest codes of each query, no farther than its bound, among those that
        this segment is the first to meet, at this radius."""
        values = segment_values(queries, self.begin, self.end)
        left = radius - np.bitwise_count((values >> self.lower) ^ self.upper).astype(np.int64)
        values &= (1 << self.lower) - 1
        out = [(np.zeros(0, np.int64),) * 3]
        for rest in range(min(radius, self.lower) + 1):
            mine = np.flatnonzero(left == rest)
            masks = at_distance(self.lower, rest)
            for s in range(0, len(mine), step := max(1, AT_ONCE // len(masks))):
                some = mine[s : s + step]
                wanted = (values[some][:, None] ^ masks).ravel()
                hit = np.flatnonzero(self.counts[wanted])
                slot = wanted[hit]
                q = np.repeat(some[hit // len(masks)], self.counts[slot])
                c = self.order[spans(self.starts[slot], self.counts[slot])]
                for t in range(0, len(q), AT_ONCE):
                    a, b = q[t : t + AT_ONCE], c[t : t + AT_ONCE]
                    d = np.bitwise_count(queries.view(np.uint64)[a] ^ self.codes.view(np.uint64)[b]).sum(axis=1, dtype=np.int64)
                    near = np.flatnonzero(d <= bounds[a])
                    near = near[self._first_met(queries[a[near]], self.codes[b[near]], radius)]
                    out.append(_nearest(a[near], b[near], d[near], k))
        return _nearest(*(np.concatenate(x) for x in zip(*out, strict=True)), k)


FOUND = "ask binary, distance int, first long, found binary"


def _searched(layouts: dict[int, Layout], radii: range, k: int):
    def apply(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        bits, segment = (x.as_py() for x in key[:2])
        ask = found = distance = np.zeros(0, np.int64)
        if index.num_rows and queries.num_rows:
            # classes of null ids first, as everywhere
            index = index.take(pc.sort_indices(index, sort_keys=[("first", "ascending"), ("code", "ascending")], null_placement="at_start"))
            part = Part(_matrix(index.column("code")), layouts[bits], segment)
            codes, bounds = _matrix(queries.column("ask")), queries.column("bound").to_numpy()
            ask, found, distance = _nearest(*(np.concatenate(x) for x in zip(*(part.search(codes, bounds, r, k) for r in radii), strict=True)), k)
        return pa.table({
            "ask": queries.column("ask").take(pa.array(ask)), "distance": pa.array(distance.astype(np.int32)),
            "first": index.column("first").take(pa.array(found)), "found": index.column("code").take(pa.array(found)),
        })

    return apply


def index_parts(classes: DataFrame, layouts: dict[int, Layout], per_part: int) -> tuple[DataFrame, DataFrame]:
    """The entries of all segments by part, and how many salts each part has that needs more than one."""
    key = ["bits", "segment", "upper"]
    entries = classes.select("bits", "first", "code").mapInArrow(_indexed(layouts), "bits int, segment int, upper long, first long, code binary")
    salts = entries.groupBy(*key).count().where(F.col("count") > 2 * per_part)
    salts = checkpointed(salts.select(*key, F.ceil(F.col("count") / per_part).cast("int").alias("salts")))
    salt = F.pmod(F.xxhash64("code"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    salted = entries.join(salts, key, "left").select(*key, salt, "first", "code")
    # not dealt here: Spark forgets how a checkpoint is partitioned, so each round deals what is asked for
    return checkpointed(salted), salts


def _by_salt(rows: DataFrame, salts: DataFrame) -> DataFrame:
    """Rows of parts, once for each salt of their part."""
    key = ["bits", "segment", "upper"]
    rest = [c for c in rows.columns if c not in key]
    return rows.join(salts, key, "left").select(*key, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), *rest)


def asked_parts(index: DataFrame, salts: DataFrame, asks: DataFrame, layouts: dict[int, Layout], radius: int, most: int) -> DataFrame:
    """The entries of those parts that queries (bits, ask) go to at a radius; most: how many parts and salts there are at most.

    Up to BROADCAST_PARTS of them are broadcast, and other entries aren't even exchanged; beyond that the join is on all
    that the search groups by, so that both share one exchange."""
    parts = asks.select("bits", "ask").mapInArrow(_parts_within(layouts, radius), "bits int, segment int, upper long").distinct()
    parts = _by_salt(parts, salts)
    return index.join(F.broadcast(parts) if most <= BROADCAST_PARTS else parts, ["bits", "segment", "upper", "salt"], "left_semi")


def nearest_codes(classes: DataFrame, asks: DataFrame, k: int, *, per_part: int = PER_PART) -> DataFrame:
    """ask, distance, first and found: the k nearest classes of every code asked for."""
    # a row for each length of vectors: fewer than the longest vector has components
    codes = {r["bits"]: r["count"] for r in classes.groupBy("bits").count().collect()}
    layouts = {bits: Layout.of(bits, n, per_part) for bits, n in codes.items()}
    # a part has salts only from twice per_part on, at most one and a half for each per_part codes
    most = sum(x.segments * ((1 << x.upper) + 2 * codes[bits] // per_part) for bits, x in layouts.items())
    index, salts = index_parts(classes, layouts, per_part)
    key = ["bits", "segment", "upper"]
    cut = asks.sparkSession.createDataFrame([(b, x.segments, x.width) for b, x in layouts.items()], "bits int, segments int, width int")
    nothing = F.array().cast("array<struct<distance: int, first: bigint, found: binary>>")
    state = asks.join(F.broadcast(cut), "bits").select("bits", "segments", "width", F.col("code").alias("ask"), nothing.alias("near"))
    over, done, radius = [], -1, FIRST_RADIUS
    kth = F.when(F.size("near") >= k, F.element_at("near", F.least(F.lit(k), F.greatest(F.size("near"), F.lit(1))))["distance"])
    while True:
        sent = state.select("bits", "ask", F.coalesce(kth, "bits").alias("bound")).mapInArrow(_sent(layouts, radius), "bits int, segment int, upper long, ask binary, bound int")
        sent = _by_salt(sent, salts)
        found = asked_parts(index, salts, state, layouts, radius, most).groupBy(*key, "salt").cogroup(sent.groupBy(*key, "salt")).applyInArrow(_searched(layouts, range(done + 1, radius + 1), k), FOUND)
        order = Window.partitionBy("ask").orderBy("distance", "first", "found")
        found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
        new = found.groupBy("ask").agg(F.collect_list(F.struct("distance", "first", "found")).alias("new"))
        near = F.slice(F.sort_array(F.concat("near", F.coalesce("new", nothing))), 1, k)
        state = state.join(new, "ask", "left").select("bits", "segments", "width", "ask", near.alias("near"))
        covered = (kth <= F.col("segments") * (radius + 1) - 1) | (F.lit(radius) >= F.col("width"))
        state = checkpointed(state.withColumn("over", F.coalesce(covered, F.lit(False))))
        over.append(state.where("over").select("ask", F.inline("near")))
        state = state.where("not over").drop("over")
        if state.isEmpty():
            break
        done, radius = radius, radius + 1
    out = over[0]
    for more in over[1:]:
        out = out.unionByName(more)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, per_part: int = PER_PART) -> DataFrame:
    """query_id, rank from 1, vec_id and distance: the k nearest of all vectors for each query vector."""
    coded = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("v")).mapInArrow(_codes, "id long, bits int, code binary")
    by_code = Window.partitionBy("code").orderBy("id")
    ranked = coded(vectors).withColumn("nth", F.row_number().over(by_code)).where(F.col("nth") <= k)
    # in structs, as collect_list leaves out nulls
    classes = ranked.groupBy("bits", "code").agg(F.sort_array(F.collect_list(F.struct("id"))).alias("ids"))
    classes = checkpointed(classes.withColumn("first", F.col("ids")[0]["id"]))
    asked = coded(queries.where(F.col(vec_id).isNotNull()))
    found = nearest_codes(classes, asked.select("bits", "code").distinct(), k, per_part=per_part)
    ids = found.join(classes.select(F.col("code").alias("found"), "ids"), "found").select("ask", "distance", F.inline("ids").alias("vec_id"))
    ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return asked.join(ids.withColumnRenamed("ask", "code"), "code").select(F.col("id").alias("query_id"), "rank", "vec_id", "distance")
