"""Which 64-bit tokens of a corpus occur under more than one owner, found with one packed shuffle.

Every owner (a document class) brings an array of tokens. A token goes to the part that its upper
bits name, in blocks of packed arrays instead of rows, so that a token costs little more than its own bytes. A
part sorts what it gets; tokens that only one owner has end there. The others go back to their owners.

A token that very many owners of one map task share, a line of boilerplate, would gather them all in its part. Such a
token is settled in the map task: its owners go ahead in blocks that need no sorting together, and its part is only told.
It counts as FREQUENT under every owner, those of other tasks included, so that all order it alike.

Rows that belong to no token may travel along as `notes`; they come out as they went in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from netsift.llm.common import joined, mix, pack, runs, unpack

#: Tokens that a map task holds before it hands its blocks on, and owners of one token among them from which it is hot.
FLUSH_TOKENS, HOT_IN_FLUSH = 1_000_000, 500
#: The number of owners that is stored for a token with so many or more, and for hot ones.
FREQUENT = 65_535
BLOCKS = "part int, payload binary"


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in rows], pa.int32()), "payload": pa.array([x for _, x in rows], pa.binary())})


class Blocks:
    """Gathers (owner, weight, tokens) in a map task and hands out one packed block for each part.

    Parts from `parts` on hold settled tokens, those from 2 `parts` on notes.
    """

    def __init__(self, parts: int) -> None:
        self.parts = parts
        self.clear()

    def clear(self) -> None:
        self.owners, self.sizes, self.counts, self.tokens, self.held = [], [], [], [], 0
        self.notes: list[tuple[np.ndarray, ...]] = []

    def add(self, owner: int, size: int, tokens: np.ndarray) -> None:
        self.owners.append(owner)
        self.sizes.append(size)
        self.counts.append(len(tokens))
        self.tokens.append(tokens)
        self.held += len(tokens)

    def note(self, *arrays: np.ndarray) -> None:
        self.notes.append(arrays)

    def full(self) -> bool:
        return self.held >= FLUSH_TOKENS

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.notes:
            arrays = [np.concatenate(x) for x in zip(*self.notes, strict=True)]
            for s in range(0, len(arrays[0]), 50_000):
                some = [a[s : s + 50_000] for a in arrays]
                yield _batch([(2 * self.parts + int(mix(some[0][:1].view(np.uint64))[0] % np.uint64(self.parts)), pack(*some))])
        if not self.owners:
            self.clear()
            return
        tokens = np.concatenate(self.tokens)
        owner = np.repeat(np.arange(len(self.owners), dtype=np.uint32), self.counts)
        owners, sizes = np.array(self.owners, np.uint64), np.array(self.sizes, np.uint32)
        self.clear()
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order]
        at, length = runs(tokens)
        hot = np.repeat(length > HOT_IN_FLUSH, length)
        told = tokens[at[length > HOT_IN_FLUSH]]
        if len(told):
            o, t = owner[hot], tokens[hot]
            for part, some in _dealt(((mix(owners[o]) >> np.uint64(40)) % np.uint64(self.parts)).astype(np.int32) + self.parts):
                yield _batch([(part, self._block(owners, sizes, o[some], _whole(*_short(t[some]), part_of(t[some], self.parts), self.parts)))])
            tokens, owner = tokens[~hot], owner[~hot]
        tell = dict(_dealt(part_of(told, self.parts)))
        seen = set()
        for part, some in _dealt(part_of(tokens, self.parts)):
            seen.add(part)
            yield _batch([(part, self._block(owners, sizes, owner[some], tokens[some], told[tell.get(part, slice(0, 0))]))])
        for part in tell.keys() - seen:
            yield _batch([(part, self._block(owners, sizes, owner[:0], tokens[:0], told[tell[part]]))])

    @staticmethod
    def _block(owners: np.ndarray, sizes: np.ndarray, owner: np.ndarray, tokens: np.ndarray, told: np.ndarray | None = None) -> bytes:
        order = np.argsort(owner, kind="stable")
        owner, tokens = owner[order], tokens[order]
        first, count = runs(owner)
        return pack(owners[owner[first]], sizes[owner[first]], count.astype(np.uint32), *((tokens,) if told is None else (*_short(tokens), *_short(told))))


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part and the places that name it."""
    order = np.argsort(part, kind="stable")
    for s, n in zip(*runs(part[order]), strict=True):
        yield int(part[order[s]]), order[s : s + n]


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    """The part of each token, from its upper 24 bits."""
    return (((tokens >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int32)


def _short(tokens: np.ndarray) -> tuple[np.ndarray, ...]:
    """The lower 56 bits of tokens, as 4, 2 and 1 bytes."""
    return tokens.astype(np.uint32), (tokens >> np.uint64(32)).astype(np.uint16), (tokens >> np.uint64(48)).astype(np.uint8)


def _whole(low: np.ndarray, middle: np.ndarray, high: np.ndarray, part: np.ndarray | int, parts: int) -> np.ndarray:
    """The tokens of a part: it stands for their upper bits, all 8 of them from 256 parts on."""
    out = low.astype(np.uint64) | middle.astype(np.uint64) << np.uint64(32) | high.astype(np.uint64) << np.uint64(48)
    top = np.asarray(part, np.int64)
    top = top if parts <= 256 else ((top << 24) // parts) >> 16
    return out | top.astype(np.uint64) << np.uint64(56)


def shared_tokens(parts: int, back: int):
    """A function for applyInArrow by part: blocks of owners with those tokens that two owners or more have, each with
    the number of its owners; and the notes.

    An owner may come from several map tasks; it counts once. Blocks go to `back` parts by owner, notes to parts from
    `back` on.
    """

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        payloads, part = table.column("payload").to_pylist(), key[0].as_py()
        if part >= 2 * parts:
            return pa.table({"part": pa.array([back + part - 2 * parts] * len(payloads), pa.int32()), "payload": pa.array(payloads, pa.binary())})
        owners, sizes, counts, *tokens = joined(payloads)
        del payloads
        token, told = (tokens[0], None) if part >= parts else (_whole(*tokens[:3], part, parts), _whole(*tokens[3:], part, parts))
        del tokens
        names, first, who = np.unique(owners, return_index=True, return_inverse=True)
        sizes, who = sizes[first], np.repeat(who.astype(np.int32), counts)
        if part >= parts:
            # the tokens of an owner that several tasks settled stand once
            pair = np.lexsort((token, who))
            token, who = token[pair], who[pair]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (who[1:] != who[:-1])
            token, who = token[new], who[new]
            df = np.full(len(token), FREQUENT, np.uint16)
        else:
            order = np.lexsort((who, token))
            token, who = token[order], who[order]
            del order
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (who[1:] != who[:-1])
            token, who = token[new], who[new]
            s, n = runs(token)
            hot = np.isin(token[s], told)
            df = np.repeat(np.where(hot, FREQUENT, np.minimum(n, FREQUENT)), n).astype(np.uint16)
            keep = df >= 2
            token, who, df = token[keep], who[keep], df[keep]
        to = (names % np.uint64(back)).astype(np.int32)[who]
        order = np.lexsort((who, to))
        token, who, df, to = token[order], who[order], df[order], to[order]
        out_part, out = [], []
        for s, n in zip(*runs(to), strict=True):
            w = who[s : s + n]
            f, c = runs(w)
            out_part.append(int(to[s]))
            out.append(pack(names[w[f]], sizes[w[f]], c.astype(np.uint32), token[s : s + n], df[s : s + n]))
        return pa.table({"part": pa.array(out_part, pa.int32()), "payload": pa.array(out, pa.binary())})

    return apply


def notes(payloads: list[bytes]) -> list[list[np.ndarray]]:
    """The arrays of each payload of notes."""
    return [unpack(x) for x in payloads]


