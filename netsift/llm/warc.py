"""Web pages as WARC archives, and the records of archives read back from their segments.

Writing: each page becomes an HTTP response whose body is framed in chunks. Of pages with equal payloads of at
least `least` bytes the one with the largest id is the response; the others become revisit records that name it. A block
longer than `segment` bytes is written as a first record and continuation records, linked by WARC-Segment-Origin-ID.
A revisit names the response's address and date (WARC-Refers-To-Target-URI, WARC-Refers-To-Date) and, in a field of ours,
its page. Archives are plain WARC/1.1 files, gzipped by Spark's text writer, of at most `per_file` records; the first file
of each task begins with a warcinfo record.

Reading: archives are taken apart by Content-Length alone. A record in one piece is
checked and decoded where it is read. Continuation records are grouped by the identifier of
their origin, ordered by segment number, and streamed through one task per group in order; the length must equal
WARC-Segment-Total-Length, the numbers must have no gap, and the chunked framing is decoded along the way.

Archives of others are read as well, gzipped (a member for the file or for each record) or not. Where a record states no payload digest, or one of another algorithm, none is compared;
a revisit without a digest has a null one, and one without our fields null bytes, page_id and refers_to. A response that is no
HTTP message is its own payload. Records of other kinds are passed over. A record whose segment number is no number from 1 on, or that has
segments and no id to find them by, counts as one in one piece. A file that is no WARC archive, a record
without Content-Length, segments with a gap and a payload that isn't whole or has another SHA-1 than stated are errors, which name the file or the record.

Null html counts as empty, an empty payload has the digest of nothing. Pages with equal ids and payloads are records
of their own, responses all if the id is the largest. Pages with a null id are written and come back with a null id;
equal payloads under null ids alone are all responses. Other columns are ignored. No pages give no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm.common import shuffle_parts

SEGMENT, CHUNK, PER_FILE = 64 << 10, 16 << 10, 2_000
LINE = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for i in range(0, len(body), size) if (part := body[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the last of its two closing line ends, which the text writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + LINE


DATE = "2000-01-01T00:00:00Z"


def _uri(url: str | None) -> str:
    return (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")


def warcinfo(place: str) -> bytes:
    block = b"software: netsift\r\nformat: WARC File Format 1.1\r\n"
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place} warcinfo')}>"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], block)


def page_records(place: str, page: int | None, url: str | None, html: str | None, refers_to: int | None, refers_to_url: str | None, revisit: bool, segment: int) -> Iterator[bytes]:
    """The records of one page; its place among all pages makes their identifiers."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    uri = _uri(url)
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place} {page} {uri}')}>"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: %d\r\nTransfer-Encoding: chunked\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Target-URI", uri), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Page-ID", "" if page is None else page), ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _uri(refers_to_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", "" if refers_to is None else refers_to)]
        yield _record(fields, head)
        return
    block = head + chunked(payload)
    if len(block) <= segment:
        yield _record(fields, block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield _record([*fields, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {k}')}>"), ("WARC-Target-URI", uri), ("WARC-Date", DATE)]
        more += [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k)]
        if k == len(parts):
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(more, part)


def _written(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not count and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([warcinfo(str(task))], pa.binary())], names=["record"])
            for row in range(batch.num_rows):
                count += 1
                values = [c[row].as_py() for c in batch.columns]
                records = list(page_records(f"{task} {count}", *values, segment))
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    return run


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    """Archives of all pages in a folder that any reader of Spark's file systems reaches."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(body).alias("sha1"), F.length(body).alias("size"))
    first = rows.where(F.col("size") >= least).groupBy("sha1").agg(F.max("page").alias("of"), F.max_by("url", "page").alias("of_url"), F.count("*").alias("n"))
    roles = rows.join(first.where("n > 1"), "sha1", "left")
    revisit = F.col("n").isNotNull() & ~F.col("page").eqNullSafe(F.col("of"))
    roles = roles.select("page", "url", "html", F.when(revisit, F.col("of")).alias("refers_to"), F.when(revisit, F.col("of_url")).alias("refers_to_url"), revisit.alias("revisit"))
    records = roles.mapInArrow(_written(segment), "record binary")
    # the writer takes the bytes of a string as they are
    text = records.select(F.expr("cast(record as string)").alias("value"))
    text.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


class _Stream:
    """Bytes of an archive, gzipped or not, as far as they are asked for."""

    def __init__(self, data: bytes) -> None:
        self.plain = not data.startswith(b"\x1f\x8b")
        self.data, self.at, self.gone, self.out, self.open = data, 0, 0, bytearray(), zlib.decompressobj(31)

    def fill(self, n: int) -> bool:
        while len(self.out) < n:
            if self.plain:
                step = self.data[self.at : self.at + max(n - len(self.out), 1 << 18)]
                self.at += len(step)
                self.out += step
                if not step:
                    return False
                continue
            if self.open.eof:
                rest = self.open.unused_data or self.data[self.at :]
                if not rest.strip(b"\0"):
                    return False
                self.at, self.open = len(self.data) - len(rest) if self.open.unused_data else self.at, zlib.decompressobj(31)
            elif self.at >= len(self.data):
                return False
            step = self.data[self.at : self.at + (1 << 18)]
            self.at += len(step)
            self.out += self.open.decompress(step)
            if self.open.eof and self.open.unused_data:
                self.at -= len(self.open.unused_data)
        return True

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("an archive ends within a record")
        part = bytes(self.out[:n])
        del self.out[:n]
        return part

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, and the mark; None at the end."""
        seen = 0
        while (found := self.out.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.out)
            if not self.fill(seen + 1):
                if self.out.strip():
                    raise ValueError("an archive ends within a header")
                return None
        return self.take(found + len(mark))


def archive_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case names, and block of each record of an archive."""
    stream = _Stream(data)
    while (head := stream.until(LINE + LINE)) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"a record without a Content-Length: {fields.get('warc-record-id')}")
        yield fields, stream.take(int(fields["content-length"]))
        if stream.take(4) != LINE + LINE:
            raise ValueError("a record is not closed by two line ends")


RAW = "origin string, number int, page_id long, kind string, digest string, refers_to long, http boolean, total long, block binary"
_NAMES = [x.split()[0] for x in RAW.split(", ")]
_KINDS = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())


def _named(path: str, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    try:
        yield from archive_records(data)
    except (ValueError, zlib.error) as error:
        raise ValueError(f"{path}: {error}") from error


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None
    for batch in batches:
        for path, data in zip(batch.column(0), batch.column(1), strict=True):
            out, size = [], 0
            for fields, block in _named(path.as_py(), data.as_py()):
                kind = fields.get("warc-type")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                told = number(fields.get("x-page-id")), kind, fields.get("warc-payload-digest"), number(fields.get("x-refers-to-page-id")), fields.get("content-type", "application/http").startswith("application/http")
                name = fields.get("warc-segment-origin-id") or fields.get("warc-record-id", "")
                nth = number(fields.get("warc-segment-number"))
                if not name or nth is None or not 0 < nth < 1 << 31:
                    page, size_of, found, kind, refers = _Origin.whole(name, told, block)
                    out.append((name, 0, page, kind, found, refers, None, size_of, None))
                    continue
                out.append((name, nth, *told, number(fields.get("warc-segment-total-length")), block))
                size += len(block)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)


class Payload:
    """Length and digest of an HTTP response's payload that comes in pieces, out of its chunks."""

    def __init__(self, http: bool = True) -> None:
        self.rest, self.state, self.left, self.bytes, self.stated, self.sha = b"", "head" if http else "plain", 0, 0, None, hashlib.sha1()
        self.chunked = False

    def _body(self, part: bytes) -> None:
        self.bytes += len(part)
        self.sha.update(part)

    def add(self, part: bytes) -> None:
        data = self.rest + part
        while True:
            if self.state == "head":
                head, found, data_after = data.partition(LINE + LINE)
                if not found:
                    break
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(LINE)[1:])}
                self.stated = int(fields[b"x-payload-length"]) if b"x-payload-length" in fields else None
                self.chunked = fields.get(b"transfer-encoding", b"").lower() == b"chunked"
                self.state, data = "size" if self.chunked else "plain", data_after
            elif self.state == "plain":
                self._body(data)
                data = b""
                break
            elif self.state == "size":
                line, found, data_after = data.partition(LINE)
                if not found:
                    break
                self.left, data = int(line.split(b";")[0], 16), data_after
                self.state = "chunk" if self.left else "trailer"
            elif self.state == "chunk":
                self._body(data[: self.left])
                taken = min(self.left, len(data))
                self.left, data = self.left - taken, data[taken:]
                if self.left:
                    break
                self.state = "after"
            elif self.state == "after":
                if len(data) < 2:
                    break
                self.state, data = "size", data[2:]
            elif self.state == "trailer":
                if LINE not in data:
                    break
                self.state, data = "end", b""
            else:
                break
        self.rest = data

    def done(self) -> bool:
        return self.state in ("end", "plain")


PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


class _Origin:
    """A record whose segments come in order."""

    def __init__(self, row: tuple) -> None:
        self.origin, self.next, self.seen, self.total = row[0], max(1, row[1]), 0, None
        self.page, self.kind, self.stated, self.refers, http = row[2:7]
        self.payload = Payload(http)

    @classmethod
    def whole(cls, name: str, told: tuple, block: bytes) -> tuple:
        """The row of a record in one piece."""
        record = cls((name, 1, *told))
        record.add(1, len(block), block)
        return record.row()

    def add(self, number: int, total: int | None, block: bytes) -> None:
        if max(1, number) != self.next or self.kind == "continuation":
            raise ValueError(f"{self.origin}: segment {number} where {self.next} was due")
        self.next += 1
        self.seen += len(block)
        self.total = total if total is not None else self.total
        self.payload.add(block)

    def row(self) -> tuple:
        if self.total != self.seen:
            raise ValueError(f"{self.origin}: {self.seen} bytes of {self.total}")
        if self.kind == "revisit":
            return self.page, self.payload.stated, self.stated.partition(":")[2] or self.stated if self.stated else None, "revisit", self.refers
        found = base64.b32encode(self.payload.sha.digest()).decode()
        kind, _, stated = (self.stated or "").partition(":")
        if not self.payload.done() or (kind.lower() == "sha1" and stated.upper() != found):
            raise ValueError(f"{self.origin}: the payload is not whole")
        return self.page, self.payload.bytes, found, "response", None


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), PAGE, strict=True)], schema=PAGE)

    at = None
    for batch in batches:
        done = []
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in batch.columns)
            if at is not None and row[0] != at.origin:
                done.append(at.row())
                at = None
            if row[8] is None:  # a record in one piece, read already
                done.append((row[2], row[7], row[4], row[3], row[5]))
                continue
            if at is None:
                at = _Origin(row)
            at.add(row[1], row[7], row[8])
        if done:
            yield rows(done)
    if at is not None:
        yield rows([at.row()])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record in a folder of archives."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    segments = files.mapInArrow(_segments, RAW)
    dealt = segments.repartition(shuffle_parts(spark), "origin").sortWithinPartitions("origin", "number")
    return dealt.mapInArrow(_assembled, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
