"""Sources and sinks of case data: packet tables, frames, feature files, evidence, case documents, outputs."""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.operators.scoring import clean_name, once
from netsift.schema import PACKETS, REVIEWS
from netsift.sources.ranges import HEAD, RANGE_BYTES, RECORD, SECTION, Records, opened, ranges_of, reachable, stream_blocks


def read_packets(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(PACKETS).format(form).load(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature file as text columns with clean names; an empty one is an error."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[clean_name(c) for c in df.columns])
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """The files under a path, those without a byte too, which Spark's file formats leave out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).inputFiles()
    parts = min(len(found), 64 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.createDataFrame([(unquote(x),) for x in found], "path string").repartition(max(1, parts), "path")


#: Bytes of a file that are hashed at once.
HASHED_AT_ONCE = 4 << 20


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, sizes, digests = batch.column(0).to_pylist(), [], []
        for path in paths:
            size, digest = 0, hashlib.sha256()
            with opened(path) as file:
                while data := file.read(HASHED_AT_ONCE):
                    size += len(data)
                    digest.update(data)
            sizes.append(size)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["path", "length", "sha256"])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of every file under a path. Files are hashed as they are read, a few megabytes at once, whatever their size;
    in a store that only Spark reads they come whole, at most 2 GB each, and those without a byte are left out."""
    files = listed_files(spark, path)
    one = files.first()
    if one is None or reachable(one["path"]):
        return files.mapInArrow(_digests, "path string, length long, sha256 string")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return whole.select("path", "length", F.sha2("content", 256).alias("sha256"))


def evidence_catalog(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """Capture files: name, size, upper-case SHA-256, and whether the extension is allowed. by_folder: a file goes by the
    value of the partition folder that it lies in."""
    name = F.element_at(F.split(F.element_at(F.split("path", "/"), -2), "="), -1) if by_folder else F.element_at(F.split("path", "/"), -1)
    return file_digests(spark, path).select(name.alias("file_name"), F.col("length").alias("file_size"), F.upper("sha256").alias("sha256"), F.lower(name).rlike(r"\.(pcap|pcapng)$").alias("allowed"))


DOCUMENT = (
    "case_id string, file_name string, sha256 string, file_size long, traffic_summary struct<total_packets: long, total_bytes: long, protocols: map<string, long>, "
    "top_source_ips: array<array<string>>, top_destination_ips: array<array<string>>>, flow_summary struct<total_flows: long>, "
    "ml_analysis struct<summary: struct<total_flows: long, benign_flows: long, threat_flows: long, threat_percentage: double>>, _corrupt_record string"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Case documents under path/<case>/: the parsed document and whether it could be read. An empty file cannot."""
    texts = spark.read.text(f"{path}/*", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    plain = F.regexp_replace("path", "^file:/*", "/")
    files = listed_files(spark, f"{path}/*").withColumn("path", plain).join(texts.withColumn("path", F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))), "path", "left").withColumn("value", F.coalesce("value", F.lit("")))
    doc = F.from_json("value", DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = files.select(F.element_at(F.split("path", "/"), -2).alias("case_id"), doc.alias("doc"), (F.trim("value") != "").alias("filled"))
    readable = F.coalesce(F.col("filled") & F.col("doc").isNotNull() & F.col("doc._corrupt_record").isNull(), F.lit(False))
    return out.select("case_id", "doc", readable.alias("readable"), F.lit(True).alias("has_document"), F.col("doc.ml_analysis.summary.total_flows").alias("total_flows"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Stored reviews by case and flow; a path that does not exist holds none."""
    try:
        stored = spark.read.schema(REVIEWS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], REVIEWS)
    return stored.orderBy("case_id", "flow_index")


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    """Global importance of features, nested per class, as rows."""
    kind = "classes map<string, array<struct<feature: string, mean_abs_shap: double, mean_signed_shap: double>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("d"))
    return doc.select(F.explode("d.classes").alias("class_name", "rows")).select("class_name", F.inline("rows"))


def write_case(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the cases in df and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON line per case."""
    reports.select("case_id", F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").partitionBy("case_id").text(path)


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").option("header", True).partitionBy("case_id").csv(path)


#: Frames of a capture file that go on in one batch, and their bytes.
FRAMES_AT_ONCE, BYTES_AT_ONCE = 10_000, 16 << 20


FRAMES = "path string, packet_number long, us long, packet_length long, link int, frame binary"


def _frame_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FRAMES.split(", ")])


def _numbered_blocks(blocks: Iterator[tuple[int, str, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """Microseconds, link type and bytes of the frames of a file in sections: enhanced and simple packet blocks."""
    interfaces: list[tuple[int, int]] = []
    for kind, order, body in blocks:
        if kind == 0:
            interfaces = []
        elif kind == 1:
            interfaces.append((struct.unpack_from(f"{order}H", body)[0], _ticks(body[8:], order)))
        elif kind == 6:
            of, high, low, kept = struct.unpack_from(f"{order}IIII", body)
            link, second = interfaces[of]
            yield (high << 32 | low) * 1_000_000 // second, link, body[20 : 20 + kept]
        elif kind == 3:  # it has no time
            yield 0, interfaces[0][0], body[4 : 4 + struct.unpack_from(f"{order}I", body)[0]]


def _ticks(options: bytes, order: str) -> int:
    """Ticks a second of an interface."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(f"{order}HH", options, at)
        if code == 9:
            value = options[at + 4]
            return 1 << (value & 127) if value & 128 else 10**value
        if code == 0:
            break
        at += 4 + -(-size // 4) * 4
    return 1_000_000


def _of_range(file, r: dict) -> Iterator[tuple[int, int, bytes]]:
    """The same of a range of records, or of a whole file in sections."""
    records = Records(file, r["length"])
    if records.section and not r.get("nth"):
        yield from _numbered_blocks(stream_blocks(file, r["length"]))
    for at, seconds, part, kept in records.follow(r["start"], r["stop"]) if records.order else ():
        yield seconds * 1_000_000 + part // records.unit, records.link, records.bytes(at, RECORD + kept)[RECORD:]


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            whole = r.get("content")
            with opened(r["path"]) if whole is None else io.BytesIO(whole) as file:
                if whole is not None:
                    r |= {"length": len(whole), "start": HEAD, "stop": len(whole), "first": 0}
                    if not Records(file, len(whole)).order and whole[:4] != SECTION:
                        raise ValueError(f"{r['path']} is no capture file")
                rows, size = [], 0
                for number, (us, link, frame) in enumerate(_of_range(file, r), r["first"] + 1):
                    rows.append((r["path"], number, us, len(frame), link, frame))
                    size += len(frame)
                    if len(rows) == FRAMES_AT_ONCE or size > BYTES_AT_ONCE:
                        yield _frame_rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _frame_rows(rows)


def read_captures(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of .pcap and .pcapng files of any size. Ranges of a .pcap file are read by tasks of their own, see `ranges`.

    Files in a store that only Spark reads come whole, one task and at most 2 GB each.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][cC][aA][pP]*").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.lower("path").rlike(r"\.(pcap|pcapng)$"))
    one = files.select("path").first()
    if one is None or not reachable(one["path"]):
        return files.select("path", "content").mapInArrow(_frames, FRAMES)
    found = ranges_of(files.select("path", "length"), range_bytes)
    parts = max(1, min(found.count(), 64 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return found.repartition(parts, "path", "nth").mapInArrow(_frames, FRAMES)


def _int(frame: str, at: Column | int, n: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(F.col(frame), at + 1, F.lit(n))), 16, 10).cast("long")


def ipv6_text(groups: Column) -> Column:
    """The usual short text of eight groups in hexadecimal: the longest run of zeros, the first of several, left out."""
    dotted = lambda head: F.concat(F.lit(head), F.concat_ws(".", *[F.conv(F.substring(F.lpad(F.element_at(F.split(groups, ":"), 7 + i // 2), 4, "0"), 1 + i % 2 * 2, 2), 16, 10) for i in range(4)]))
    out = F.when(groups.rlike("^0:0:0:0:0:ffff:"), dotted("::ffff:")).when(groups.rlike("^0:0:0:0:0:0:(?!0:)"), dotted("::"))
    for run in range(8, 1, -1):
        zeros = f"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?:$|:)(.*)$"
        out = out.when(groups.rlike(zeros), F.regexp_replace(groups, zeros, "$1::$2"))
    return out.otherwise(groups)


#: IPv6 headers that may stand before the transport header, and how many are followed.
EXTENSIONS, MOST_EXTENSIONS = (0, 43, 60, 135, 139, 140), 8
LINK_ETHERNET, LINK_RAW, LINK_COOKED, LINK_NULL = 1, (12, 101, 228, 229), 113, 0


def _network(frame: str, link: Column) -> tuple[Column, Column]:
    """Where the IP header begins, past VLAN tags, and the IP version; null for what is no IP."""
    vlan = lambda at: _int(frame, at, 2).isin(0x8100, 0x88A8, 0x9100)
    tags = F.when(vlan(12) & vlan(16), 8).when(vlan(12), 4).otherwise(0)
    at = F.when(link == LINK_ETHERNET, tags + 14).when(link.isin(*LINK_RAW), 0).when(link == LINK_COOKED, 16).when(link == LINK_NULL, 4)
    kind = F.when(link == LINK_ETHERNET, _int(frame, tags + 12, 2)).when(link == LINK_COOKED, _int(frame, 14, 2))
    version = F.shiftright(_int(frame, at, 1), 4)
    named = kind.isNull() | ((kind == 0x0800) & (version == 4)) | ((kind == 0x86DD) & (version == 6))
    return at, F.when(named & version.isin(4, 6), version)


def decode_frames(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Packet columns of frames with IPv4 or IPv6, those of `schema.PACKETS` and the frames' own; other frames go, their
    numbers stay used. Of fragments only the first has ports; IPv6 extension headers are followed. Without a column
    `link` frames are Ethernet. The case is the part of the path that is a case id, else the file's folder.
    """
    link = F.coalesce("link", F.lit(LINK_ETHERNET)) if "link" in frames.columns else F.lit(LINK_ETHERNET)
    at, version = _network(frame, link)
    rows = once(frames, _ip=at, _version=version).where("_version is not null")
    ip, v4 = F.col("_ip"), F.col("_version") == 4
    header = (_int(frame, ip, 1) % 16) * 4
    later = (_int(frame, ip + 6, 2) % 8192) > 0
    start = F.struct(_int(frame, ip + 6, 1).alias("next"), (ip + 40).cast("long").alias("at"), F.lit(False).alias("later"))
    follow = lambda x, _: (
        F.when(x["next"].isin(*EXTENSIONS), F.struct(_int(frame, x["at"], 1).alias("next"), (x["at"] + (_int(frame, x["at"] + 1, 1) + 1) * 8).alias("at"), x["later"].alias("later")))
        .when((x["next"] == 44) & ~x["later"], F.struct(F.when(_int(frame, x["at"] + 2, 2) < 8, _int(frame, x["at"], 1)).otherwise(F.lit(44)).alias("next"), (x["at"] + 8).alias("at"), (_int(frame, x["at"] + 2, 2) >= 8).alias("later")))
        .otherwise(x)
    )
    six = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_EXTENSIONS)), start, follow)
    first = _int(frame, ip + 6, 1)
    four = F.struct(_int(frame, ip + 9, 1).alias("next"), (ip + header).cast("long").alias("at"), later.alias("later"))
    rows = once(rows, _t=F.when(v4, four).otherwise(six))
    octets = lambda n: F.concat_ws(".", *[_int(frame, ip + n + i, 1).cast("string") for i in range(4)])
    digits = lambda n: F.lower(F.hex(F.substring(F.col(frame), ip + n + 1, F.lit(16))))
    groups = lambda n: F.regexp_replace(F.regexp_replace(digits(n), "(.{4})(?!$)", "$1:"), "(^|:)0{1,3}", "$1")
    t, after = F.col("_t.at"), F.col("_t.next")
    ported = after.isin(6, 17) & ~F.col("_t.later") & (F.length(frame) >= t + F.when(after == 6, 20).otherwise(8))
    tcp, udp = ported & (after == 6), ported & (after == 17)
    number = F.when(tcp, 6).when(udp, 17).when(v4, after).otherwise(first).cast("int")
    bits = _int(frame, t + 13, 1)
    letters = F.concat(*[F.when(bits.bitwiseAND(1 << i) > 0, letter).otherwise("") for i, letter in enumerate("FSRPAUEC")], F.when(_int(frame, t + 12, 1) % 2 > 0, "N").otherwise(""))
    length = F.when(tcp, F.floor(_int(frame, t + 12, 1) / 16) * 4).when(udp, 8).otherwise(0)
    stated = F.when(v4, _int(frame, ip + 2, 2)).otherwise(_int(frame, ip + 4, 2) + 40)
    end = ip + F.when(stated > F.when(v4, 0).otherwise(40), stated).otherwise(F.length(frame) - ip)
    made = {"case_id", "timestamp", "source_ip"}
    case = F.coalesce(F.nullif(F.regexp_extract("path", r"/(FX-\d{8}-\d{6})/", 1), F.lit("")), F.element_at(F.split("path", "/"), -2)) if "path" in frames.columns else F.lit(None).cast("string")
    return rows.select(
        case.alias("case_id"), *[c for c in frames.columns if c not in (frame, "link", *made)], F.timestamp_micros("us").alias("timestamp"), F.when(v4, octets(12)).otherwise(ipv6_text(groups(8))).alias("source_ip"), F.when(v4, octets(16)).otherwise(ipv6_text(groups(24))).alias("destination_ip"),
        F.when(tcp, "TCP").when(udp, "UDP").otherwise("OTHER").alias("protocol"), number.alias("protocol_number"), F.when(ported, _int(frame, t, 2)).cast("int").alias("source_port"),
        F.when(ported, _int(frame, t + 2, 2)).cast("int").alias("destination_port"), F.when(tcp, letters).otherwise("").alias("tcp_flags"), length.cast("int").alias("header_length"),
        F.greatest(F.lit(0), end - t - length).cast("long").alias("payload_length"), F.when(tcp, _int(frame, t + 14, 2)).cast("int").alias("tcp_window"),
    )


def audit_files(spark: SparkSession, path: str, manifest: DataFrame, by_folder: bool = False) -> DataFrame:
    """Files against a manifest of file_name, file_size and sha256: ok, missing, size differs or hash differs."""
    have = evidence_catalog(spark, path, by_folder).select("file_name", F.col("file_size").alias("size"), F.col("sha256").alias("hash"))
    state = F.when(F.col("size").isNull(), "missing").when(F.col("size") != F.col("file_size"), "size differs")
    state = state.when(F.col("sha256").isNotNull() & (F.upper("sha256") != F.col("hash")), "hash differs").otherwise("ok")
    return manifest.join(have, "file_name", "left").select("file_name", state.alias("status"))
