"""Captures read by ranges of bytes give the frames and numbers that one reading from the begin gives."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from netsift.sources import ranges
from netsift.sources.captures import read_captures
from netsift.sources.ranges import ranges_of


def capture(seed, n, order="<", nano=False, hostile=False, tail=b""):
    """A classic capture file, and its frames. Hostile payloads look like records."""
    rnd, out, frames = random.Random(seed), [struct.pack(f"{order}IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)], []
    for k in range(n):
        size = rnd.choice([0, 14, 60, 300, 1500])
        body = bytes(rnd.randrange(256) for _ in range(size))
        if hostile and rnd.random() < 0.5:
            inner = struct.pack(f"{order}IIII", 1_700_000_000, 5, 4, 4) + b"abcd"
            body = inner * rnd.randrange(1, 60) + b"\1" * rnd.randrange(3)
        out.append(struct.pack(f"{order}IIII", 1_700_000_000 + k, (k * 7) % (10**9 if nano else 10**6), len(body), len(body) + k % 3) + body)
        frames.append(((1_700_000_000 + k) * 1_000_000 + ((k * 7) % (10**9 if nano else 10**6)) // (1000 if nano else 1), body))
    return b"".join(out) + tail, frames


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("nano", "hostile"), [(False, False), (True, False), (False, True)])
def test_ranges_agree_with_one_reading(spark, tmp_path, order, nano, hostile):
    want = {}
    for name, n, tail in (("a", 300, b""), ("b", 1, b""), ("c", 0, b""), ("cut", 200, struct.pack(f"{order}IIII", 1, 1, 5000, 5000) + b"x" * 100), ("short", 50, b"\0" * 9)):
        data, frames = capture(n, n, order, nano, hostile, tail)
        (tmp_path / f"{name}.pcap").write_bytes(data)
        want |= {(name, k): f for k, f in enumerate(frames, 1)}
    out = read_captures(spark, str(tmp_path), range_bytes=2000)
    got = {(r.path.rsplit("/", 1)[1].removesuffix(".pcap"), r.packet_number): (r.us, bytes(r.frame)) for r in out.collect()}
    assert got == want
    assert out.select(F.spark_partition_id()).distinct().count() > 3


def test_a_wrong_guess_is_mended(spark, tmp_path):
    """A payload that is itself a long chain of records misleads the first reading, not the result."""
    inner = struct.pack("<IIII", 1_700_000_000, 5, 4, 4) + b"abcd"
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    bodies = [inner * 2000 + b"\0", b"x" * 50, inner * 1500 + b"\0\0\0"]
    for body in bodies:
        data += struct.pack("<IIII", 1_700_000_001, 9, len(body), len(body)) + body
    path = tmp_path / "a.pcap"
    path.write_bytes(data)
    with ranges.opened(str(path)) as file:
        assert ranges.Records(file, len(data)).begin(5000) < 24 + 16 + len(bodies[0])
    files = spark.createDataFrame([(str(path), len(data))], "path string, length long")
    assert sum(r.n for r in ranges_of(files, 4000).collect()) == 3
    out = sorted((r.packet_number, bytes(r.frame)) for r in read_captures(spark, str(tmp_path), 4000).collect())
    assert out == list(enumerate(bodies, 1))


def test_what_is_no_capture_is_named(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"nothing of the kind" * 9)
    with pytest.raises(Exception, match="x.pcap is no capture file"):
        read_captures(spark, str(tmp_path)).collect()


def test_a_file_in_sections_is_read_once(spark, tmp_path):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    data = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    for k in range(300):
        data += block(6, struct.pack("<IIIII", 0, 0, 1000 + k, 40, 40) + bytes([k % 256]) * 40)
    (tmp_path / "a.pcapng").write_bytes(data)
    got = sorted((r.packet_number, r.us, bytes(r.frame)) for r in read_captures(spark, str(tmp_path), 1000).collect())
    assert got == [(k + 1, 1000 + k, bytes([k % 256]) * 40) for k in range(300)]
