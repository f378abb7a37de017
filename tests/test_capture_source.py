"""The capture data source against a sequential reader that knows nothing of ranges."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.sources import capture_source as cs


def ipv4(proto, body, src=(10, 0, 0, 1), dst=(10, 1, 0, 2), fragment=0):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, fragment, 64, proto, 0, bytes(src), bytes(dst)) + body


def ipv6(proto, body, extensions=b""):
    return struct.pack(">IHBB16s16s", 6 << 28, len(extensions) + len(body), proto, 64, bytes(15) + b"\x01", b"\xfe\x80" + bytes(13) + b"\x02") + extensions + body


def ports(a, b, more=b""):
    return struct.pack(">HHHH", a, b, 8, 0) + more


def ether(kind, body, tags=()):
    tagged = b"".join(struct.pack(">HH", t, 5) for t in tags)
    return b"\x02" * 12 + tagged + struct.pack(">H", kind) + body


V4 = ("10.0.0.1", "10.1.0.2")
V6 = ("::1", "fe80::2")
# (link type, frame, src, dst, sport, dport, protocol)
FRAMES = [
    (1, ether(0x0800, ipv4(6, ports(1000, 443) + bytes(12))), *V4, 1000, 443, "TCP"),
    (1, ether(0x0800, ipv4(17, ports(53, 5353))), *V4, 53, 5353, "UDP"),
    (1, ether(0x0800, ipv4(1, b"ping")), *V4, None, None, "1"),
    (1, ether(0x0800, ipv4(17, ports(1, 2), fragment=100)), *V4, None, None, "17"),
    (1, ether(0x0800, ipv4(6, ports(7, 8)), tags=(0x8100,)), *V4, 7, 8, "TCP"),
    (1, ether(0x86DD, ipv6(17, ports(9, 10)), tags=(0x88A8, 0x8100)), *V6, 9, 10, "UDP"),
    (1, ether(0x86DD, ipv6(0, ports(11, 12), bytes([60, 0]) + bytes(6) + bytes([6, 1]) + bytes(14))), *V6, 11, 12, "TCP"),
    (1, ether(0x86DD, ipv6(44, ports(11, 12), bytes([6, 0, 1, 0]) + bytes(4))), *V6, None, None, "6"),
    (1, ether(0x0806, bytes(28)), None, None, None, None, None),
    (1, b"\x01\x02\x03", None, None, None, None, None),
    (1, b"", None, None, None, None, None),
    (0, struct.pack("<I", 2) + ipv4(6, ports(13, 14)), *V4, 13, 14, "TCP"),
    (101, ipv4(17, ports(15, 16)), *V4, 15, 16, "UDP"),
    (229, ipv6(6, ports(17, 18)), *V6, 17, 18, "TCP"),
    (113, bytes(14) + struct.pack(">H", 0x0800) + ipv4(6, ports(19, 20)), *V4, 19, 20, "TCP"),
    (276, struct.pack(">H", 0x86DD) + bytes(18) + ipv6(17, ports(21, 22)), *V6, 21, 22, "UDP"),
    (147, ipv4(17, ports(15, 16)), None, None, None, None, None),
]


def pcap(frames, order="<", nano=False, link=1, snap=65535):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = [struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, snap, link)]
    for i, frame in enumerate(frames):
        kept = frame[:snap]
        out.append(struct.pack(order + "IIII", 1_700_000_000 + i // 1000, i % 1000, len(kept), len(frame)) + kept)
    return b"".join(out)


def block(kind, body, order="<"):
    body += bytes(-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def pcapng(frames, order="<"):
    """Two sections; an interface for each link type, described just before its first packet, every third with nanoseconds."""
    out = []
    for section in range(2):
        out.append(block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order))
        known = {}
        for i, (link, frame) in enumerate(frames[section::2]):
            nano = link % 3 == 0
            if link not in known:
                known[link] = len(known)
                option = struct.pack(order + "HHB3xHH", 9, 1, 9, 0, 0) if nano else b""
                out += [block(1, struct.pack(order + "HHI", link, 0, 0) + option, order), block(5, bytes(12), order)]
            t = (1_700_000_000 + i) * (10**9 if nano else 10**6)
            out.append(block(6, struct.pack(order + "IIIII", known[link], t >> 32, t & 0xFFFFFFFF, len(frame), len(frame)) + frame, order))
    return b"".join(out)


def read(spark, path, piece=1 << 23, **options):
    spark.dataSource.register(cs.CaptureSource)
    return spark.read.format("capture").option("rangeBytes", piece).options(**options).load(str(path))


FIELDS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


@pytest.mark.parametrize("order", ["<", ">"])
def test_layers_of_block_files(spark, tmp_path, order):
    (tmp_path / "a.pcapng").write_bytes(pcapng([(f[0], f[1]) for f in FRAMES] * 40, order))
    want = sorted((tuple(f[2:]) for f in FRAMES * 40), key=str)
    for piece in (1 << 23, 700):
        rows = read(spark, tmp_path, piece, raw="true").collect()
        assert sorted((tuple(r[c] for c in FIELDS) for r in rows), key=str) == want
        assert sorted(r.raw for r in rows) == sorted(f[1] for f in FRAMES * 40)
        assert {r.timestamp for r in rows} == {1_700_000_000.0 + i for i in range(len(want) // 2)}
        assert len({r.offset for r in rows}) == len(rows)


@pytest.mark.parametrize("order,nano", [("<", False), (">", True)])
def test_layers_of_plain_files(spark, tmp_path, order, nano):
    for link in {f[0] for f in FRAMES}:
        own = [f for f in FRAMES if f[0] == link]
        (tmp_path / f"{link}.pcap").write_bytes(pcap([f[1] for f in own], order, nano, link))
    rows = read(spark, tmp_path).orderBy("path", "offset").collect()
    assert sorted((tuple(r[c] for c in FIELDS) for r in rows), key=str) == sorted((tuple(f[2:]) for f in FRAMES), key=str)
    first = [r.timestamp for r in rows if r.path.endswith("/1.pcap")]
    assert np.allclose(first, [1_700_000_000 + i / (1e9 if nano else 1e6) for i in range(len(first))], atol=1e-6)


def test_ranges_find_the_same_records(tmp_path):
    """Frames of many sizes, of zeros and of text, and frames that hold a capture file themselves."""
    rng = np.random.default_rng(1)
    inner = pcap([bytes(40)] * 20)
    frames = [[bytes(int(n)), rng.bytes(int(n)), b"\x01\0\0\0" * (int(n) // 4), inner[: int(n)]][i % 4] for i, n in enumerate(rng.integers(0, 1500, 4000))]
    frames[7::500] = [rng.bytes(60_000)] * len(frames[7::500])
    path = tmp_path / "a.pcap"
    path.write_bytes(pcap(frames) + b"\0" * 11)
    whole = [r[0] for r in cs.pcap_records(cs.ByteRange(str(path), 0, path.stat().st_size))]
    assert len(whole) == len(frames)
    for piece in (1 << 20, 100_003, 30_000, 4_999):
        parts = cs.ranges_of(str(path), path.stat().st_size, piece)
        assert [r[0] for p in parts for r in cs.pcap_records(p)] == whole


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    frame = ether(0x0800, ipv4(6, ports(1000, 443) + bytes(1400)))
    n = (64 << 20) // (len(frame) + 16) + 1
    (tmp_path / "large.pcap").write_bytes(pcap([frame] * n))
    rows = read(spark, tmp_path / "large.pcap").withColumn("task", F.spark_partition_id())
    by_task = rows.groupBy("task").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("d")).collect()
    assert len(by_task) >= 8 and sum(r.n for r in by_task) == n == sum(r.d for r in by_task)
    assert max(r.n for r in by_task) <= 1.1 * n / 8


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "none.pcap").write_bytes(pcap([]))
    (tmp_path / "other.txt").write_bytes(b"not a capture")
    (tmp_path / "cut.pcap").write_bytes(pcap([b"x" * 100, b"y" * 100])[:-1])
    rows = read(spark, tmp_path).collect()
    assert [(os.path.basename(r.path), r.offset, r.length) for r in rows] == [("cut.pcap", 24, 100)]
    (tmp_path / "bad.pcap").write_bytes(b"no capture at all, but long enough to be one")
    with pytest.raises(Exception, match="not a capture file"):
        read(spark, tmp_path).collect()


def test_stream_takes_new_files(spark, tmp_path):
    spark.dataSource.register(cs.CaptureSource)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def drain():
        stream = spark.readStream.format("capture").option("path", str(folder)).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(out).groupBy("path").count().collect()

    frame = ether(0x0800, ipv4(6, ports(1, 2)))
    (folder / "a.pcap").write_bytes(pcap([frame] * 30))
    assert [r["count"] for r in drain()] == [30]
    (folder / "b.pcap").write_bytes(pcap([frame] * 12))
    assert sorted(r["count"] for r in drain()) == [12, 30]
    assert sorted(r["count"] for r in drain()) == [12, 30]
