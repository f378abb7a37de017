"""Capture files as a Spark data source: ``spark.read.format("capture")`` and ``spark.readStream.format("capture")``.

A file is read as byte ranges, one task each. A libpcap range finds its first record by itself: an offset
is a record border if a chain of plausible record headers that began well before it runs on for longer than
any one record can be, or to the end of the file. A record belongs to the range its header begins in.
pcapng blocks need the section and interface descriptions before them, so a range of such a file walks the
block headers from the start, and a file is cut into at most ``BLOCK_RANGES`` ranges.

Records are found one by one, everything else is read from whole arrays: link layers, VLAN tags, IPv4 and
IPv6 with extension headers, ports.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = (
    "path string, offset bigint, timestamp double, length bigint, src_ip string, dst_ip string, src_port int, "
    "dst_port int, protocol string, raw binary"
)

# Numbers of the file formats, link types, ether types, protocols and extension headers.
LIBPCAP = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
ORDER_MAGIC = 0x1A2B3C4D
RESOLUTION_OPTION = 9
LINK_NULL, LINK_ETHERNET, LINK_RAW, LINK_LOOP, LINK_SLL, LINK_IPV4, LINK_IPV6, LINK_SLL2 = 0, 1, 101, 108, 113, 228, 229, 276
ETHER_IPV4, ETHER_IPV6 = 0x0800, 0x86DD
ETHER_VLAN = (0x8100, 0x88A8, 0x9100)
TCP, UDP = 6, 17
EXTENSIONS = (0, 43, 60, 135)  # length in units of 8 bytes, less the first 8
FRAGMENT, AUTHENTICATION = 44, 51

FILE_HEADER, RECORD_HEADER = 24, 16
RANGE_BYTES = 8 << 20
BLOCK_RANGES = 16
MANY_RANGES = 512
MOST_RECORD, MOST_FULL = 1 << 18, 1 << 24
#: A record is taken for one only if its second lies so far before or after that of the file's first record.
CLOCK_BACK, CLOCK_ON = 1 << 25, 1 << 30
MOST_BLOCK = 1 << 26
BATCH_RECORDS = 8192
MOST_TAGS = 8


@dataclass
class ByteRange(InputPartition):
    path: str
    begin: int
    stop: int


def open_file(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(inner)


def list_captures(paths: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modified in ns) of the files named, or of those with a capture's extension in the folders named."""
    from pyarrow import fs

    out = []
    for path in filter(None, (p.strip() for p in paths.split(","))):
        system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
        named = [i for i in found if i.is_file and (info.is_file or i.extension in ("pcap", "pcapng", "cap"))]
        out += [(head + i.path, i.size, i.mtime_ns) for i in named]
    return sorted(out)


def wide_enough(total: int, piece: int) -> int:
    """Bytes of a range: ``piece``, and more where a read would have over ``MANY_RANGES`` of them, as each costs the search for its first
    record; at most ``RANGE_BYTES`` unless ``piece`` is larger."""
    return max(piece, min(-(-total // MANY_RANGES), RANGE_BYTES))


def ranges_of(path: str, size: int, piece: int) -> list[ByteRange]:
    with open_file(path) as f:
        blocks = f.read(4) == struct.pack("<I", SECTION)
    step = max(piece, -(-size // BLOCK_RANGES)) if blocks else piece
    return [ByteRange(path, a, min(a + step, size)) for a in range(0, max(size, 1), step)]


class Buffer:
    """A window of a file that moves on as records are read."""

    def __init__(self, f, at: int, size: int, ahead: int = 4 << 20):
        self.f, self.size, self.ahead = f, size, ahead
        self.begin, self.data = at, b""

    def need(self, at: int, n: int) -> int:
        """The place of file offset ``at`` in ``data``, with ``n`` bytes behind it; -1 past the end of the file."""
        if at + n > self.size:
            return -1
        if at < self.begin or at + n > self.begin + len(self.data):
            self.f.seek(at)
            self.begin, self.data = at, self.f.read(max(n, self.ahead))
        return at - self.begin


def first_record(sample: bytes, base: int, want: int, order: str, unit: float, most: int, size: int, began: int) -> int:
    """The first record border at file offset ``want`` or later; -1 if there is none.

    ``sample`` starts at file offset ``base``, before ``want`` by more than two of the longest records, and goes on behind it
    by as much, unless the file ends. A chain of headers inside one frame (a capture that was sent over the
    network) ends or meets the true one where the frame does, so before ``want``. ``began`` is the second of the first record.
    """
    raw = np.frombuffer(sample, np.uint8)
    n = len(raw) - RECORD_HEADER + 1
    if n <= 0:
        return -1
    word = lambda at: sum(raw[at + (i if order == "<" else 3 - i) : n + at + (i if order == "<" else 3 - i)].astype(np.int64) << (8 * i) for i in range(4))
    sec, kept, full = word(0), word(8), word(12)
    good = (sec >= began - CLOCK_BACK) & (sec <= began + CLOCK_ON) & (word(4) < unit) & (kept <= most) & (kept <= full) & (full <= MOST_FULL)
    dead: set[int] = set()
    for start in np.flatnonzero(good).tolist():
        at, found, seen = start, -1, []
        while at < n and good[at] and at not in dead:
            seen.append(at)
            if found < 0 and base + at >= want:
                found = at
            if base + at > want + most + RECORD_HEADER:
                return base + found
            at += RECORD_HEADER + int(kept[at])
        if at >= n and base + len(raw) >= size:  # it runs to the end of the file
            return base + found if found >= 0 else -1
        dead.update(seen)
    return -1


def pcap_records(part: ByteRange) -> Iterator[tuple]:
    """(offset, bytes, seconds, full length, link type) of the records whose header begins in the range."""
    with open_file(part.path) as f:
        size = f.size()
        head = f.read(FILE_HEADER + RECORD_HEADER)
        if head[:4] not in LIBPCAP or len(head) < FILE_HEADER:
            raise ValueError(f"{part.path} is not a capture file")
        order, unit = LIBPCAP[head[:4]]
        snap, link = struct.unpack_from(order + "II", head, 16)
        most = min(snap, MOST_RECORD) if snap else MOST_RECORD
        at, back = FILE_HEADER, part.begin - 2 * (most + RECORD_HEADER) - 1
        if back > FILE_HEADER:
            f.seek(back)
            sample = f.read(4 * (most + RECORD_HEADER) + 2)
            at = first_record(sample, back, part.begin, order, unit, most, size, struct.unpack_from(order + "I", head, FILE_HEADER)[0])
            if at < 0:  # no border can be told from the bytes alone: walk there
                at = FILE_HEADER
        buffer = Buffer(f, at, size)
        layout = struct.Struct(order + "IIII")
        while at < part.stop:
            i = buffer.need(at, RECORD_HEADER)
            if i < 0:
                return
            sec, frac, kept, full = layout.unpack_from(buffer.data, i)
            i = buffer.need(at, RECORD_HEADER + kept)
            if i < 0:
                return  # the file ends within the record
            if at >= part.begin:
                yield at, buffer.data[i + RECORD_HEADER : i + RECORD_HEADER + kept], sec + frac / unit, full, link & 0xFFFF
            at += RECORD_HEADER + kept


def _interface(body: bytes, order: str) -> tuple[int, float]:
    """Link type and ticks a second of an interface description."""
    link, at, unit = struct.unpack_from(order + "H", body, 0)[0], 8, 1e6
    while at + 4 <= len(body):
        code, n = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        if code == RESOLUTION_OPTION and n:
            value = body[at + 4]
            unit = 2.0 ** (value & 127) if value & 128 else 10.0**value
        at += 4 + (n + 3) // 4 * 4
    return link, unit


def block_records(part: ByteRange) -> Iterator[tuple]:
    """As ``pcap_records``, of a file of blocks. Blocks before the range are walked for sections and interfaces alone."""
    with open_file(part.path) as f:
        size = f.size()
        buffer, at, order, interfaces = Buffer(f, 0, size), 0, "<", []
        while at < part.stop:
            i = buffer.need(at, 12)
            if i < 0:
                return
            if buffer.data[i : i + 4] == struct.pack("<I", SECTION):
                order, interfaces = "<" if struct.unpack_from("<I", buffer.data, i + 8)[0] == ORDER_MAGIC else ">", []
            kind, n = struct.unpack_from(order + "II", buffer.data, i)
            if n < 12 or n % 4 or n > MOST_BLOCK:
                raise ValueError(f"{part.path}: no block at byte {at}")
            here = at >= part.begin
            if kind == INTERFACE or here and kind in (PACKET, SIMPLE_PACKET, OLD_PACKET):
                i = buffer.need(at, n)
                if i < 0:
                    return  # the file ends within the block
                body = buffer.data[i + 8 : i + n - 4]
                if kind == INTERFACE:
                    interfaces.append(_interface(body, order))
                elif kind == SIMPLE_PACKET:
                    full = struct.unpack_from(order + "I", body, 0)[0]
                    yield at, body[4 : 4 + full], None, full, interfaces[0][0]
                else:
                    which, high, low, kept, full = struct.unpack_from(order + ("IIIII" if kind == PACKET else "HxxIIII"), body, 0)
                    link, unit = interfaces[which]
                    yield at, body[20 : 20 + kept], ((high << 32) + low) / unit, full, link
            at += n


class Frames:
    """Many frames end to end in one array, read by columns; bytes past the end of a frame count as missing."""

    def __init__(self, frames: list[bytes]):
        self.sizes = np.fromiter(map(len, frames), np.int64, len(frames))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(frames) + bytes(64), np.uint8)

    def byte(self, at: np.ndarray, i: int = 0) -> np.ndarray:
        return self.raw[np.minimum(self.starts + np.minimum(at + i, self.sizes), len(self.raw) - 1)].astype(np.int64)

    def short(self, at: np.ndarray, i: int = 0) -> np.ndarray:
        return self.byte(at, i) << 8 | self.byte(at, i + 1)

    def has(self, at: np.ndarray, n: int) -> np.ndarray:
        return at + n <= self.sizes


def network_layer(f: Frames, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4, 6 or 0, place of the network header) of each frame, by its link type, behind any VLAN tags."""
    n = len(link)
    zero = np.zeros(n, np.int64)
    kind, at = zero.copy(), zero.copy()
    for number, where, header in ((LINK_ETHERNET, 12, 14), (LINK_SLL, 14, 16), (LINK_SLL2, 0, 20)):
        mine = (link == number) & f.has(zero, header)
        kind, at = np.where(mine, f.short(zero, where), kind), np.where(mine, header, at)
    for _ in range(MOST_TAGS):
        tagged = np.isin(kind, ETHER_VLAN) & f.has(at, 4)
        if not tagged.any():
            break
        kind, at = np.where(tagged, f.short(at, 2), kind), np.where(tagged, at + 4, at)
    version = np.where(kind == ETHER_IPV4, 4, np.where(kind == ETHER_IPV6, 6, 0))
    loop, bare = np.isin(link, (LINK_NULL, LINK_LOOP)), np.isin(link, (LINK_RAW, LINK_IPV4, LINK_IPV6))
    at = np.where(loop, 4, at)
    said = f.byte(at) >> 4
    return np.where((loop | bare) & f.has(at, 1) & np.isin(said, (4, 6)), said, version), at


def transport_layer(f: Frames, version: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(protocol or -1, place of its header, whether the header is here) of each frame."""
    v4, v6 = (version == 4) & f.has(at, 20), (version == 6) & f.has(at, 40)
    kind = np.where(v4, f.byte(at, 9), np.where(v6, f.byte(at, 6), -1))
    whole = ~v4 | (f.short(at, 6) & 0x1FFF == 0)  # later fragments carry no ports
    place = np.where(v4, at + (f.byte(at) & 15) * 4, at + 40)
    for _ in range(MOST_TAGS):
        more = v6 & whole & np.isin(kind, (*EXTENSIONS, FRAGMENT, AUTHENTICATION)) & f.has(place, 8)
        if not more.any():
            break
        long = f.byte(place, 1)
        step = np.where(kind == FRAGMENT, 8, np.where(kind == AUTHENTICATION, (long + 2) * 4, (long + 1) * 8))
        whole &= ~(more & (kind == FRAGMENT) & (f.short(place, 2) >> 3 != 0))
        kind, place = np.where(more, f.byte(place), kind), np.where(more, place + step, place)
    return kind, place, whole


def _addresses(f: Frames, version: np.ndarray, at: np.ndarray, offsets: tuple[int, int]) -> np.ndarray:
    out = np.full(len(version), None, object)
    for number, size, i in ((4, 4, offsets[0]), (6, 16, offsets[1])):
        rows = np.flatnonzero((version == number) & f.has(at, 20 if number == 4 else 40))
        if len(rows):
            found = f.raw[(f.starts[rows] + at[rows] + i)[:, None] + np.arange(size)]
            distinct, which = np.unique(found, axis=0, return_inverse=True)
            names = [str(ipaddress.ip_address(x.tobytes())) for x in distinct]
            out[rows] = np.array(names, object)[which.reshape(-1)]
    return out


def packet_batch(path: str, records: list[tuple], with_raw: bool) -> pa.RecordBatch:
    """Records as rows of ``SCHEMA``."""
    offset, frames, seconds, full, link = zip(*records)
    f = Frames(list(frames))
    version, at = network_layer(f, np.array(link, np.int64))
    kind, place, whole = transport_layer(f, version, at)
    ports = np.isin(kind, (TCP, UDP)) & whole & f.has(place, 4)
    names = {TCP: "TCP", UDP: "UDP"}
    protocol = [None if k < 0 else names[k] if k in names and p else str(k) for k, p in zip(kind.tolist(), ports.tolist())]
    columns = [
        pa.array([path] * len(records)), pa.array(offset, pa.int64()), pa.array(seconds, pa.float64()), pa.array(full, pa.int64()),
        pa.array(_addresses(f, version, at, (12, 8)), pa.string()), pa.array(_addresses(f, version, at, (16, 24)), pa.string()),
        pa.array(f.short(place), pa.int32(), mask=~ports), pa.array(f.short(place, 2), pa.int32(), mask=~ports), pa.array(protocol, pa.string()),
        pa.array(frames if with_raw else [None] * len(records), pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def read_range(part: ByteRange, with_raw: bool) -> Iterator[pa.RecordBatch]:
    with open_file(part.path) as f:
        head = f.read(4)
    if not head:
        return
    records, held = [], 0
    for r in block_records(part) if head == struct.pack("<I", SECTION) else pcap_records(part):
        records.append(r)
        held += len(r[1])
        if len(records) >= BATCH_RECORDS or held >= RANGE_BYTES:
            yield packet_batch(part.path, records, with_raw)
            records, held = [], 0
    if records:
        yield packet_batch(part.path, records, with_raw)


class CaptureReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.piece = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.with_raw = options.get("raw", "false").lower() == "true"

    def partitions(self):
        return self.ranges([(path, size) for path, size, _ in list_captures(self.paths)])

    def ranges(self, files):
        piece = wide_enough(sum(size for _, size in files), self.piece)
        return [r for path, size in files for r in ranges_of(path, size, piece)] or [ByteRange("", 0, 0)]

    def read(self, partition):
        return read_range(partition, self.with_raw) if partition.path else iter(())


class CaptureStreamReader(DataSourceStreamReader):
    """Files that appear in the folders; the offset is the time of the newest file taken."""

    def __init__(self, options):
        self.batch = CaptureReader(options)

    def initialOffset(self):
        return {"upto": -1}

    def latestOffset(self):
        return {"upto": max((m for _, _, m in list_captures(self.batch.paths)), default=-1)}

    def partitions(self, start, end):
        new = [(p, n) for p, n, m in list_captures(self.batch.paths) if start["upto"] < m <= end["upto"]]
        return self.batch.ranges(new)

    def read(self, partition):
        return self.batch.read(partition)

    def commit(self, end):
        pass


class CaptureSource(DataSource):
    """Options: ``path`` (files or folders, comma-separated), ``rangeBytes`` (bytes a task reads, more in a large read), ``raw`` (keep the frames).

    Rows as in ``SCHEMA``: ``offset`` is the record's place in its file, so (path, offset) is a key and orders the packets.
    Fields of layers that a packet does not have are NULL; other protocols than TCP and UDP are given by number.
    An empty file has no packets, a record cut off by the end of a file is left out, any other file is an error.
    As a stream, a file must be complete when it appears, and newer than those before it.
    """

    @classmethod
    def name(cls):
        return "capture"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CaptureReader(self.options)

    def streamReader(self, schema):
        return CaptureStreamReader(self.options)
