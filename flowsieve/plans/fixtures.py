"""Files derived from the given tables, for the queries that read files. Every task writes its own part."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from flowsieve.session import scratch_path

ARFF_HEADER = [
    "% flow records", "@RELATION flows", "@attribute quantity NUMERIC", "@Attribute 'price' real", "@attribute tax numeric,",
    "@attribute row_id string", "@attribute class1 {A,N,R}", "@DATA",
]


def write_arff(df: DataFrame, folder: str) -> str:
    """Text parts that each are an ARFF file, with comments, ``?`` values, trailing commas and short rows."""
    line = F.concat_ws(
        ",", F.coalesce(F.col("quantity").cast("string"), F.lit("?")), F.col("price").cast("string"),
        F.coalesce(F.col("tax").cast("string"), F.lit("?")), "row_id", "label",
    )
    odd = F.when(F.col("line") == 1, F.array(line, F.lit("% note"), F.lit("1,2,3"))).otherwise(F.array(F.concat(line, F.lit(","))))
    lines = df.select(F.explode(odd).alias("value"))

    def with_header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ARFF_HEADER})
        yield from batches

    # the text sink names its parts *.txt; readers take the folder's files as they are
    lines.mapInPandas(with_header, "value string").write.text(folder)
    return folder


def frame_bytes(kind: str, src: int, dst: int, sport: int, dport: int, size: int) -> bytes:
    """Ethernet + IPv4 + TCP or UDP headers with ``size`` payload bytes; other kinds get an ARP-like frame."""
    if kind not in ("TCP", "UDP"):
        return b"\x02" * 12 + struct.pack(">H", 0x0806) + b"\0" * 28
    layer = struct.pack(">HHIIBBHHH", sport, dport, 1, 0, 0x50, 2, 64, 0, 0) if kind == "TCP" else struct.pack(">HHHH", sport, dport, 8 + size, 0)
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(layer) + size, 0, 0, 64, 6 if kind == "TCP" else 17, 0, bytes([10, 0, 0, src]), bytes([10, 1, 0, dst]))
    return b"\x02" * 12 + struct.pack(">H", 0x0800) + ip + layer + b"x" * size


def capture_bytes(packets: pd.DataFrame) -> bytes:
    """A libpcap file of (t_us, kind, src, dst, sport, dport, size) rows."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    for p in packets.itertuples():
        frame = frame_bytes(p.kind, p.src, p.dst, p.sport, p.dport, p.size)
        out.append(struct.pack("<IIII", p.t_us // 1000000, p.t_us % 1000000, len(frame), len(frame)) + frame)
    return b"".join(out)


def write_captures(packets: DataFrame, folder: str) -> list[str]:
    """One capture per task below ``folder``; returns their paths."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        parts = (b for b in batches if len(b))
        first = next(parts, None)
        if first is None:
            return
        uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
        system, inner = fs.FileSystem.from_uri(uri)
        system.create_dir(inner, recursive=True)
        path = f"{inner}/part-{TaskContext.get().partitionId():05d}.pcap"
        with system.open_output_stream(path) as f:
            f.write(capture_bytes(first))
            for b in parts:
                f.write(capture_bytes(b)[24:])
        yield pd.DataFrame({"path": [f"{folder}/part-{TaskContext.get().partitionId():05d}.pcap"]})

    return sorted(r.path for r in packets.mapInPandas(write, "path string").collect())


CAPTURES, CAPTURE_PACKETS = 4, 250_000  # files at least, packets of a file at most


def capture_files(spark, packets: DataFrame) -> list[str]:
    """Captures of all packets; more packets make more files, so that no task writes more."""
    files = max(CAPTURES, -(-packets.count() // CAPTURE_PACKETS))
    rows = packets.select(
        F.col("pkt_id"), F.col("t_us"), F.col("protocol").alias("kind"), F.col("k").alias("src"), (F.col("flow_id") % 7).alias("dst"),
        (F.col("pkt_id") % 60000 + 1024).cast("int").alias("sport"), F.col("dst_port").alias("dport"), (F.col("k") % 20).alias("size"),
    )
    return write_captures(rows.repartition(files, "pkt_id").sortWithinPartitions("t_us", "pkt_id").drop("pkt_id"), scratch_path(spark, "captures"))
