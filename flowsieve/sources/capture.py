"""Capture files to packet rows and to vectors of their bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowsieve.sources.capture_source import RANGE_BYTES, CaptureSource

# Fixed value: the bytes of a packet that make its vector.
PACKET_BYTES = 1500
#: A batch of rows becomes vectors in parts of so many rows, so a worker holds few vectors at a time.
VECTORS_AT_ONCE = 256


def read_captures(spark: SparkSession, files: Sequence[str], with_raw: bool = False, piece: int = RANGE_BYTES) -> DataFrame:
    """One row per packet of the given capture files or folders, see ``CaptureSource``."""
    spark.dataSource.register(CaptureSource)
    reader = spark.read.format("capture").option("rangeBytes", piece).option("raw", str(with_raw).lower())
    return reader.option("path", ",".join(files)).load()


def stream_captures(spark: SparkSession, folder: str, with_raw: bool = False, piece: int = RANGE_BYTES) -> DataFrame:
    """A stream of the packets of the files that appear in a folder."""
    spark.dataSource.register(CaptureSource)
    reader = spark.readStream.format("capture").option("rangeBytes", piece).option("raw", str(with_raw).lower())
    return reader.option("path", folder).load()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _scaled(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for raw, size in batches:
        n = int(size.iloc[0]) if len(size) else 0
        for at in range(0, max(len(raw), 1), VECTORS_AT_ONCE):
            part = raw.iloc[at : at + VECTORS_AT_ONCE]
            x = np.zeros((len(part), n))
            for row, b in zip(x, part):
                if b is not None:
                    known = np.frombuffer(b, dtype=np.uint8)[:n]
                    row[: len(known)] = known / 255.0
            yield pd.Series(list(x))


def packet_vector(raw: str, size: int = PACKET_BYTES):
    """Bytes as ``size`` numbers in [0, 1], cut or zero padded. Only the bytes in use go to Python."""
    return _scaled(F.substring(F.col(raw), 1, size), F.lit(size))


def packet_vectors(packets: DataFrame, file: str, number: str, raw: str, size: int = PACKET_BYTES, per_file: int | None = None) -> DataFrame:
    """Vectors of all packets, or of the first ``per_file`` of each file (``number`` counts them from 0)."""
    chosen = packets if per_file is None else packets.where(F.col(number) < per_file)
    return chosen.select(file, number, packet_vector(raw, size).alias("vector"))
