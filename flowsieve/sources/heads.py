"""Heads of text files, read by tasks that each open their share of the files and stop at the end of the head."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

FILES_PER_TASK = 64
_HEADS = "path string, head array<string>"


def _text_of(path: str, encoding: str) -> io.TextIOWrapper:
    """The file as text, decompressed by its extension."""
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        system, inner = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, inner = fs.FileSystem.from_uri(quote(path, safe="/:@?&=+,-._~%"))
    return io.TextIOWrapper(io.BufferedReader(system.open_input_stream(inner)), encoding=encoding, errors="replace", newline=None)


def first_record(lines: Iterator[str], sep: str = ",") -> list[str]:
    """Cells of the first line that is not blank, quoted ones unquoted; none in an empty file."""
    for line in lines:
        line = line.lstrip("\ufeff")
        if line.strip():
            return next(csv.reader([line.rstrip("\r\n")], delimiter=sep))
    return []


def arff_head(lines: Iterator[str]) -> list[str]:
    """The lines before ``@data``."""
    out = []
    for line in lines:
        if line.strip().lower().startswith("@data"):
            break
        if line.strip() and not line.lstrip().startswith("%"):
            out.append(line.strip())
    return out


def _heads(spark: SparkSession, files: Sequence[str], read, encoding: str) -> DataFrame:
    tasks = max(1, -(-len(files) // FILES_PER_TASK))
    paths = spark.createDataFrame([(f,) for f in files], "path string").repartition(tasks)

    def open_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for path in b["path"]:
                with _text_of(path, encoding) as f:
                    found.append(read(f))
            yield pd.DataFrame({"path": b["path"], "head": found})

    return paths.mapInPandas(open_all, _HEADS)


def _grouped(heads: DataFrame) -> dict[tuple[str, ...], list[str]]:
    """Files by head. One row per head and its files' names reach the driver, as the names came from there."""
    rows = heads.groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    return {tuple(r["head"]): list(r["paths"]) for r in sorted(rows, key=lambda r: r["paths"][0])}


def csv_headers(spark: SparkSession, files: Sequence[str], encoding: str = "UTF-8", sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """Files by their header, as written; files without any line under ()."""
    return _grouped(_heads(spark, files, lambda f: first_record(f, sep), "utf-8" if encoding.upper() == "UTF-8" else encoding))


def arff_heads(spark: SparkSession, files: Sequence[str], encoding: str = "utf-8") -> dict[tuple[str, ...], list[str]]:
    """Files by the lines before their data, comments and blank lines left out."""
    return _grouped(_heads(spark, files, arff_head, encoding))
