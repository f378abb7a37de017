"""Document fingerprints from closed syncmers.

A k-mer of characters is an anchor if the smallest of its hashed inner s-mers is the
first or the last one. Whether a k-mer is chosen depends on nothing outside it, so equal
passages give equal anchors wherever they stand. A fingerprint holds the hash of every
anchor and the gap to the one before; two are compared by anchors that match along
common shifts of position.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowsieve.llm.common import id_and_text

#: Characters of an anchor and of an inner substring (powers of two), for texts of every length.
K, S = 16, 4
CHARS_AT_ONCE = 1 << 20
OUTPUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_MULTIPLIER = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _hashes(chars: np.ndarray, k: int, s: int) -> dict[int, np.ndarray]:
    """Hashes of all substrings of s and of k characters, by doubling the length."""
    h, n, power, out = chars.astype(np.uint64) + np.uint64(1), 1, _MULTIPLIER, {}
    while n < k:
        h = h[:-n] * np.uint64(power) + h[n:]
        n, power = 2 * n, power * power & (1 << 64) - 1
        if n in (s, k):
            out[n] = _mix(h)
    return out


def _anchors(chars: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    found = _hashes(chars, k, s)
    inner, width = found[s], k - s + 1
    least, n = inner, 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < width:
        least = np.minimum(least[: len(inner) - width + 1], least[width - n :])
    at = np.flatnonzero((least == inner[: len(least)]) | (least == inner[width - 1 :]))
    return (found[k][at] >> np.uint64(32)).astype(np.uint32), at


class Fingerprint:
    """Anchor hashes and positions of one text. A text shorter than K is one anchor; an empty one has none."""

    def __init__(self, text: str):
        k, s = K, S
        if len(text) < k:
            own = [xxhash.xxh32_intdigest(text.encode("utf-8", "replace"))] if text else []
            self.hashes, self.at = np.array(own, np.uint32), np.zeros(len(own), np.int64)
        else:
            hashes, places = [], []
            for begin in range(0, len(text) - k + 1, CHARS_AT_ONCE):
                part = np.frombuffer(text[begin : begin + CHARS_AT_ONCE + k - 1].encode("utf-32-le", "replace"), np.uint32)
                h, at = _anchors(part, k, s)
                hashes.append(h)
                places.append(at + begin)
            self.hashes, self.at = np.concatenate(hashes), np.concatenate(places)

    def encode(self) -> str:
        """Gaps (one byte each; no gap exceeds K - S) and hashes, in base64."""
        gaps = np.diff(self.at, prepend=0).astype(np.uint8)
        return base64.b64encode(gaps.tobytes() + self.hashes.astype("<u4").tobytes()).decode()

    @staticmethod
    def decode(code: str) -> Fingerprint:
        raw = base64.b64decode(code)
        out, n = Fingerprint(""), len(raw) // 5
        out.at, out.hashes = np.cumsum(np.frombuffer(raw[:n], np.uint8), dtype=np.int64), np.frombuffer(raw[n:], "<u4")
        return out

    def keys(self) -> np.ndarray:
        """Hash and how many anchors before have the same one, so repeated anchors pair up in order."""
        order = np.argsort(self.hashes, kind="stable")
        h = self.hashes[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        occurrence = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
        out = np.empty(len(h), np.uint64)
        out[order] = h.astype(np.uint64) << np.uint64(32) | occurrence.astype(np.uint64)
        return out


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Twice the matched anchors over all anchors. A match counts if another one has the same shift of
    position, or if either text has fewer than four anchors. Equal fingerprints give 1."""
    if np.array_equal(a.hashes, b.hashes) and np.array_equal(a.at, b.at):
        return 1.0
    if not len(a.hashes) or not len(b.hashes):
        return 0.0
    _, i, j = np.intersect1d(a.keys(), b.keys(), assume_unique=True, return_indices=True)
    matched = len(i)
    if matched and min(len(a.hashes), len(b.hashes)) >= 4:
        _, support = np.unique(a.at[i] - b.at[j], return_counts=True)
        matched = int(support[support > 1].sum())
    return 2.0 * matched / (len(a.hashes) + len(b.hashes))


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by as many from the start of the following text (or all it has)."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compare(batches):
    """Rows in order, one at a time; the row before waits for its successor."""
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    before = None
    for batch in batches:
        rows = []
        for doc_id, text, ahead in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("ahead").to_pylist()):
            own = Fingerprint(text)
            if before is not None:
                old_id, old_text, old = before
                changed = edited(old_text, text)
                new = Fingerprint(changed)
                sha = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
                rows.append((old_id, len(old_text), sha, old.encode(), new.encode(), likeness(old, new), likeness(old, own)))
            before = None if ahead else (doc_id, text, own)
            if ahead:
                break  # only the first row of the part that follows is needed
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *map(pa.array, columns[2:])], names=names)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness (see OUTPUT).

    The next document is the one with the next smaller doc_id (after the last one, the first). Equal ids
    follow each other in the order of their texts; rows without an id come last. NULL texts are empty. A table of one row is
    its own next. Documents are dealt by ranges of doc_id; the first document of each range is also sent to the range
    before it. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    narrow = id_and_text(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = narrow.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = np.unique(np.array(cuts, np.int64))[::-1].copy()  # part p: ids below bounds[p - 1], not below bounds[p]

    def part_of(ids: pd.Series) -> np.ndarray:
        last = len(bounds)
        plain = ids.fillna(0).to_numpy(np.int64)
        return np.where(ids.isna(), last, np.searchsorted(-bounds, -plain, side="left") if last else 0)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(part_of(ids.astype("Int64")))

    # one row for each range
    firsts = sorted((r["p"], r["first"]) for r in narrow.select(part("doc_id").alias("p"), "doc_id").groupBy("p").agg(F.max("doc_id").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        own = part_of(ids.astype("Int64"))
        keys = [None if pd.isna(x) else int(x) for x in ids.astype("Int64")]
        return pd.Series([[2 * p, 2 * before[x] + 1] if x in before else [2 * p] for x, p in zip(keys, own)])

    dealt = narrow.select("doc_id", "text", F.explode(places("doc_id")).alias("place"))
    dealt = dealt.select("doc_id", "text", F.expr("cast(shiftright(place, 1) as int)").alias("p"), (F.col("place") % 2 == 1).alias("ahead"))
    ordered = dealt.repartitionById(max(1, len(bounds) + 1), "p").sortWithinPartitions("ahead", F.desc_nulls_last("doc_id"), "text")
    return ordered.select("doc_id", "text", "ahead").mapInArrow(_compare, OUTPUT)
