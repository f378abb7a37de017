"""Quality by importance resampling.

Two generative models over hashed word and word-pair counts, one of the target (labelled
good) text and one of all raw text, give each document a log ratio. A document's weight is
that ratio above a limit calibrated on the labels, and the kept documents are drawn by
Gumbel top-k over the weights: as many as there are documents above the limit.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowsieve.llm.common import bounded_batches
from flowsieve.session import materialize

BUCKETS = 1 << 16
HALF_BITS = 15
#: Labelled rows used for the target model and the limit, at most.
LABELLED = 20_000
#: Prior strength, in n-grams, that pulls the target model towards the raw one.
PRIOR = float(BUCKETS)
#: 1: drawn in proportion to exp(weight), the importance ratio itself.
TEMPERATURE = 1.0
REPEAT = 7
WORDS_AT_ONCE = 1 << 18
EXACT_ROWS = 10_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def buckets(text: str | None):
    """Arrays of bucket numbers of the words and word pairs of a text, piece by piece. A word that repeats the one before is one token of its own."""
    before = None
    ids: list[int] = []

    def flush(ids, before):
        own = np.array(ids, np.uint64)
        last = np.concatenate([[own[0] if before is None else before[0]], own[:-1]]).astype(np.uint64)
        repeat = own == last
        if before is None:
            repeat[0] = False
        tokens = np.where(repeat, np.uint64(REPEAT), own)
        chain = tokens if before is None else np.concatenate([np.array([before[1]], np.uint64), tokens])
        mask, shift = np.uint64(0xFFFFFFFF), np.uint64(32 - HALF_BITS)
        one = (tokens * np.uint64(0x9E3779B1) & mask) >> shift
        two = ((chain[:-1] * np.uint64(0x85EBCA6B) + chain[1:] * np.uint64(0xC2B2AE35)) & mask) >> shift
        return np.concatenate([one, two + np.uint64(1 << HALF_BITS)]).astype(np.int64), (own[-1], tokens[-1])

    for match in _TOKEN.finditer((text or "").lower()):
        ids.append(zlib.crc32(match.group().encode("utf-8", "replace")))
        if len(ids) == WORDS_AT_ONCE:
            found, before = flush(ids, before)
            ids = []
            yield found
    if ids:
        yield flush(ids, before)[0]


def bucket_counts(texts: DataFrame, column: str = "text") -> np.ndarray:
    """Counts of all buckets over a table: summed in each task, then by bucket; 65,536 rows reach the driver."""
    bounded_batches(texts.sparkSession)

    def work(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for found in buckets(text):
                    counts += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    summed = texts.select(F.col(column).cast("string")).mapInArrow(work, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for r in summed.collect():
        out[r["bucket"]] = r["n"]
    return out


@dataclass
class Model:
    ratio: np.ndarray
    limit: float

    def score(self, text: str | None) -> tuple[float, int]:
        """Sum of log ratios and the number of n-grams."""
        total, n = 0.0, 0
        for found in buckets(text):
            total += float(self.ratio[found].sum())
            n += len(found)
        return total, n


def scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every document with log_ratio, n_grams and mean_ratio (0 n-grams: minus infinity)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 65,536 numbers
    narrow = docs.select(F.col("text").cast("string").alias("_text"), *keep)
    schema = T.StructType(narrow.schema.fields[1:]).add("log_ratio", "double").add("n_grams", "long").add("mean_ratio", "double")

    def work(batches):
        for batch in batches:
            found = [shared.value.score(t) for t in batch.column(0).to_pylist()]
            total, n = np.array([x[0] for x in found], float), np.array([x[1] for x in found], np.int64)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = np.where(n > 0, total / np.maximum(n, 1), -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(total), pa.array(n), pa.array(mean)], names=[*keep, "log_ratio", "n_grams", "mean_ratio"])

    return narrow.mapInArrow(work, schema)


def best_limit(good: np.ndarray, bad: np.ndarray) -> float:
    """The limit with the best balanced accuracy (the middle of the gap it lies in); without bad texts, below all good ones."""
    good, bad = np.sort(good[np.isfinite(good)]), np.sort(bad)
    if not len(good):
        return -np.inf
    if not len(bad):
        return float(good[0]) - 1e-9
    edges = np.unique(np.concatenate([good, bad[np.isfinite(bad)]]))
    cuts = np.concatenate([[edges[0] - 1.0], (edges[1:] + edges[:-1]) / 2])
    quality = (len(good) - np.searchsorted(good, cuts)) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    best = np.flatnonzero(quality == quality.max())
    return float(cuts[best[0]])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """The raw model from all documents; target model and limit from at most ``labelled`` labelled rows.

    Labels of a document that differ count as their mean, rounded. Without labelled good text every
    ratio is 0 and nothing is rejected.
    """
    raw = bucket_counts(docs)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("_quality"))
    known = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "labelled")
    text = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # at most `labelled` rows
    text = materialize(text, "labelled-texts")
    target = bucket_counts(text.where("_quality = 1"))
    raw_p = (raw + 1) / (raw.sum() + BUCKETS)
    ratio = np.log((target + PRIOR * raw_p) / (target.sum() + PRIOR) / raw_p) if target.sum() else np.zeros(BUCKETS)
    draft = Model(ratio, -np.inf)
    rows = scores(text, draft, ["_quality"]).select("_quality", "mean_ratio").limit(10 * labelled).toArrow()
    good = rows.column("_quality").to_numpy() == 1
    mean = rows.column("mean_ratio").to_numpy()
    return Model(ratio, best_limit(mean[good], mean[~good]))


def kth_largest(table: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a stored column, exact: the value range is cut into 4096 bands until few rows are left in one."""
    if k <= 0:
        return None
    rows = table.where(F.col(column).isNotNull())
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low is not None and low < high:
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            break
        band = F.least(F.floor((F.col(column) - low) / width), F.lit(4095)).alias("band")
        inside = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        counts = sorted(((r["band"], r["n"], r["a"], r["b"]) for r in inside.groupBy(band).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()), reverse=True)
        for _, n, a, b in counts:
            if k <= n:
                break
            k -= n
        if n <= EXACT_ROWS:
            found = inside.where((F.col(column) >= a) & (F.col(column) <= b)).orderBy(F.desc(column)).limit(k).agg(F.min(column)).first()
            return found[0]
        low, high = a, b
    return high


def gumbel(*parts: Column | str, salt: str = "gumbel") -> Column:
    """Standard Gumbel noise from a hash of the parts, the same in every run; another salt is another draw."""
    uniform = (F.shiftrightunsigned(F.xxhash64(*parts, F.lit(salt)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def draw(table: DataFrame, weight: str, noise: str, k: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """A stored table with gumbel_key (weight / temperature + noise) and ``selected``: the ``k`` largest keys, ties at the last one included.

    At temperature 1 rows so leave the urn one by one with chances in proportion to exp(weight). k is the number of positive weights
    unless given. A NULL weight is never drawn.
    """
    table = materialize(table.withColumn("gumbel_key", F.col(weight) / temperature + F.col(noise)).drop(noise), "weights")
    wanted = table.where(F.col(weight) > 0).count() if k is None else k
    last = kth_largest(table, "gumbel_key", min(wanted, table.where("gumbel_key is not null").count()))
    chosen = F.coalesce(F.col("gumbel_key") >= F.lit(last), F.lit(False)) if last is not None else F.lit(False)
    return table.withColumn("selected", chosen)


def resample(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, temperature: float = TEMPERATURE, k: int | None = None, salt: str = "gumbel") -> DataFrame:
    """Columns ``keep`` of every document with log_ratio, n_grams, mean_ratio, weight, gumbel_key and ``selected``.

    ``weight`` is the log ratio above the limit, summed over the n-grams; ``gumbel_key`` and the draw: see ``draw``. The noise comes from a
    hash of the id and the text, so a retry draws the same.
    Texts without a word (NULL, empty, white space) have no weight and are never selected, unless nothing could be learned
    from the labels; then all are. An empty table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    model = fit(docs, labels)
    if not np.isfinite(model.limit):
        model.limit = -1e9
    raw = scores(docs.withColumn("_noise", gumbel("doc_id", F.col("text").cast("string"), salt=salt)), model, [*keep, "_noise"])
    weight = F.when(F.col("n_grams") > 0, F.col("log_ratio") - F.lit(model.limit) * F.col("n_grams"))
    drawn = draw(raw.withColumn("weight", weight), "weight", "_noise", k, temperature)
    return drawn.withColumn("selected", F.col("selected") | F.lit(model.limit == -1e9))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The selected documents, with the columns they came with, whatever their names.

    NULL, empty and white texts go, unless nothing could be learned; then all stay. Repeated rows share their fate. An
    empty table gives an empty result.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_document")
    return resample(docs.select("doc_id", "text", whole), labels, ["_document"]).where("selected").select("_document.*")
