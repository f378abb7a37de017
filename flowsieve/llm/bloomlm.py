"""A bigram language model in a log-frequency Bloom filter.

Counts are quantised on a logarithmic scale. An n-gram with level q is stored as the q
keys (n-gram, 1) .. (n-gram, q) of a Bloom filter, and read back by probing levels upwards
until one is missing. A bigram that occurs once is one key of a filter of its own, asked where the
first has none. Both are broadcast; their sizes follow the corpus up to ``MOST_BITS`` each,
and beyond that the least frequent bigrams stay outside: their exact counts are joined to the tokens that ask for them. Probabilities are
``P(w | v) = (c(v, w) + mu * P(w)) / (c(v) + mu)`` over additively smoothed single words,
with mu chosen on all training texts, each token's own count taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowsieve.llm.common import bounded_batches, remainder
from flowsieve.session import materialize

SEGMENT_BITS = 10
HASHES = 6
BITS_PER_KEY, LEAST_BITS_PER_KEY = 16, 8  # fewer only where ``MOST_BITS`` is reached
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
BASE = 1.5
#: Exact counts of so many words at most are broadcast; those of the other words are joined.
FREQUENT_WORDS = 1_000_000
TOKENS_AT_ONCE = 1 << 20
GRAMS_AT_ONCE = 1 << 21
MUS = (5.0, 20.0, 100.0, 500.0, 2500.0, 12500.0)
END = xxhash.xxh64_intdigest(b" ")  # no word is a space


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> np.ndarray:
    """63-bit word hashes (lowest bit 0) of the lower-cased words and one end."""
    digest = xxhash.xxh64_intdigest
    found = [digest(w) for w in (text or "").encode("utf-8", "replace").lower().split()]
    found.append(END)
    return np.array(found, np.uint64) & ~np.uint64(1)


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Hashes (lowest bit 1) of each word with the one before; before the first stands an end."""
    before = np.concatenate([[np.uint64(END) & ~np.uint64(1)], words[:-1]]).astype(np.uint64)
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + _mix(words)) | np.uint64(1)


def _in_chunks(texts, size=TOKENS_AT_ONCE):
    """Lists of word arrays with about ``size`` tokens together."""
    held, n = [], 0
    for text in texts:
        held.append(words_of(text))
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row per gram of several sorted (grams, counts)."""
    gram, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(gram, kind="stable")  # merges the sorted runs
    gram = gram[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    return pa.RecordBatch.from_arrays([pa.array(gram[first].view(np.int64)), pa.array(np.add.reduceat(n[order], first))], names=["gram", "n"])


def ngram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n) of all words and word pairs; the grams of a segment of the filter are in one task."""

    def work(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for words in _in_chunks(batch.column(0).to_pylist()):
                held.append(np.unique(np.concatenate([*words, *map(pairs_of, words)]), return_counts=True))
                if sum(len(gram) for gram, _ in held) >= GRAMS_AT_ONCE:
                    yield _summed(held)
                    held = []
        if held:
            yield _summed(held)

    found = texts.select(F.col("text").cast("string")).mapInArrow(work, "gram bigint, n bigint")
    dealt = found.withColumn("segment", F.shiftrightunsigned("gram", 64 - SEGMENT_BITS)).repartition("segment")
    return dealt.groupBy("segment", "gram").agg(F.sum("n").alias("n")).select("gram", "n")


def levels(n: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Level 1 holds exactly ``least`` (the smallest count that is stored) up to BASE times it, and so on."""
    return 1 + np.floor(np.log(np.maximum(n, least) / least) / np.log(BASE) + 1e-9).astype(np.int64)


def count_at(level: np.ndarray, least: float) -> np.ndarray:
    value = least * BASE ** (level - 0.5)
    return np.where(level == 0, 0.0, np.where(level == 1, least, value))


def _positions(grams: np.ndarray, level: int, bits: int, some: range = range(HASHES)) -> tuple[np.ndarray, list[np.ndarray]]:
    """Segment of each key and ``some`` of its bits there; ``bits`` is the size of a segment, a power of two."""
    x = _mix(grams ^ np.uint64((level * 0xA24BAED4963EE407) & (1 << 64) - 1))
    step = _mix(x + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    segment = (grams >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64)
    return segment, [((x + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in some]


def _held(data: np.ndarray, grams: np.ndarray, level: int) -> np.ndarray:
    """Where ``grams`` has keys (gram, level) that the filter ``data`` holds."""
    bits, found = len(data) * 8 >> SEGMENT_BITS, np.arange(len(grams))
    for some in (range(3), range(3, HASHES)):  # most that are absent end with the first
        segment, places = _positions(grams[found], level, bits, some)
        hit = np.ones(len(found), bool)
        for place in places:
            at = segment * bits + place
            hit &= (data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        found = found[hit]
    return found


@dataclass
class Filter:
    """The filter and what its levels mean: word counts start at 1, pair counts at ``least_pair``."""

    data: np.ndarray
    least_pair: float
    top: int
    complete: bool = True  # False: pairs that are in neither filter are in the count table alone
    once: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))  # pairs that occur once, if they are held

    def _level(self, distinct: np.ndarray) -> np.ndarray:
        out, active = np.zeros(len(distinct), np.int64), np.arange(len(distinct))
        for level in range(1, self.top + 1):
            active = active[_held(self.data, distinct[active], level)]
            out[active] = level
            if not len(active):
                break
        return out

    def level(self, grams: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(grams, return_inverse=True)
        return self._level(distinct)[back]

    def words(self, grams: np.ndarray) -> np.ndarray:
        return count_at(self.level(grams), 1.0)

    def pairs(self, grams: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(grams, return_inverse=True)
        n = count_at(self._level(distinct), self.least_pair)
        if len(self.once):
            other = np.flatnonzero(n == 0)
            n[other[_held(self.once, distinct[other], 0)]] = 1.0
        return n[back]

    def outside(self) -> str:
        """SQL for the rows of the count table whose pairs are in neither filter."""
        return f"gram & 1 = 1 and n < {self.least_pair}" + " and n > 1" * bool(len(self.once))


def _level_histogram(counts: DataFrame, is_pair: bool) -> dict[int, int]:
    """Keys by the power of BASE of their count: a few dozen rows."""
    own = counts.where(f"gram & 1 = {int(is_pair)}")
    return {r["q"]: r["n"] for r in own.groupBy(F.floor(F.log(F.col("n")) / F.log(F.lit(BASE)) + 1e-9).alias("q")).agg(F.count(F.lit(1)).alias("n")).collect()}


def _bits_for(keys: int, most_bits: int) -> int:
    bits = LEAST_BITS
    while bits < most_bits and bits < keys * BITS_PER_KEY:
        bits *= 2
    return bits


def _gathered(batches, rows: int = GRAMS_AT_ONCE >> 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of many small batches."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield _columns(held)
            held, n = [], 0
    if n:
        yield _columns(held)


def _columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy().astype(float)


def build_filter(counts: DataFrame, most_bits: int = MOST_BITS) -> Filter:
    """The filter of a stored count table. Each task fills the segments whose keys it holds, few if the table is from ``ngram_counts``."""
    words, pairs = _level_histogram(counts, False), _level_histogram(counts, True)
    singles = pairs.pop(0, 0)
    room = most_bits // LEAST_BITS_PER_KEY - sum((q + 1) * n for q, n in words.items())
    least_level = 1  # pair counts from BASE upwards: 2 and more
    while sum((q - least_level + 1) * n for q, n in pairs.items() if q >= least_level) > max(room, 0) and least_level < max(pairs, default=0) + 1:
        least_level += 1
    keys = sum((q + 1) * n for q, n in words.items()) + sum((q - least_level + 1) * n for q, n in pairs.items() if q >= least_level)
    least_pair = float(np.ceil(BASE**least_level - 1e-9))
    size, once_size = _bits_for(keys, most_bits) >> SEGMENT_BITS, _bits_for(singles, most_bits) >> SEGMENT_BITS
    if singles * LEAST_BITS_PER_KEY > once_size << SEGMENT_BITS:
        once_size = 0  # they stay outside

    def work(batches):
        own: dict[int, int] = {}
        data, once = np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        for grams, n in _gathered(batches):
            pair = (grams & np.uint64(1)).astype(bool)
            alone = pair & (n < 2)
            q = np.where(alone, 0, levels(n, np.where(pair, least_pair, 1.0)))
            for s in np.unique(grams >> np.uint64(64 - SEGMENT_BITS)).astype(int):
                own.setdefault(int(s), len(own))
            data = np.concatenate([data, np.zeros(max(0, len(own) * size // 8 - len(data)), np.uint8)])
            once = np.concatenate([once, np.zeros(max(0, len(own) * once_size // 8 - len(once)), np.uint8)])
            slot = np.zeros(1 << SEGMENT_BITS, np.int64)
            slot[list(own)] = list(own.values())
            for level in range(0 if once_size else 1, int(q.max(initial=0)) + 1):
                into, bits, keyed = (data, size, q >= level) if level else (once, once_size, alone)
                segment, places = _positions(grams[keyed], level, bits)
                for place in places:
                    at = slot[segment] * bits + place
                    np.bitwise_or.at(into, at >> 3, (1 << (at & 7)).astype(np.uint8))
        columns = [[filled[i * bits // 8 : (i + 1) * bits // 8].tobytes() for i in own.values()] for filled, bits in ((data, size), (once, once_size))]
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["segment", "data", "once"])

    kept = counts.where(f"gram & 1 = 0 or n >= {least_pair}" + " or n = 1" * bool(once_size))
    filled = kept.mapInArrow(work, "segment int, data binary, once binary").toArrow()
    data, once = (np.zeros((bits << SEGMENT_BITS) // 8, np.uint8) for bits in (size, once_size))  # at most MOST_BITS / 8 bytes each
    for segment, *parts in zip(filled.column(0).to_pylist(), filled.column(1), filled.column(2)):
        for into, bits, part in ((data, size, parts[0]), (once, once_size, parts[1])):
            into[segment * bits // 8 : (segment + 1) * bits // 8] |= np.frombuffer(part.as_buffer(), np.uint8)
    top = max([1, *(q + 1 for q in words), *(q - least_level + 1 for q in pairs)])
    return Filter(data, least_pair, int(top), not any(q < least_level for q in pairs) and (bool(once_size) or not singles), once)


@dataclass
class Model:
    filter: Filter
    total: int
    distinct: int
    mu: float
    frequent: np.ndarray
    frequent_counts: np.ndarray
    complete: bool

    @property
    def floor(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def parts(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(w), c(v, w) and c(v) of every token, from the filter."""
        flat = np.concatenate(words)
        c = self.filter.words(flat)
        start = self.filter.words(np.array([END], np.uint64) & ~np.uint64(1))[0]
        before = np.concatenate([[start], c[:-1]])
        before[np.cumsum([0, *map(len, words[:-1])])] = start
        pairs = self.filter.pairs(np.concatenate([pairs_of(w) for w in words]))
        return (c + 0.5) / self.floor, pairs, np.maximum(before, pairs)

    def log10(self, p: np.ndarray, pair: np.ndarray, context: np.ndarray, mu: float | None = None) -> np.ndarray:
        mu = self.mu if mu is None else mu
        return np.log10((pair + mu * p) / (context + mu))

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Exact counts of words in the broadcast table; 0 for others."""
        if not len(self.frequent):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
        return np.where(self.frequent[at] == words, self.frequent_counts[at], 0)


def _counted(texts: DataFrame, most_bits: int, frequent_words: int) -> tuple[Model, DataFrame]:
    """The model of a table of texts before its mu is chosen, and the stored table (gram, n) of exact counts."""
    counts = materialize(ngram_counts(texts), "ngram-counts")
    words = counts.where("gram & 1 = 0")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    histogram, room, level = _level_histogram(counts, False), frequent_words, 0
    for q in sorted(histogram, reverse=True):
        room -= histogram[q]
        if room < 0:
            level = q + 1
            break
    # at most `frequent_words` rows
    often = words.where(F.floor(F.log(F.col("n")) / F.log(F.lit(BASE)) + 1e-9) >= level).toArrow()
    grams, n = often.column("gram").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(grams)
    return Model(build_filter(counts, most_bits), int(total), int(distinct), MUS[-1], grams[order], n[order], level == 0), counts


SCORED = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_sum double, scores array<double>, less_own array<double>, " \
    "rare array<struct<word: bigint, n: bigint>>, unseen array<struct<gram: bigint, k: bigint, p: double, context: double>>"


def _measured(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Sums of every row (text, row, doc_id, held_out) under each of MUS, stored: ``scores``, and ``less_own``
    with each token's own occurrence taken off the counts, which holds for training rows only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # filters and frequent words, all bounded
    kind = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))
    asks = pa.list_(pa.struct([("gram", pa.int64()), ("k", pa.int64()), ("p", pa.float64()), ("context", pa.float64())]))

    def work(batches):
        m = shared.value
        for batch in batches:
            done = 0
            for chunk in _in_chunks(batch.column(0).to_pylist()):
                size = np.array([len(w) for w in chunk])
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                flat = np.concatenate(chunk)
                c = m.exact(flat)
                known = np.add.reduceat((c > 0).astype(np.int64), first)
                certain = (c > 0) | m.complete
                base = np.add.reduceat(np.where(certain, np.log10((c + 0.5) / m.floor), 0.0), first)
                p, pair, context = m.parts(chunk)
                less = np.maximum(pair - 1, 0)
                sums = [
                    np.stack([np.add.reduceat(m.log10(p, a, b, mu), first) for mu in MUS], axis=1)
                    for a, b in ((pair, context), (less, np.maximum(context - 1, less)))
                ]
                unseen = pa.nulls(len(chunk), asks)
                if not m.filter.complete:
                    here = np.flatnonzero(pair == 0)
                    gram, text = np.concatenate([pairs_of(w) for w in chunk])[here], np.repeat(np.arange(len(chunk)), size)[here]
                    order = np.lexsort((gram, text))
                    here, gram, text = here[order], gram[order], text[order]
                    own = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])])[: len(here)])
                    columns = [gram[own].view(np.int64), np.diff(own, append=len(here)), p[here[own]], context[here[own]]]
                    starts = np.searchsorted(text[own], np.arange(len(chunk) + 1)).astype(np.int32)
                    unseen = pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["gram", "k", "p", "context"]))
                rare: list = [None] * len(chunk)
                if not m.complete:
                    for i, w in enumerate(chunk):
                        own, n = np.unique(w[~certain[first[i] : first[i] + size[i]]], return_counts=True)
                        rare[i] = [{"word": int(a), "n": int(b)} for a, b in zip(own.view(np.int64), n)] if len(own) else None
                part = batch.slice(done, len(chunk))
                done += len(chunk)
                lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(MUS), dtype=np.int32), x.ravel()) for x in sums]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(size), pa.array(known), pa.array(base), *lists, pa.array(rare, kind), unseen],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_sum", "scores", "less_own", "rare", "unseen"])

    scored = stored = materialize(docs.select("text", "row", "doc_id", "held_out").mapInArrow(work, SCORED), "scored")
    if not model.complete:
        asked = stored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("gram"), F.col("r.n").alias("k"))
        found = asked.join(counts.where("gram & 1 = 0"), "gram", "left").select("row", "k", F.coalesce("n", F.lit(0)).alias("c"))
        more = found.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.log10((F.col("c") + 0.5) / F.lit(model.floor))).alias("more_base"))
        scored = scored.join(more, "row", "left").withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0))).withColumn("base_sum", F.col("base_sum") + F.coalesce("more_base", F.lit(0.0)))
    if not model.filter.complete:
        asked = stored.select("row", F.explode("unseen").alias("u")).select("row", "u.*")
        found = asked.join(counts.where(model.filter.outside()), "gram").select("row", "k", "p", "context", F.col("n").cast("double").alias("n"))

        def gain(mu, own):
            """What n occurrences instead of none add, ``own`` of them taken off."""
            weight, without = F.lit(mu) * F.col("p"), F.greatest(F.col("context") - own, F.lit(0.0))
            n = F.col("n") - own
            return F.sum(F.col("k") * (F.log10((n + weight) / (F.greatest(without, n) + mu)) - F.log10(weight / (without + mu))))

        more = found.repartition("row").groupBy("row").agg(*[gain(mu, own).alias(f"{name}_{i}") for name, own in (("scores", 0.0), ("less_own", 1.0)) for i, mu in enumerate(MUS)])
        scored = scored.drop("rare", "unseen").join(more, "row", "left")
        for name in ("scores", "less_own"):
            scored = scored.withColumn(name, F.array(*[F.col(name)[i] + F.coalesce(f"{name}_{i}", F.lit(0.0)) for i in range(len(MUS))]))
        scored = materialize(scored.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_sum", "scores", "less_own"), "scored")
    return scored


def _fitted(docs: DataFrame, most_bits: int, frequent_words: int) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the rows (text, row, doc_id, held_out) that are not held out, the table of counts, and what ``_measured`` gives for all rows.

    mu is the one of MUS under which all training texts are most probable, with each token's own occurrence taken off.
    """
    bounded_batches(docs.sparkSession)
    model, counts = _counted(docs.where(~F.col("held_out")).select("text"), most_bits, frequent_words)
    measured = _measured(docs, model, counts)
    sums = measured.where(~F.col("held_out")).agg(*[F.sum(F.col("less_own")[i]) for i in range(len(MUS))]).first()
    model.mu = MUS[int(np.argmax([x or 0.0 for x in sums]))]
    return model, counts, measured


def fit(texts: DataFrame, most_bits: int = MOST_BITS, frequent_words: int = FREQUENT_WORDS) -> tuple[Model, DataFrame]:
    """The model of a table of texts, and the stored table (gram, n) of exact counts."""
    docs = texts.select(F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"), F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"))
    return _fitted(docs, most_bits, frequent_words)[:2]


def held_out():
    return remainder() == 1


def score_documents(docs: DataFrame, most_bits: int = MOST_BITS, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """Scores of every document under the model of those not held out.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A NULL or empty text has one
    token, the end. Without training texts N and V are 0 and the base gives log10(0.5 / 0.5) = 0.
    Repeated rows get rows each. Long texts count whole. An empty table gives an empty result.
    """
    narrow = docs.select(F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"))
    model, _, measured = _fitted(narrow, most_bits, frequent_words)
    return measured.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), F.col("base_sum").alias("base_score"), F.col("scores")[MUS.index(model.mu)].alias("score"))
