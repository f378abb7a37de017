"""Spelling variants grouped by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced code point turns one into
the other. Every word generates its deletions and its replacements by a larger
code point (each near pair then comes up exactly once: the longer word, or the
smaller one, finds the other). The hash of an edited word follows from the hash
of the word in one step, so edits are probed as whole arrays, without building
strings, against blocked Bloom filters of the vocabulary: one filter per word
length, cut into segments of bounded size, each probe reading one 64-bit block.
Only edits that the filters hold are written out and joined with the vocabulary,
which removes the false hits. Filters are broadcast in rounds of bounded bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.session import materialize

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG = 64  # words of this length and more share a filter
SEGMENT_WORDS = 1 << 20
BITS_PER_WORD = 32
ROUND_BYTES = 32 << 20
CELLS_AT_ONCE = 1 << 20

U = np.uint64
#: Odd multipliers and shifts of a common 64-bit mixer.
MIX = (U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX[1]
    x = (x ^ (x >> U(27))) * MIX[2]
    return x ^ (x >> U(31))


def letter_hash(position: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A random number for a code point at a position; the hash of a word is the sum over its letters."""
    return mixed((position.astype(U) << U(32)) + code.astype(U) + MIX[0])


def codes_of(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    return letter_hash(np.arange(codes.shape[1])[None, :], codes).sum(axis=1, dtype=U)


def by_length(words: list[str], cells: int = CELLS_AT_ONCE):
    """Positions of words of one length, a bounded number of letters at once."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        step = max(1, cells // max(1, int(sizes[part[0]])))
        for a in range(0, len(part), step):
            yield int(sizes[part[0]]), part[a : a + step]


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (mixed(hashes) % U(segments)).astype(np.int64) if segments > 1 else np.zeros(hashes.shape, np.int64)


def block_and_mask(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit block of a hash by its upper half, and four bits inside it by the lower one."""
    at = ((hashes >> U(32)) * U(blocks)) >> U(32)
    mask = U(1) << (hashes & U(63))
    for shift in (6, 12, 18):
        mask = mask | (U(1) << ((hashes >> U(shift)) & U(63)))
    return at, mask


def bloom(hashes: np.ndarray) -> np.ndarray:
    blocks = max(1, -(-len(hashes) * BITS_PER_WORD // 64))
    out = np.zeros(blocks, U)
    at, mask = block_and_mask(hashes, blocks)
    np.bitwise_or.at(out, at.astype(np.int64), mask)
    return out


class Filters:
    """The filters of one round: for each length its number of segments, and the segments that are here."""

    def __init__(self, segments: dict[int, int], here: dict[tuple[int, int], np.ndarray]):
        self.segments, self.here = segments, here
        self.lengths = {length for length, _ in here}

    def hold(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Which hashes of words of ``length`` letters are in the filters of this round."""
        shard = min(length, LONG)
        if shard not in self.lengths:
            return np.zeros(hashes.shape, bool)
        n = self.segments[shard]
        if n == 1:
            return self._probe(self.here[shard, 0], hashes)
        found, own = np.zeros(hashes.shape, bool), segment_of(hashes, n)
        for s in range(n):
            if (shard, s) in self.here:
                mine = own == s
                found[mine] = self._probe(self.here[shard, s], hashes[mine])
        return found

    @staticmethod
    def _probe(blocks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at, mask = block_and_mask(hashes, len(blocks))
        return (blocks[at.astype(np.int64)] & mask) == mask


def held_edits(words: list[str], letters: np.ndarray, filters: Filters):
    """(position of the word, edited word) for every deletion, and every replacement by a larger letter, that the filters hold."""
    for length, part in by_length(words):
        codes = codes_of([words[i] for i in part])
        places = np.arange(length)[None, :]
        own = letter_hash(places, codes)
        whole = own.sum(axis=1, dtype=U)
        if min(length - 1, LONG) in filters.lengths and length > 1:
            moved = letter_hash(places - (places > 0), codes)  # as if one letter further left; the first never moves
            behind = moved[:, ::-1].cumsum(axis=1, dtype=U)[:, ::-1] - moved
            edited = own.cumsum(axis=1, dtype=U) - own + behind
            held = filters.hold(length - 1, edited)
            held[:, 1:] &= codes[:, 1:] != codes[:, :-1]  # either of two equal neighbours leaves the same word
            for i, p in zip(*map(np.ndarray.tolist, np.nonzero(held))):
                word = words[part[i]]
                yield int(part[i]), word[:p] + word[p + 1 :]
        if min(length, LONG) not in filters.lengths:
            continue
        step = max(1, CELLS_AT_ONCE // max(1, len(letters)))
        for p in range(length):
            other = letter_hash(np.array([p]), letters)
            for a in range(0, len(part), step):
                i, c = np.nonzero(letters[None, :] > codes[a : a + step, p, None])
                probes = (whole[a : a + step] - own[a : a + step, p])[i] + other[c]
                held = np.flatnonzero(filters.hold(length, probes))
                for k, c_k in zip((i[held] + a).tolist(), letters[c[held]].tolist()):
                    word = words[part[k]]
                    yield int(part[k]), word[:p] + chr(c_k) + word[p + 1 :]


def words_of(docs: DataFrame, least_length: int = 7) -> DataFrame:
    """(word): each run of letters that keeps ``least_length`` code points, as the contract edits it, one row an occurrence.

    Runs are lower-cased in A-Z only; where 31 divides the crc32 of ``doc_id:run``, one code point goes.
    A NULL doc_id counts as empty, a NULL text has no words.
    """
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"),
    )
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    gone = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))
    word = F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length)


def shard(length: Column) -> Column:
    return F.least(length, F.lit(LONG)).cast("int")


def build_filters(vocabulary: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(shard, segment, bits), stored, and the number of segments of each shard (at most ``LONG`` of them)."""
    sizes = vocabulary.groupBy(shard(F.length("word")).alias("shard")).count().collect()
    segments = {r["shard"]: max(1, -(-r["count"] // SEGMENT_WORDS)) for r in sizes}

    def hashes(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, part in by_length(words):
                h, own = word_hashes(codes_of([words[i] for i in part])), min(length, LONG)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), own, np.int32)), pa.array(segment_of(h, segments[own]), pa.int32()), pa.array(h.view(np.int64))],
                    names=["shard", "segment", "h"],
                )

    def bits(key, table):
        made = bloom(table["h"].to_numpy().view(U)).tobytes()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "segment": pa.array([key[1].as_py()], pa.int32()), "bits": pa.array([made], pa.binary())})

    hashed = vocabulary.select("word").mapInArrow(hashes, "shard int, segment int, h bigint")
    return materialize(hashed.groupBy("shard", "segment").applyInArrow(bits, "shard int, segment int, bits binary"), "filters"), segments


def rounds_of(filters: DataFrame, round_bytes: int = ROUND_BYTES) -> list[list[tuple[int, int]]]:
    """The segments dealt to rounds of at most ``round_bytes`` (or one segment)."""
    out, held = [], 0
    for r in sorted(filters.select("shard", "segment", F.octet_length("bits").alias("bytes")).collect()):
        if not out or held + r["bytes"] > round_bytes:
            out.append([])
            held = 0
        out[-1].append((r["shard"], r["segment"]))
        held += r["bytes"]
    return out


def near_pairs(vocabulary: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, other, other_n): each pair of near words of a stored vocabulary (word, n) once."""
    spark = vocabulary.sparkSession
    filters, segments = build_filters(vocabulary)
    alphabet = vocabulary.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()
    letters = np.array(sorted(ord(r["c"]) for r in alphabet if r["c"]), np.uint32)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * 2)
    dealt = vocabulary.repartition(parts, "word").sortWithinPartitions(F.length("word"))
    found = None
    for chosen in rounds_of(filters, round_bytes):
        at = F.concat_ws("/", "shard", "segment").isin([f"{a}/{b}" for a, b in chosen])
        here = {(r["shard"], r["segment"]): np.frombuffer(bytes(r["bits"]), U) for r in filters.where(at).collect()}
        sent = spark.sparkContext.broadcast((segments, here))

        def probe(batches, sent=sent):
            known = Filters(*sent.value)
            for batch in batches:
                words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
                hits = list(held_edits(words, letters, known))
                at = [i for i, _ in hits]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[i] for i in at], pa.string()), pa.array(n[at] if at else [], pa.int64()), pa.array([w for _, w in hits], pa.string())],
                    names=["word", "n", "other"],
                )

        hits = materialize(dealt.select("word", "n").mapInArrow(probe, "word string, n bigint, other string"), "edits")
        sent.destroy()
        found = hits if found is None else found.union(hits)
    if found is None:
        found = vocabulary.select("word", "n", F.col("word").alias("other")).limit(0)
    return found.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last one, each round doubling the steps."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(docs: DataFrame, least_length: int = 7, least_n: int = 2, factor: int = 10, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row per word of the texts: word, n, n_near, form, form_n, root.

    Words are counted over all whole texts (see ``words_of``) and kept from ``least_n`` occurrences on. The form of a
    word is its near word of largest n, if that is at least ``factor`` times its own; of equals the first by code points.
    ``root`` follows forms to the last, so a word without form is its own. NULL and empty texts add nothing;
    repeated rows count each. An empty table gives an empty result. Other columns are ignored.
    """
    counted = words_of(docs, least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)
    vocabulary = materialize(counted, "vocabulary")
    pairs = near_pairs(vocabulary, round_bytes)
    ways = F.array(
        F.struct(F.col("word").alias("word"), F.col("n").alias("n"), F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    sides = pairs.select(F.explode(ways).alias("s")).select("s.*")
    fits = F.col("near_n") >= factor * F.col("n")
    best = F.min(F.when(fits, F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))))
    near = materialize(sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n")), "near")
    roots = last_forms(near.where("form is not null"))
    out = vocabulary.join(near, "word", "left").join(roots, "word", "left")
    return out.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )
