"""Packing of tokenised documents into windows by order-preserving dynamic programming.

Documents keep their order (ascending doc_id). The token stream is cut into
windows of at most ``length`` tokens. Candidate cuts are document ends
(free), sentence ends (a small penalty) and, inside long sentences, every
``STRIDE`` tokens (a larger penalty). The cost of a window is its padding plus
the penalty of the cut that ends it. As padding is linear in the positions,
``best[j] = length - at[j] + penalty[j] + min(best[i] + at[i])`` over the cuts i
within ``length`` before j: a sliding minimum, kept by a monotone queue.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsieve.llm.common import bounded_batches, ranges

LENGTH = 2048
END_ID = 1
SENTENCE_PENALTY = 4.0
CUT_PENALTY = 12.0
STRIDE = 32
#: Windows planned at once, and windows at the end of a plan that the next plan may still change.
PLAN_WINDOWS, OPEN_WINDOWS = 256, 8
#: Words, and parts of words, whose ids a worker keeps (some 100 MB in all).
CACHE_WORDS = 500_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint, padding bigint"


# How the tokenizer's file cuts a lower-cased word of these letters and signs.
PLAIN_WORD = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PLAIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
ASCII_WORD = re.compile(b"[!-~]+")
ASCII_PARTS = re.compile(b"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
LATIN = "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))


class Known(dict):
    """Values by key, made when first asked for. The store is of bounded size: when it is half full it starts anew, and
    what is still used moves over."""

    def __init__(self, make, before: dict):
        super().__init__()
        self.make, self.before = make, before

    def __missing__(self, key):
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def aged(self, most: int) -> Known:
        if 2 * len(self) <= most:
            return self
        self.before = {}
        return Known(self.make, self)


class WordTokenizer:
    """Ids of whole texts, from the ids of their words.

    The tokenizer never joins anything across ASCII white space, so a text has the concatenated ids
    of its words; each distinct word is encoded once. A word of printable ASCII and Latin-1 letters has those of the
    parts that the file's rules cut it into, whatever its case, and each distinct part goes to the model
    alone; such a part, met as a word, has the same ids, so words and parts share one store. All other words, and those that may hold a special token, take the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelt = {ord(c): spell(c)[0][0] for c in LATIN}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size + 2, bool)
        for token, i in self.tokenizer.get_vocab().items():
            word = token.removesuffix("</w>")
            self.ends[i] = token.endswith("</w>") and word[-1:] in ".!?"
        self.known = Known(self._make, {})  # unsigned 32-bit ids, of words and of parts: a part is a word too

    def _make(self, word: bytes) -> bytes:
        if word.isalpha():  # of bytes: ASCII letters alone
            parts = [word.lower()]
        elif b"<" in word and any(s in word.decode() for s in self.special):
            return self._whole(word)
        elif ASCII_WORD.fullmatch(word):
            parts = ASCII_PARTS.findall(word.lower())
        elif PLAIN_WORD.fullmatch(text := word.decode()):
            parts = [p.encode() for p in PLAIN_PARTS.findall(text.lower())]
        else:
            return self._whole(word)
        if parts != [word]:
            return b"".join([self.known[p] for p in parts])
        text = word.decode()
        return array("I", [t.id for t in self.model.tokenize(text if word.isascii() else text.translate(self.spelt))]).tobytes()

    def _whole(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        end = array("I", [END_ID]).tobytes()
        self.known = self.known.aged(CACHE_WORDS)
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, (t or "").encode("utf-8", "replace").split())) + end, np.uint32) for t in texts]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def candidates(ids: np.ndarray, ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Cuts inside one document, its end included: positions and penalties, ascending."""
    n = len(ids)
    sentence = np.flatnonzero(ends[ids[:-1]]) + 1
    bounds = np.append(sentence, n)
    begin = np.concatenate([[0], bounds[:-1]])
    inner = (bounds - begin - 1) // stride
    long = np.flatnonzero(inner)
    at, penalty = bounds, np.full(len(bounds), SENTENCE_PENALTY)
    penalty[-1] = 0.0
    if len(long):
        hard = np.repeat(begin[long], inner[long]) + stride * ranges(np.ones(len(long), int), inner[long])
        at = np.concatenate([bounds, hard])
        penalty = np.concatenate([penalty, np.full(len(hard), CUT_PENALTY)])
        order = np.argsort(at, kind="stable")
        at, penalty = at[order], penalty[order]
    return at, penalty


def choose_cuts(at: list[int], penalty: list[float], length: int = LENGTH) -> list[int]:
    """The cuts, from those at ascending positions ``at`` (gaps at most ``length``), with the least
    padding plus penalties that end the stream at its last position; the start, 0, is not returned."""
    positions = [0, *at]
    costs = [0.0, *penalty]
    value = [0.0] * len(positions)  # best[i] + at[i]
    back = [0] * len(positions)
    queue = deque([0])
    for j in range(1, len(positions)):
        here = positions[j]
        while positions[queue[0]] < here - length:
            queue.popleft()
        i = queue[0]
        back[j] = i
        now = value[i] + length + costs[j]  # best[j] + at[j]
        value[j] = now
        while queue and value[queue[-1]] > now:
            queue.pop()
        queue.append(j)
    out, j = [], len(positions) - 1
    while j:
        out.append(positions[j])
        j = back[j]
    return out[::-1]


def tail_cuts(begin: int, end: int, length: int = LENGTH) -> list[int]:
    """The last window may have no padding if it is cut into powers of two; done if padding costs more than the cuts."""
    n = end - begin
    powers = [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]
    if length - n <= CUT_PENALTY * (len(powers) - 1):
        return [end]
    return [begin + int(x) for x in np.cumsum(powers)]


class Packer:
    """Takes documents in order, gives pieces; holds a bounded number of open windows and the current documents."""

    def __init__(self, first_sequence: int, length: int = LENGTH):
        self.sequence, self.length = first_sequence, length
        self.docs: deque[tuple] = deque()  # (doc_id, ids, start in the stream)
        self.at: list[np.ndarray] = []
        self.penalty: list[np.ndarray] = []
        self.total = 0

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray):
        at, penalty = candidates(ids, ends)
        # a very long document is planned in steps, so that only its ids are held, not its windows
        for a in range(0, len(at), 1 << 16):
            if a == 0:
                self.docs.append((doc_id, ids, self.total))
            self.at.append(at[a : a + (1 << 16)] + self.docs[-1][2])
            self.penalty.append(penalty[a : a + (1 << 16)])
            self.total = int(self.at[-1][-1])
            if self.total >= (PLAN_WINDOWS + OPEN_WINDOWS) * self.length:
                yield from self.flush(False)

    def flush(self, final: bool):
        if not self.at:
            return
        at, penalty = np.concatenate(self.at), np.concatenate(self.penalty)
        cuts = choose_cuts(at.tolist(), penalty.tolist(), self.length)
        if final:
            cuts[-1:] = tail_cuts(cuts[-2] if len(cuts) > 1 else 0, cuts[-1], self.length)
        else:
            cuts = cuts[:-OPEN_WINDOWS]
        begin = 0
        for end in cuts:
            yield from self.window(begin, end)
            begin = end
        keep = at > begin
        self.at, self.penalty = ([at[keep] - begin], [penalty[keep]]) if keep.any() else ([], [])
        self.docs = deque((d, ids, start - begin) for d, ids, start in self.docs if start + len(ids) > begin)
        self.total -= begin

    def window(self, begin: int, end: int):
        n = end - begin
        padding = 0 if n & (n - 1) == 0 else self.length - n
        while self.docs and self.docs[0][2] + len(self.docs[0][1]) <= begin:
            self.docs.popleft()
        for doc_id, ids, start in self.docs:
            if start >= end:
                break
            a, b = max(begin, start), min(end, start + len(ids))
            crc = zlib.crc32(ids[a - start : b - start].astype("<u4").tobytes())
            yield doc_id, a - start, b - a, crc, len(ids), self.sequence, a - begin, padding
        self.sequence += 1


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """All documents in sequences of at most ``length`` tokens, one row per piece (see PIECES).

    Documents are dealt to tasks by ranges of doc_id and packed there in one pass: a task holds a few
    hundred windows. Only the last window of a task is not planned with what follows. A NULL text is
    empty and has the one token that ends it; NULL ids come first; repeated rows are packed each.
    An empty table gives an empty result. ``padding`` is 0 in a sequence whose length is a power of two.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = narrow.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")

    def work(batches):
        from pyspark import TaskContext

        words = tokenizer(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 40, length)
        names = PIECES.replace("`", "").replace(" bigint", "").split(", ")

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)

        rows: list[tuple] = []
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist())):
                rows.extend(packer.add(doc_id, ids, words.ends))
            if rows:
                yield out(rows)
                rows = []
        rows.extend(packer.flush(True))
        if rows:
            yield out(rows)

    return ordered.mapInArrow(work, PIECES)
