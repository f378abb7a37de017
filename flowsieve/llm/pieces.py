"""N-best SentencePiece segmentation of whole texts, and decoding.

The best scores of all prefixes (forward Viterbi) are the exact heuristic of a backward A-star
search over the piece lattice, so complete segmentations leave the agenda best first.
Where no piece holds two neighbouring characters, every segmentation has a border between them, so a text's
lattice is a chain of small ones (words and marks): each is searched once, and the N best texts follow
from the links' N best. The vocabulary has merge ranks, no probabilities; a piece of rank r scores
``-ln(r + 2)`` (Zipf's law), in whole thousandths, so equal scores are exactly equal.
"""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowsieve.llm.common import id_and_text, runs

SPACE = "▁"
SCALE = 1000
CACHE_WORDS = 300_000
GROUP = 500_000
LINK = 48
NEVER = -(1 << 60)
OUTPUT = "doc_id bigint, rank int, score double, n_pieces bigint, ids_crc32 bigint, n_words bigint, round_trip boolean"


class Lattice:
    """Pieces of a vocabulary file and the search over them."""

    def __init__(self, path: str, n: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.n = n
        self.scores: dict[str, tuple[int, int]] = {}
        self.byte_ids = [0] * 256
        self.bytes_of: list[bytes] = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.scores[piece] = (i, round(-SCALE * math.log(i + 2)))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.scores))
        self.byte_score = round(-SCALE * (math.log(size + 2) + 1))
        # every piece, and every beginning of one (None), so that a look-up ends where no piece can go on
        self.starts: dict[str, tuple[int, int] | None] = {p[:k]: None for p in self.scores for k in range(1, len(p))} | self.scores
        self.links: dict[str, tuple[int, int | None, bytes]] = {}
        self.choices: dict[str, list[tuple[int, bytes]]] = {}
        self._arrays()

    def _arrays(self) -> None:
        """The same tables for whole arrays: numbers of characters (0: in no piece), pairs inside pieces, steps from beginning to beginning."""
        letters = sorted({c for p in self.scores for c in p})
        self.number = np.zeros(max(map(ord, letters)) + 2, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number, self.width = {c: i for i, c in enumerate(letters, 1)}, len(letters) + 1
        self.inside = np.zeros((self.width, self.width), bool)
        for p in self.scores:
            for a, b in zip(p, p[1:]):
                self.inside[number[a], number[b]] = True
        node = {"": 0} | {p: i for i, p in enumerate(sorted(self.starts), 1)}
        step = sorted((node[p[:-1]] * self.width + number[p[-1]], i) for p, i in node.items() if p)
        self.step_key, self.step_to = (np.array(x, np.int64) for x in zip(*step))
        self.piece_of = np.full(len(node), -1, np.int32)
        self.score_of = np.zeros(len(node), np.int64)
        for p, (i, score) in self.scores.items():
            self.piece_of[node[p]], self.score_of[node[p]] = i, score

    def numbers(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        return self.number[np.minimum(codes, len(self.number) - 1)]

    def chain(self, text: str) -> list[str]:
        """The text cut wherever no piece holds both neighbours."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        c = self.numbers(text)
        cuts = [0, *(np.flatnonzero(~self.inside[c[:-1], c[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, links: set[str]) -> None:
        """Fill ``links`` for new strings: whole arrays for those up to LINK characters, one by one for longer ones and unknown characters."""
        many = [w for w in links if len(w) <= LINK]
        for w in links:
            if len(w) > LINK:
                self.links[w] = self.forward(w)
        if many:
            self._forward_many(many)

    def _forward_many(self, many: list[str]) -> None:
        """``forward`` for many strings: all edges first, then the positions of all strings abreast."""
        sizes = np.array([len(w) for w in many])
        ends = np.cumsum(sizes + 1) - 1  # the last node of each string; its character is the end mark
        c = self.numbers("\0".join(many) + "\0")
        c[ends] = 0
        offset = np.arange(len(c)) - np.repeat(ends - sizes, sizes + 1)
        begins, lengths, nodes = [], [], []
        at, node, length = np.flatnonzero(c), np.zeros(np.count_nonzero(c), np.int64), 0
        while len(at):
            key = node * self.width + c[at + length]
            place = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
            alive = (self.step_key[place] == key) & (c[at + length] > 0)
            at, node, length = at[alive], self.step_to[place[alive]], length + 1
            full = self.piece_of[node] >= 0
            begins.append(at[full])
            nodes.append(node[full])
            lengths.append(np.full(int(full.sum()), length))
        begin, node, length = (np.concatenate(x) for x in (begins, nodes, lengths))
        single = np.zeros(len(c), bool)
        single[begin[length == 1]] = True
        single[ends] = True
        odd = np.minimum.reduceat(single, ends - sizes) == 0
        order = np.lexsort((length, offset[begin]))
        begin, node, length = begin[order], node[order], length[order]
        group = offset[begin] * (self.longest + 1) + length
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        one, two = np.full(len(c), NEVER), np.full(len(c), NEVER)
        one[ends - sizes] = 0
        back, piece = np.zeros(len(c), np.int64), np.zeros(len(c), np.int32)
        value_of, piece_of, target = self.score_of[node], self.piece_of[node], begin + length
        for a, b in zip(bounds, bounds[1:]):  # one edge a string in each group, so no two meet the same end
            frm, to, value = begin[a:b], target[a:b], value_of[a:b]
            new, old = one[frm] + value, one[to]
            better = new > old
            two[to] = np.maximum(two[to], np.where(better, np.maximum(old, two[frm] + value), new))
            won = to[better]
            one[won], back[won], piece[won] = new[better], frm[better], piece_of[a:b][better]
        owner, steps, taken = [], [], []
        who = np.flatnonzero(~odd)
        at, k = ends[who], 0
        while len(who):
            owner.append(who)
            steps.append(np.full(len(who), -k))
            taken.append(piece[at])
            at, k = back[at], k + 1
            left = offset[at] > 0
            who, at = who[left], at[left]
        score, gap = one[ends].tolist(), (one[ends] - two[ends]).tolist()
        if owner:
            owner, steps, taken = (np.concatenate(x) for x in (owner, steps, taken))
            taken = taken[np.lexsort((steps, owner))]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(many)))]).tolist() if len(owner) else [0] * (len(many) + 1)
        for i, w in enumerate(many):
            if odd[i]:
                self.links[w] = self.forward(w)
            else:
                self.links[w] = (score[i], gap[i] if gap[i] < -(NEVER // 2) else None, taken[cuts[i]:cuts[i + 1]].tobytes())

    def forward(self, word: str) -> tuple[int, int | None, bytes]:
        """Score of the best segmentation, what the second best has less (None if there is but one), and the best one's ids.

        Each position keeps its two best scores: a second best path ends in one of them. Among equal scores the longest last piece
        comes first, as in the search below.
        """
        size, starts = len(word), self.starts
        one, two, back = [NEVER] * (size + 1), [NEVER] * (size + 1), [None] * (size + 1)
        one[0] = 0
        for begin in range(size):
            first, second = one[begin], two[begin]
            single = False
            for end in range(begin + 1, size + 1):
                part = word[begin:end]
                if part not in starts:
                    break
                found = starts[part]
                if found is None:
                    continue
                single = single or end == begin + 1
                value = first + found[1]
                if value > one[end]:
                    two[end] = max(one[end], second + found[1])
                    one[end], back[end] = value, (begin, found[0])
                elif value > two[end]:
                    two[end] = value
            if not single:
                end = begin + 1
                extra = self.byte_score * len(word[begin].encode("utf-8", "replace"))
                if first + extra > one[end]:
                    two[end] = max(one[end], second + extra)
                    one[end], back[end] = first + extra, (begin, None)
                elif first + extra > two[end]:
                    two[end] = first + extra
        ids: list[int] = []
        at = size
        while at:
            begin, piece = back[at]
            if piece is None:
                ids.extend(self.byte_ids[b] for b in reversed(word[begin].encode("utf-8", "replace")))
            else:
                ids.append(piece)
            at = begin
        return one[size], one[size] - two[size] if two[size] > NEVER // 2 else None, array("i", reversed(ids)).tobytes()

    def n_best(self, word: str, n: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
        """The n best segmentations, (score, ids), best first; ties by search order, which depends on the word alone."""
        n, size, pieces, longest = n or self.n, len(word), self.scores, self.longest
        into: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        best = [0] * (size + 1)
        for end in range(1, size + 1):
            top, edges = None, into[end]
            for begin in range(max(0, end - longest), end):
                found = pieces.get(word[begin:end])
                if found:
                    edges.append((begin, found[1], (found[0],)))
                    value = best[begin] + found[1]
                    if top is None or value > top:
                        top = value
            if not edges or edges[-1][0] != end - 1:
                raw = word[end - 1].encode("utf-8", "replace")
                edges.append((end - 1, self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)))
                value = best[end - 1] + edges[-1][1]
                if top is None or value > top:
                    top = value
            best[end] = top
        out, serial = [], 0
        # (minus the score of the whole, position, order of insertion, score of the suffix, its ids as a chain), best first.
        # Every entry leads to a whole text of exactly its score, and no two to the same one, so more than are still wanted need not wait.
        agenda = [(-best[size], size, 0, 0, None)]
        while agenda and len(out) < n:
            whole, at, _, suffix, chain = agenda.pop(0)
            if not at:
                ids: list[int] = []
                while chain:
                    ids.extend(chain[0])
                    chain = chain[1]
                out.append((-whole, tuple(ids)))
                continue
            room = n - len(out)
            for begin, value, own in into[at]:
                value += suffix
                serial += 1
                entry = (-(best[begin] + value), begin, serial, value, (own, chain))
                if len(agenda) < room:
                    insort(agenda, entry)
                elif entry < agenda[-1]:
                    agenda.pop()
                    insort(agenda, entry)
        return out

    def alternatives(self, word: str) -> list[tuple[int, bytes]]:
        """(what it has less than the best, ids) of the second to the n-th best segmentation."""
        found = self.choices.get(word)
        if found is None:
            if len(self.choices) >= CACHE_WORDS // 8:
                self.choices.clear()
            top, *more = self.n_best(word)
            found = self.choices[word] = [(top[0] - s, array("i", ids).tobytes()) for s, ids in more]
        return found

    def encode_all(self, texts: list[str]) -> Iterator[list[tuple[int, np.ndarray]]]:
        """``encode`` of each text; new links of texts of together GROUP characters (or of one text) are learnt at once."""
        for a, b in runs(np.array([len(t) for t in texts]), GROUP):
            chains = [self.chain(t) for t in texts[a:b]]
            if len(self.links) > CACHE_WORDS:
                self.links.clear()
            self.learn(set().union(*chains).difference(self.links))
            for words in chains:
                yield self._encode(words)

    def encode(self, text: str) -> list[tuple[int, np.ndarray]]:
        """The N best segmentations of a whole text, (score, ids)."""
        return next(self.encode_all([text]))

    def _encode(self, words: list[str]) -> list[tuple[int, np.ndarray]]:
        """Only the N - 1 links whose second choice costs least can differ, so only those are searched for more than their two best scores."""
        known = self.links
        found = [known[w] for w in words]
        parts = [f[2] for f in found]
        total = sum([f[0] for f in found])
        gaps = ((f[1], at) for at, f in enumerate(found) if f[1] is not None)
        states: list[tuple[int, tuple]] = [(0, ())]
        for _, at in heapq.nsmallest(self.n - 1, gaps):
            choices = [(0, None), *self.alternatives(words[at])]
            joined = [(cost + extra, changes if ids is None else (*changes, (at, ids))) for cost, changes in states for extra, ids in choices]
            states = heapq.nsmallest(self.n, joined, key=lambda s: (s[0], [(at, np.frombuffer(ids, np.int32).tolist()) for at, ids in s[1]]))
        out = []
        for cost, changes in states:
            own = parts
            if changes:
                own = list(parts)
                for at, ids in changes:
                    own[at] = ids
            out.append((total - cost, np.frombuffer(b"".join(own), np.int32)))
        return out

    def decode(self, ids) -> str:
        """The text of ids, without the space that encoding puts first."""
        names = self.bytes_of
        text = b"".join([names[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def lattice(path: str, n: int) -> Lattice:
    return Lattice(path, n)


def segment(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """A row for each document and each of its ``n`` best segmentations (fewer if there are fewer); see OUTPUT.

    NULL and empty texts have one segmentation, without pieces. A space mark in a text decodes as a space.
    ``round_trip`` tells whether the decoded ids of rank 1 give the text again. Whole texts of any length; repeated rows get
    rows each; an empty table gives an empty result.
    """

    def work(batches):
        own = lattice(model_path, n)
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        for batch in batches:
            rows = []
            texts = batch.column("text").to_pylist()
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), texts, own.encode_all(texts)):
                same = own.decode(found[0][1].tolist()) == text.replace(SPACE, " ")
                n_words = text.count(" ") + text.count(SPACE) + 1 if text else 0
                for rank, (score, ids) in enumerate(found, 1):
                    rows.append((doc_id, rank, score / SCALE, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n_words, same))
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2]), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.int64()), pa.array(c[6])], names=names)

    return id_and_text(docs).mapInArrow(work, OUTPUT)


def encode_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids): the best segmentation of every document."""

    def work(batches):
        own = lattice(model_path, 1)
        for batch in batches:
            found = [f[0][1] for f in own.encode_all(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(work, "doc_id bigint, ids array<int>")


def decode_ids(table: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); NULL ids give a NULL text."""

    def work(batches):
        own = lattice(model_path, 1)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return table.select("doc_id", "ids").mapInArrow(work, "doc_id bigint, text string")
