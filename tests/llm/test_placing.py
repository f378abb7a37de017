"""Packing, sharding and SimHash groups against brute force."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from flowsieve.llm import catalog, packing, sharding, simhash
from flowsieve.llm.common import Forest
from flowsieve.llm.components import connected_components


def tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(catalog.tokenizer_file("word_bpe_49k.json"))
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pieces(pieces, docs, most_padding):
    """Every id in exactly one piece, checksums, gapless offsets, window size, document order."""
    ids = defaultdict(list)
    for (doc_id, _), t in zip(docs, tokens([x for _, x in docs])):
        ids[doc_id].append(t)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for doc_id, found in by_doc.items():
        if len(ids[doc_id]) > 1:  # repeated ids: only the totals can be told
            assert sum(p.length for p in found) == sum(map(len, ids[doc_id]))
            continue
        at, t = 0, ids[doc_id][0]
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(t)
            assert p.ids_crc32 == zlib.crc32(t[at : at + p.length].tobytes())
            at += p.length
        assert at == len(t)
    padding = 0
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= packing.LENGTH
        own = 0 if at & (at - 1) == 0 else packing.LENGTH - at
        assert {p.padding for p in found} == {own}
        padding += own
    total = sum(p.length for p in pieces)
    assert padding <= most_padding * total
    return len(by_sequence)


def test_packing_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in catalog.documents(spark, small).select("doc_id", "text").collect()]
    check_pieces(catalog.QUERIES["op1_packing"](spark, small).collect(), docs, 0.01)


def test_packing_odd_rows(odd):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    path = catalog.tokenizer_file("word_bpe_49k.json")
    check_pieces(packing.pack(odd, path).collect(), docs, 0.05)
    assert packing.pack(odd.where("false"), path).count() == 0


def test_cuts_are_the_best():
    rng = np.random.default_rng(0)
    for _ in range(30):
        at = np.cumsum(rng.integers(1, 9, 60)).tolist()
        penalty = rng.integers(0, 4, 60).astype(float).tolist()
        best = {0: 0.0}
        for j, p in enumerate(at):
            best[p] = min(best[i] + 16 - (p - i) + penalty[j] for i in [0, *at[:j]] if p - i <= 16)
        cuts = packing.choose_cuts(at, penalty, 16)
        cost = dict(zip(at, penalty))
        assert sum(16 - (b - a) + cost[b] for a, b in zip([0, *cuts], cuts)) == best[at[-1]]
        assert all(b - a <= 16 for a, b in zip([0, *cuts], cuts))


def test_packer_carries_windows_over_plans():
    ends = np.zeros(20, bool)
    ends[3] = True
    rng = np.random.default_rng(1)
    packer, rows, docs = packing.Packer(0, 64), [], []
    for i in range(3000):
        ids = rng.integers(0, 20, rng.integers(1, 200)).astype(np.uint32)
        docs.append(ids)
        rows += packer.add(i, ids, ends)
        assert len(packer.docs) < 64 * (packing.PLAN_WINDOWS + packing.OPEN_WINDOWS)
    rows += packer.flush(True)
    held = defaultdict(list)
    for doc_id, start, n, crc, *_ in rows:
        assert start == sum(held[doc_id])
        assert crc == zlib.crc32(docs[doc_id][start : start + n].astype("<u4").tobytes())
        held[doc_id].append(n)
    assert [sum(held[i]) for i in range(3000)] == [len(d) for d in docs]


def draw(key, shard):
    h = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42) if key is not None else 42
    return ((xxhash.xxh64_intdigest(shard.to_bytes(8, "little"), h) >> 12) + 0.5) / (1 << 52)


def best(key, weights):
    scores = [(-w / np.log(draw(key, i)), -i) for i, w in enumerate(weights) if w]
    return -max(scores)[1]


@pytest.mark.parametrize("which", ["small", "odd"])
def test_sharding(spark, small, odd, which):
    docs = catalog.documents(spark, small) if which == "small" else odd
    got = (catalog.QUERIES["op6_sharding"](spark, small) if which == "small" else sharding.shard_documents(odd)).collect()
    text = {(r.doc_id, zlib.crc32((r.text or "").encode())): len((r.text or "").encode()) + 8 for r in docs.collect()}
    assert len(got) == docs.count()
    slots = defaultdict(list)
    for r in got:
        assert r.size == text[r.doc_id, r.text_crc32] and r.law == "key"
        assert r.shard == best(r.doc_id, [1.0] * 24) and r.grown_shard == best(r.doc_id, [1.0] * 25)
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_weights_and_many_buckets(spark):
    rows = sharding.assign_shards(spark.range(20_000), "id", [1.0, 2.0, 0.0, 5.0])
    counts = {r.shard: r["count"] for r in rows.groupBy("shard").count().collect()}
    assert set(counts) == {0, 1, 3} and abs(counts[3] / 12_500 - 1) < 0.05 and abs(counts[0] / 2500 - 1) < 0.1
    slots = defaultdict(list)
    for r in sharding.number_slots(rows, "shard", ["id"], 100).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, distance=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    forest = Forest(len(rows))
    for i in range(len(rows)):
        near = [j for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance]
        forest.link(np.full(len(near), i), np.array(near, int))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[forest.root[i]] = min(doc_id, least.get(forest.root[i], doc_id))
    return sorted([(d, f"{fps[i]:016x}", least.get(forest.root[i])) for i, (d, _) in enumerate(rows)], key=repr)


def test_simhash_whole_table(spark, small):
    rows = [(r.doc_id, r.text) for r in catalog.documents(spark, small).select("doc_id", "text").collect()]
    got = catalog.QUERIES["op10_simhash"](spark, small)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_groups(rows)


def test_simhash_odd_rows(odd):
    got = simhash.simhash_groups(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted([(r.id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got], key=repr) == brute_groups(rows)
    assert simhash.simhash_groups(odd.where("false")).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_groups(rows)})


@pytest.mark.parametrize("home_rows", [4096, 3])
def test_close_fingerprints_with_hot_anchors(spark, home_rows):
    """A dense cluster, cut into cells when the limit is low, and single pairs at exactly 4 and 5 bits."""
    rng = np.random.default_rng(3)
    fps = {0x123456789ABCDEF}
    for _ in range(150):
        bits = rng.choice(64, rng.integers(1, 4), replace=False)
        fps.add(0x123456789ABCDEF ^ sum(1 << int(b) for b in bits))
    for _ in range(60):
        base = int(rng.integers(0, 1 << 63, dtype=np.uint64))
        for d in (4, 5):
            fps |= {base, base ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False))}
    values = np.array(sorted(fps), np.uint64)
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    links = simhash.close_links(table, 4, home_rows).collect()
    want, got = Forest(len(values)), Forest(len(values))
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None]) <= 4)
    want.link(a, b)
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    for r in links:
        got.link(np.array([at[r.a]]), np.array([at[r.b]]))
    assert (want.root == got.root).all()


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, int(x)) for x in range(1001, 1300)] + [(int(a) + 2000, int(b) + 2000) for a, b in rng.integers(0, 300, (150, 2))]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*pairs, (5000, None), (5001, 5001)], "a bigint, b bigint")).collect()}
    forest = Forest(2300)
    forest.link(*np.array(pairs).T)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {i: int(forest.root[i]) for i in linked}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_words_and_parts_share_one_bounded_store(monkeypatch):
    """A word is made once while it is held, a part met as a word is not made again, and ids do not depend on the store (op1)."""
    from tokenizers import Tokenizer

    path = catalog.tokenizer_file("word_bpe_49k.json")
    whole, words = Tokenizer.from_file(path), packing.WordTokenizer(path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    texts = ["It's the Café's 12,5 l'Été straße naïve µ ÷ 日本 don't… x<y", "the it café's THE the's 's ... <", f"a{special[0]}b {special[-1]}", None, "", "  \n\t"]
    made, make = [], words.known.make
    words.known.make = lambda word: made.append(word) or make(word)
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert [x.tolist() for x in words.encode(texts)] == want
    assert len(made) == len(set(made)) and b"the" in made and b"it" in made
    count = len(made)
    assert [x.tolist() for x in words.encode(texts)] == want and len(made) == count
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    for i in range(20):
        more = [f"{t} w{i} q{i}z" for t in texts]
        assert [x.tolist() for x in words.encode(more)] == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in more]
        assert len(words.known) + len(words.known.before) < 150
