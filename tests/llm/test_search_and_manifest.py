"""Top-k search, spelling variants and the Merkle manifest against brute force and on odd tables."""

import hashlib
import math
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from verify_queries import compare

from flowsieve.llm import catalog, merkle, spelling, topk

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
    # names that the operators use inside
    T.StructField("row", T.StringType()), T.StructField("dim", T.StringType()), T.StructField("norm", T.StringType()), T.StructField("is_query", T.StringType()),
])


@pytest.mark.parametrize("name", ["op11_topk", "op12_spelling", "op13_merkle"])
def test_same_as_sql(spark, small, name):
    state, note, _ = compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], small)
    assert state == "ok", note


# top-k search

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, "a", "b", "c", "d") for i, v in rows], VECTORS)


def best(rows, k, asked):
    """Every query against every other row, with Python's integers."""
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(usable):
        if i is None or not asked(i):
            continue
        scores = [(sum(x * y for x, y in zip(q, c)), j) for b, (j, c) in enumerate(usable) if b != a and len(c) == len(q)]
        scores = [(max(-topk.MOST, min(topk.MOST, s)), j) for s, j in scores]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(i, r, j, s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, k, divisor, **sizes):
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % divisor == 0, k, **sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_top_k_in_many_cells(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in rng.permutation(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # one vector in a fifth of all rows: ties at every limit
    assert found(spark, rows, 5, 20, query_rows=7, chunk_rows=64) == best(rows, 5, lambda i: i % 20 == 0)


def test_top_k_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (10, [1.0, 2.0]), (3, [-1.0, 0.5]), (None, [1.0, 2.0]), (4, None), (10, [nan, 1.0]), (20, [1.0, None]),
        (5, [inf, 0.0]), (30, []), (6, []), (40, [1.0, 2.0, 3.0]), (50, [1e200, -1e200]), (7, [3e9, 1e5]), (60, [0.001, -0.001]),
    ]
    assert found(spark, rows, 5, 10) == best(rows, 5, lambda i: i % 10 == 0)
    assert found(spark, rows, 1, 10, query_rows=1, chunk_rows=1) == best(rows, 1, lambda i: i % 10 == 0)


def test_top_k_of_nothing(spark):
    assert found(spark, [], 5, 10) == []
    assert found(spark, [(0, [1.0])], 5, 10) == []
    assert found(spark, [(1, [1.0]), (2, [1.0])], 5, 10) == []


def test_top_k_rows_sent_do_not_grow_with_ties():
    import pyarrow as pa

    rows = 500
    table = pa.table({"row": np.arange(rows), "id": np.arange(rows), "vec": pa.array([[1.0]] * rows, pa.list_(pa.float64())), "lo": np.full(rows, 256 * 256), "span": np.ones(rows, np.int64), "need": np.full(rows, 5)})
    assert topk._select(table, table).num_rows == 5 * rows
    assert topk._count(table, table).num_rows == rows


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**40), 2**40), min_size=3, max_size=3), min_size=1, max_size=6))
def test_inner_products_are_exact(rows):
    m = np.array(rows, dtype=np.float64)
    want = [[max(-topk.MOST, min(topk.MOST, sum(x * y for x, y in zip(a, b)))) for b in rows] for a in rows]
    assert topk.inner_products(m, m).tolist() == want


# spelling variants

def variants(docs, least=7, least_n=2, factor=10):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        first = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = first if first and n[first] >= factor * n[w] else None
        out[w] = len(others)
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, n[w], out[w], form[w], n.get(form[w]), root))
    return rows


def grouped(docs, **sizes):
    got = spelling.group_variants(docs, **sizes)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def misspelt():
    rng = np.random.default_rng(3)
    base = ["tionelle", "aaaaaaaa", "élégance", "mitteilung", "worthless", "ÿÿÿÿÿÿÿÿ", "x" * 90]
    letters, rows = list("abexyzéÿ"), []
    for k in range(120):
        words = [w for w in base for _ in range(2)]
        for w in base:
            p, c = rng.integers(len(w)), letters[rng.integers(len(letters))]
            words += [w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :].upper()]
        rows.append((k, " ".join(words)))
    return rows


def test_variants_of_misspelt_words(make):
    docs = misspelt()
    want = variants(docs)
    assert any(form for _, _, _, form, _, _ in want) and max(len(w) for w, *_ in want) > spelling.LONG
    assert grouped(make(docs)) == want


def test_variants_in_many_rounds_and_segments(make, monkeypatch):
    monkeypatch.setattr(spelling, "SEGMENT_WORDS", 16)
    docs = misspelt()
    assert grouped(make(docs), round_bytes=200) == variants(docs)


def test_variants_of_odd_rows(odd, make):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert grouped(odd, least_length=3) == variants(docs, 3)
    assert grouped(make([])) == set()
    assert grouped(make([(1, None), (2, "")])) == set()


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(13)] + [("a", "w05")]
    rows = spelling.last_forms(spark.createDataFrame(chain, "word string, form string")).collect()
    assert sorted(tuple(r) for r in rows) == sorted((w, "w13") for w, _ in chain)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=7), min_size=1, max_size=30, unique=True))
def test_edits_meet_every_near_word(words):
    segments = {length: 3 for length in range(1, 8)}
    here = {}
    for length in segments:
        own = [w for w in words if len(w) == length]
        h = spelling.word_hashes(spelling.codes_of(own)) if own else np.zeros(0, np.uint64)
        for s in range(3):
            here[length, s] = spelling.bloom(h[spelling.segment_of(h, 3) == s])
    letters = np.array(sorted({ord(c) for w in words for c in w}), np.uint32)
    got = Counter((words[i], w) for i, w in spelling.held_edits(words, letters, spelling.Filters(segments, here)) if w in words)
    want = Counter()
    for a in words:
        for b in words:
            if len(a) == len(b) and a < b and sum(x != y for x, y in zip(a, b)) == 1 or len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a))):
                want[a, b] += 1
    assert got == want


# Merkle manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lowered=False):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    parts = []
    for name in merkle.FIELDS:
        v = row[name]
        v = v.translate(lower) if lowered and name == "text" and v is not None else v
        parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return sha("".join(parts))


def climb(nodes):
    """The root of nodes in order, and the siblings (left, right) of each on the way."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = place // 8 * 8
            paths[k].append((nodes[run:place], nodes[place + 1 : run + 8]))
        at = [p // 8 for p in at]
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def manifest_of(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    names = sorted(by, key=lambda x: b"" if x is None else b"+" + x.encode())
    trees = []
    for name in names:
        own = sorted(by[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees.append((own, *climb([leaf_of(r) for r in own])))
    if not trees:
        return []
    root, tops = climb([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for r, path in zip(own, paths):
            hit = zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 0
            up = leaf_of(r, hit)
            for a, b in path + top:
                up = sha("".join([*a, up, *b]))
            proof = sha("".join(x for a, b in path + top for x in a + b))
            out.append((r["doc_id"], leaf_of(r), subroot, root, proof, up, up == root))
    return sorted(out, key=str)


def manifested(docs):
    return sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [8], [9, 1], [65, 8, 7], [513, 64, 1, 1, 1, 1, 1, 1, 1, 2]])
def test_manifest_of_many_shapes(make, sizes):
    rows = [(i * 7 % 1000 + 1000 * g, f"Text {i % 5} Of {g}", f"l{g}" if g else None) for g, n in enumerate(sizes) for i in range(n)]
    docs = make(rows)
    got = manifested(docs)
    assert got == manifest_of([r.asDict() for r in docs.collect()])
    assert {r[6] for r in got} <= {True, False} and (len(got) < 9 or {r[6] for r in got} == {True, False})


def test_manifest_of_odd_rows(odd, make):
    clashing = odd.withColumn("grp", F.lit(1)).withColumn("pos", F.lit("x")).withColumn("digest", F.lit(None)).withColumn("n", F.lit(5))
    assert manifested(clashing) == manifest_of([r.asDict() for r in odd.collect()])
    assert manifested(make([])) == []


def test_manifest_of_equal_rows_in_small_blocks(make, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_RUNS", 2)
    docs = make([(7, "Same", "en")] * 150 + [(None, None, None)] * 20)
    assert manifested(docs) == manifest_of([r.asDict() for r in docs.collect()])
