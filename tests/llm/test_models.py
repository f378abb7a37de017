"""Language ID, quality resampling and the language model against brute force and held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import bloomlm, catalog, langid, quality


def test_language_on_held_out_rows(spark, small):
    rows = catalog.QUERIES["op2_langid"](spark, small).join(catalog.documents(spark, small).select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == catalog.documents(spark, small).count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    judged = [r.lang == r.lang_pred for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert len(judged) > 100 and np.mean(judged) > 0.9


def test_language_of_odd_rows(odd):
    columns = odd.columns
    labelled = odd.withColumn("lang", F.when(F.length("text") > 30, "en").otherwise("de"))
    rows = {(r.doc_id, r.lang_pred) for r in langid.identify(labelled).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (6, "und")} <= rows
    assert {name for _, name in rows} <= {"en", "de", "und"}
    kept = langid.keep_identified(labelled)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()}.isdisjoint({2, 3, 4, 6})
    nothing = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))  # nothing to learn from
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    assert langid.identify(odd.where("false")).count() == 0


def test_vectors_do_not_depend_on_the_cut(monkeypatch):
    text = "Ein Satz, der lang genug ist. " * 40
    whole = langid.vector(text)
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 64)
    assert float(whole @ langid.vector(text)) > 0.9


def test_support_vectors_separate():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(200) < 0.5, 1, -1)
    x = (rng.normal(size=(200, 5)) + np.outer(y, [2, 0, 0, -2, 0])).astype(np.float32)
    w = langid.fit_svm(x, y)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.95


def test_quality_keeps_the_largest_keys(spark, small):
    got = catalog.QUERIES["op5_quality"](spark, small).collect()
    assert len(got) == catalog.documents(spark, small).count()
    weighed = sorted((r.gumbel_key for r in got if r.gumbel_key is not None), reverse=True)
    wanted = sum(r.weight is not None and r.weight > 0 for r in got)
    assert {r.doc_id for r in got if r.selected} == {r.doc_id for r in got if r.gumbel_key is not None and r.gumbel_key >= weighed[wanted - 1]}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").where("quality is not null").collect()}
    right = [r.selected == (good[r.doc_id] == 1) for r in got if r.doc_id in good and r.n_grams]
    assert np.mean(right) > 0.9


def test_draw_is_in_proportion_to_the_importance_ratio(spark):
    table = spark.range(60_000).selectExpr("id as doc_id", "ln(1.0 + id % 3) as weight")
    runs = []
    for salt in ("a", "b"):
        got = quality.draw(table.withColumn("_n", quality.gumbel("doc_id", salt=salt)), "weight", "_n", k=3000)
        rows = got.where("selected").collect()
        assert len(rows) == 3000
        share = np.bincount([r.doc_id % 3 for r in rows]) / 3000
        assert np.abs(share - np.array([1, 2, 3]) / 6).max() < 0.03
        runs.append({r.doc_id for r in rows})
    assert len(runs[0] & runs[1]) < 500  # another salt is another draw


def test_quality_counts_are_whole(spark, small):
    texts = catalog.documents(spark, small).select("text")
    want = np.zeros(quality.BUCKETS)
    for r in texts.collect():
        for found in quality.buckets(r.text):
            np.add.at(want, found, 1)
    assert (quality.bucket_counts(texts) == want).all()


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    values = [*rng.normal(size=3000).tolist(), *[0.25] * 500, *(rng.random(500) * 1e-12).tolist()]
    table = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 17, 700, len(values)):
        assert quality.kth_largest(table, "v", k) == ordered[k - 1]
    assert quality.kth_largest(table, "v", 0) is None


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, None), (1, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality.resample(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(not r.selected for r in rows if r.doc_id in (2, 3, 4))
    assert quality.keep_good(odd, labels).columns == odd.columns
    unlabelled = quality.keep_good(odd, labels.where("false"))  # nothing learned, nothing rejected
    assert unlabelled.count() == odd.count()
    assert quality.resample(odd.where("false"), labels).count() == 0


def words(text):
    return [*(text or "").encode().lower().split(), b" "]


def check_scores(rows, docs):
    train = Counter()
    for doc_id, text in docs:
        if zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 != 1:
            train.update(words(text))
    n, v = sum(train.values()), len(train)
    want = Counter()
    for doc_id, text in docs:
        own = words(text)
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want[doc_id, len(own), sum(train[w] > 0 for w in own), n, round(base, 5)] += 1
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)
    close = [(a, b) for a, b in zip(sorted(want.elements(), key=repr), sorted(got.elements(), key=repr))]
    assert len(rows) == len(docs) and all(a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-4 * max(1, abs(a[4])) for a, b in close)


@pytest.mark.parametrize("frequent", [1_000_000, 50])
def test_language_model(spark, small, frequent):
    """Base scores by brute force, with all exact counts broadcast and with most of them joined."""
    docs = catalog.documents(spark, small)
    rows = bloomlm.score_documents(docs, frequent_words=frequent).collect()
    check_scores(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_on_odd_rows(odd):
    check_scores(bloomlm.score_documents(odd).collect(), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert bloomlm.score_documents(odd.where("false")).count() == 0


def test_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(0)
    grams = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.int64))
    counts = rng.integers(2, 500, len(grams))
    table = spark.createDataFrame([(int(g), int(n)) for g, n in zip(grams, counts)], "gram bigint, n bigint")
    held = bloomlm.build_filter(table)
    pair = (grams & 1).astype(bool)
    level = held.level(grams.view(np.uint64))
    least = np.where(pair, held.least_pair, 1.0)
    stored = bloomlm.levels(counts.astype(float), least)
    assert (level >= stored).all() and np.mean(level == stored) > 0.9
    absent = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert np.mean(held.level(absent) > 0) < 0.1


def test_pairs_outside_the_filter_are_joined(spark):
    """With a filter too small for any pair, the rarer pairs count with their exact numbers."""
    from collections import Counter
    from zlib import crc32

    import numpy as np

    texts = [f"a{i % 9} b{i % 4} c{i % 5} a{i % 3}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model, counts = bloomlm.fit(docs.where(~bloomlm.held_out()).select("text"), most_bits=8)
    assert not model.filter.complete and bloomlm.build_filter(counts).complete
    seen = Counter(g for i, t in enumerate(texts) if crc32(str(i).encode()) % 5 != 1 for g in bloomlm.pairs_of(bloomlm.words_of(t)).tolist())
    got = {r["doc_id"]: r["score"] for r in bloomlm.score_documents(docs, most_bits=8).collect()}
    assert len(got) == len(texts)
    joined = 0
    for i, t in enumerate(texts):
        words = bloomlm.words_of(t)
        p, pair, context = model.parts([words])
        exact = np.array([seen[g] if seen[g] > 1 else 0 for g in bloomlm.pairs_of(words).tolist()], float)
        joined += int((exact[pair == 0] > 0).sum())
        n = np.where(pair == 0, exact, pair)
        assert abs(got[i] - model.log10(p, n, np.maximum(context, n)).sum()) < 1e-9
    assert joined > 100


def by_hand(texts, mu, own=0):
    """log10 probability of each text under a model of all of them with whole counts, ``own`` taken off each token's."""
    count, pairs = Counter(), Counter()
    for t in texts:
        count.update(words(t))
        pairs.update(zip([b" ", *words(t)], words(t)))
    floor = sum(count.values()) + 0.5 * (len(count) + 1)

    def one(t):
        total = 0.0
        for v, w in zip([b" ", *words(t)], words(t)):
            p, n, context = (count[w] + 0.5) / floor, pairs[v, w], max(count[v], pairs[v, w])
            total += math.log10((max(n - own, 0) + mu * p) / (max(context - own, n - own, 0) + mu))
        return total

    return [one(t) for t in texts]


def test_pairs_that_occur_once_count(spark):
    """A pair that training texts hold once is in the model, and its words in another order are not (F1)."""
    rng = np.random.default_rng(3)
    order = [" ".join(f"w{j}" for j in rng.permutation(40)) for _ in range(30)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][:30]
    docs = spark.createDataFrame(list(zip(ids, order)), "doc_id bigint, text string")
    model, counts = bloomlm.fit(docs.select("text"))
    alone = counts.where("gram & 1 = 1 and n = 1").toArrow().column("gram").to_numpy().view(np.uint64)
    want = Counter(g for t in order for g in bloomlm.pairs_of(bloomlm.words_of(t)).tolist())
    assert len(alone) == sum(n == 1 for n in want.values()) > 300
    assert model.filter.complete and (model.filter.pairs(alone) == 1).all()
    assert np.mean(model.filter.pairs(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) | np.uint64(1)) > 0) < 0.01
    exact = dict(zip(order, by_hand(order, model.mu)))
    for r in bloomlm.score_documents(docs).join(docs, "doc_id").collect():
        assert abs(r.score - exact[r.text]) < 0.02 * abs(exact[r.text])  # counts of 3 and more are quantised


@pytest.mark.parametrize("most_bits", [bloomlm.MOST_BITS, 8])
def test_mu_is_chosen_on_all_training_texts(spark, most_bits):
    """The most probable mu over every training text, also where pairs are outside the filter, and not over some of them (F1)."""
    rng = np.random.default_rng(4)
    often = ["x1 x2 x3 x4 x5 x6", "x2 x1 x4 x3 x6 x5"]  # texts that a draw by their hash leaves out, or takes alone
    some = [" ".join(f"r{j}" for j in rng.integers(0, 400, 40)) for _ in range(150)]
    texts = [t for t in often for _ in range(1500)] + some
    model, _ = bloomlm.fit(spark.createDataFrame([(t,) for t in texts], "text string"), most_bits=most_bits)
    assert model.filter.complete == (most_bits > 8)
    totals = [sum(by_hand(texts, mu, own=1)) for mu in bloomlm.MUS]
    parts = [sum(by_hand(texts, mu, own=1)[3000:]) for mu in bloomlm.MUS]
    assert model.mu == bloomlm.MUS[int(np.argmax(totals))] != bloomlm.MUS[int(np.argmax(parts))]


def test_pairs_that_occur_once_are_joined_where_no_filter_holds_them(spark, monkeypatch):
    """With no filter for the pairs that occur once, they count as the join finds them (F1)."""
    monkeypatch.setattr(bloomlm, "LEAST_BITS", 1 << 15)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 200, 30)) for _ in range(300)]
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model, _ = bloomlm.fit(docs.where(~bloomlm.held_out()).select("text"), most_bits=1 << 15)
    assert not model.filter.complete and not len(model.filter.once)
    seen = Counter(g for t in train for g in bloomlm.pairs_of(bloomlm.words_of(t)).tolist())
    joined = 0
    for r in bloomlm.score_documents(docs, most_bits=1 << 15).collect():
        own = bloomlm.words_of(texts[r.doc_id])
        p, pair, context = model.parts([own])
        n = np.where(pair == 0, np.array([seen[g] for g in bloomlm.pairs_of(own).tolist()], float), pair)
        joined += int(((pair == 0) & (n == 1)).sum())
        assert abs(r.score - model.log10(p, n, np.maximum(context, n)).sum()) < 1e-9
    assert joined > 4000
