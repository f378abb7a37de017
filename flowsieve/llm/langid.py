"""Language identification by hierarchical discrimination.

A text becomes one vector of hashed character n-grams (letters only, anything else is
one gap). One-versus-one linear support vector machines first choose the language family,
then those between the languages of that family choose the language.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.llm.common import bounded_batches, fresh, id_and_text, remainder

# Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "indic": ["hi", "bn", "mr", "ne", "pa", "gu", "ur", "si"],
    "iranian": ["fa", "ps", "ku", "tg"],
    "semitic": ["ar", "he", "mt", "am"],
    "sinitic": ["zh", "yue"],
    "malayic": ["id", "ms"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
DIMENSIONS = 1 << 14
#: Texts for fitting: at most so many of a language, and in all.
SAMPLE_PER_LANG, SAMPLE = 400, 8000
CHARS_AT_ONCE = 1 << 20
STEEPNESS = 2.0

_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)], bool)
    return _LETTER


def vector(text: str | None) -> np.ndarray | None:
    """Square roots of hashed n-gram counts, scaled to length 1; None if there is no letter."""
    is_letter, counts = letters(), np.zeros(DIMENSIONS, np.int64)
    text, any_letter = (text or "").lower(), False
    overlap = max(ORDERS) - 1
    for at in range(0, len(text), CHARS_AT_ONCE):
        chars = np.frombuffer(text[max(0, at - overlap) : at + CHARS_AT_ONCE].encode("utf-32-le", "replace"), np.uint32)
        own = is_letter[np.minimum(chars, 0x10FFFF)]
        any_letter |= bool(own.any())
        chars = np.where(own, chars, 32).astype(np.uint32)
        keep = np.ones(len(chars), bool)
        keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32)
        chars = np.concatenate([[32], chars[keep], [32]]).astype(np.uint32)
        h = np.zeros(len(chars), np.uint32)
        for n in ORDERS:
            h = h[: len(chars) - n + 1] * np.uint32(0x9E3779B1) + chars[n - 1 :]
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            counts += np.bincount(mixed >> np.uint32(18), minlength=DIMENSIONS)
    if not any_letter:
        return None
    v = np.sqrt(counts).astype(np.float32)
    return v / np.linalg.norm(v)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine, by dual coordinate descent; ``y`` is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    norms, alpha, w = (x * x).sum(axis=1), np.zeros(len(x)), np.zeros(x.shape[1])
    # both sides weigh the same, however many texts each has
    limit = c * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            step = (1 - y[i] * (x[i] @ w)) / norms[i]
            new = min(max(alpha[i] + step, 0.0), limit[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Duels:
    """One-versus-one machines over ``names``."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # a column for each pair, bias last

    @staticmethod
    def fit(names: list[str], x: np.ndarray, labels: np.ndarray) -> Duels:
        pairs, columns = list(combinations(range(len(names)), 2)), []
        for a, b in pairs:
            rows = (labels == names[a]) | (labels == names[b])
            columns.append(fit_svm(x[rows], np.where(labels[rows] == names[a], 1, -1)))
        return Duels(names, pairs, np.array(columns).T.reshape(x.shape[1] + 1, len(pairs)))

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner's index (most duels won, ties by margins) and its mean chance of winning a duel."""
        if len(self.names) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.weights[:-1] + self.weights[-1]
        won, sums, chance = (np.zeros((len(x), len(self.names))) for _ in range(3))
        for k, (a, b) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(-STEEPNESS * np.clip(margin[:, k], -50, 50)))
            won[:, a] += margin[:, k] > 0
            won[:, b] += margin[:, k] <= 0
            sums[:, a] += margin[:, k]
            sums[:, b] -= margin[:, k]
            chance[:, a] += p
            chance[:, b] += 1 - p
        best = np.argmax(won + np.tanh(sums / 1e3) / 2, axis=1)
        return best, chance[np.arange(len(x)), best] / (len(self.names) - 1)


@dataclass
class Model:
    families: Duels
    within: list[Duels]

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        vectors = [vector(t) for t in texts]
        names, scores = [UNKNOWN] * len(vectors), np.zeros(len(vectors))
        some = np.array([i for i, v in enumerate(vectors) if v is not None], int)
        for at in range(0, len(some), 256):
            rows = some[at : at + 256]
            x = np.array([vectors[i] for i in rows])
            family, sure = self.families.choose(x)
            for f, duels in enumerate(self.within):
                own = family == f
                if own.any():
                    best, chance = duels.choose(x[own])
                    scores[rows[own]] = np.clip(sure[own] * chance, 0, 1)
                    for i, b in zip(rows[own], best):
                        names[i] = duels.names[b]
        return names, scores


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, sample: int = SAMPLE) -> Model | None:
    """Fit on labelled rows (``text``, ``lang``): at most ``per_lang`` of each language and ``sample`` in all.

    The rows are the first by a hash of the text, so a retry takes the same. None if there is nothing to learn from.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample // 10).collect()}
    if not counts:
        return None
    most = min(per_lang, sample // len(counts))
    u = (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * most / n))])
    few = labelled.withColumn("u", u).where(F.col("u") < share[F.col("lang")])
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))).where(F.col("rank") <= most)

    def features(batches):
        for batch in batches:
            rows = [(lang, vector(t)) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rows = [(lang, np.flatnonzero(v), v) for lang, v in rows if v is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[2][r[1]] for r in rows], pa.list_(pa.float32()))],
                names=["lang", "at", "v"])

    rows = first.select("lang", "text").mapInArrow(features, "lang string, at array<int>, v array<float>").toArrow()
    if not rows.num_rows:
        return None
    x, labels = np.zeros((rows.num_rows, DIMENSIONS), np.float32), np.array(rows.column("lang").to_pylist())
    for i, (at, v) in enumerate(zip(rows.column("at"), rows.column("v"))):
        x[i, at.values.to_numpy()] = v.values.to_numpy()
    order = np.argsort(labels, kind="stable")
    order = order[np.lexsort((x[order].sum(axis=1), labels[order]))]  # the order of arrival must not matter
    x, labels = x[order], labels[order]
    family = np.array([FAMILY_OF.get(name, name) for name in labels])
    families = sorted(set(family))
    within = [Duels.fit(sorted(set(labels[family == f])), x[family == f], labels[family == f]) for f in families]
    return Model(Duels.fit(families, x, family), within)


def predicted(docs: DataFrame, model: Model | None) -> Column:
    """A struct column (lang, score) computed from ``text`` alone."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few weights for each pair of languages

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if shared.value is None:
            return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)})
        names, scores = shared.value.predict(texts)
        return pd.DataFrame({"lang": names, "score": scores})

    return predict(F.col("text").cast("string"))


def held_out() -> Column:
    return remainder() == 0


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document, learned from those not held out.

    ``und`` with score 0 for a NULL text or one without letters, and for all if nothing can be learned.
    Texts of any length count whole. Equal texts get equal results. An empty table gives an empty result.
    """
    model = fit(docs.where(~held_out()).select("text", "lang"))
    flagged = docs.select("doc_id", "text", held_out().alias("held_out"))
    return flagged.withColumn("p", predicted(flagged, model)).select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, least_score: float = 0.25) -> DataFrame:
    """The documents whose language can be told: not ``und``, and a score of ``least_score`` or more.

    NULL, empty and letterless texts go; equal texts share their fate; all columns stay as they are, whatever their names.
    An empty table gives an empty result, and so does one that nothing can be learned from.
    """
    model = fit(docs.where(~held_out()).select("text", "lang"))
    own = fresh(docs.columns, "_language")
    named = docs.withColumn(own, predicted(docs, model))
    return named.where((F.col(own)["lang"] != UNKNOWN) & (F.col(own)["score"] >= least_score)).drop(own)
