"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all thresholds, the thresholds ordered.
The grades are 0 (not toxic) and 1 to 3 for toxic documents by how toxic the text is: labels only
say whether, so the grade of a labelled toxic document comes from how many of the words that are
(or beginnings of words) significantly commoner in toxic documents it has, cut at the labelled documents' thirds. Features are
those words, hashed, with log-scaled counts. A prediction is the expected grade.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, LOWER, Slice, discard, doc_texts, map_slices, mix, prefix_hash, slices, span_hash, words_of, written
from .setsketch import shingle_sets

#: Letters only, so that punctuation and digits do not make other words of a word.
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True
#: So many labelled documents at most are fitted on, those of the smallest hash of their ids.
SAMPLE = 8_000
#: Besides whole words, their first bytes are features: stems and compounds of other languages.
PREFIXES = (4, 5, 6, 7, 8)
FEATURES = 512
GRADES = 4
MIN_DOCS = 3
#: A word counts only if this share of the toxic documents has it.
MIN_SHARE = 0.02
#: And only if it is so many times as frequent in toxic documents as in others.
MIN_ODDS = 7.0


def text_features(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of each feature in order of kind, and the documents' numbers of words."""
    low = LOWER[part.data]
    starts, ends, bounds = words_of(low, part.offsets, LETTERS)
    prefix = prefix_hash(BYTE_VALUES[0][low])
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(part)), n)
    docs, hashes = [doc], [span_hash(prefix, starts, ends)]
    for k in PREFIXES:
        long = ends - starts > k
        docs.append(doc[long])
        hashes.append(mix(span_hash(prefix, starts[long], starts[long] + k) + np.uint64(k)))
    return np.concatenate(docs), np.concatenate(hashes), n


def counted(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, feature) in order, and how often each is there."""
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])]) if len(doc) else np.empty(0, np.int64)
    return doc[new], feature[new], np.diff(np.r_[new, len(doc)])


@dataclass
class Ordinal:
    """Hashes of the features (sorted), their shared weights, and the ordered thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))
        edge = np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], 1)
        return np.diff(edge, axis=1)

    def expected(self, z: np.ndarray) -> np.ndarray:
        return self.probabilities(z) @ np.arange(len(self.thresholds) + 1)

    def found(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(document * features + feature, count) of the features in the texts, in order."""
        doc, words, _ = text_features(part)
        sieve = np.zeros(1 << 16, bool)
        sieve[(self.words >> np.uint64(48)).astype(np.int64)] = True
        at = np.flatnonzero(sieve[(words >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.words, words[at]), len(self.words) - 1)
        hit = self.words[place] == words[at]
        return np.unique(doc[at[hit]] * len(self.words) + place[hit], return_counts=True)

    def scores(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """z = w.x of each document, and how many features it has."""
        if not len(self.words):
            return np.zeros(len(part)), np.zeros(len(part), np.int64)
        key, count = self.found(part)
        doc, place = key // len(self.words), key % len(self.words)
        return np.bincount(doc, self.weights[place] * np.log1p(count), minlength=len(part)), np.bincount(doc, count, minlength=len(part))


def fit_ordinal(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, n_grades: int = GRADES, rounds: int = 400, l2: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient ascent (Adam) on the likelihood; steps between thresholds stay positive."""
    n = len(grade)
    w, free = np.zeros(n_features), np.concatenate([[2.0], np.zeros(n_grades - 2)])
    m, v = np.zeros(n_features + n_grades - 1), np.zeros(n_features + n_grades - 1)
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        z = np.bincount(doc, w[feature] * value, minlength=n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        upper = 1 / (1 + np.exp(-np.clip(edge[grade + 1] - z, -60, 60)))
        lower = 1 / (1 + np.exp(-np.clip(edge[grade] - z, -60, 60)))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        dz = (dl - du) / n
        dtheta = np.bincount(grade, du, minlength=n_grades)[:-1] - np.bincount(grade, dl, minlength=n_grades)[1:]
        tail = np.cumsum(dtheta[::-1])[::-1] / n
        g = np.concatenate([np.bincount(feature, value * dz[doc], minlength=n_features) - l2 * w / n, tail * np.concatenate([[1.0], np.exp(free[1:])])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, free = w + step[:n_features], free + step[n_features:]
    return w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def _copy_key(part: Slice) -> np.ndarray:
    """A key that near copies share and other documents do not: the five-word shingle of smallest hash; 0 without words."""
    doc, hashes = shingle_sets(part.data, part.offsets)
    key = np.zeros(len(part), np.uint64)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
    key[doc[first]] = np.minimum.reduceat(hashes, first) if len(first) else 0
    return key


def fit_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> Ordinal:
    """Fits on at most `sample` labelled documents: of an id with several texts one, that of the smallest hash. Labels that are null, or of unknown documents, are left out.

    A feature is used if its presence goes with toxic documents (chi-square with one degree of
    freedom above 20). Near copies count as one document together, so that the words of one copied
    text do not pass. The counts of all features stay in Spark; the driver gets the chosen ones.
    """
    spark = df.sparkSession
    labels = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = doc_texts(df, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # sample rows of two numbers
    own = F.min(F.struct(F.xxhash64("text"), F.col("text"))).alias("own")  # one text of an id
    rows = written(texts.groupBy("doc_id", "toxic").agg(own).select((F.col("toxic") > 0).cast("long").alias("toxic"), F.col("own.text").alias("text")), "toxicity-sample")

    def keyed(batches):
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.batch.column(0), pa.array(_copy_key(part).view(np.int64))], ["toxic", "key"])

    groups = rows.mapInArrow(keyed, "toxic long, key long").toArrow()
    empty = Ordinal(np.empty(0, np.uint64), np.empty(0), np.array([2.0, 3.0, 4.0]))
    keys, at, size = np.unique(groups["key"].to_numpy(), return_inverse=True, return_counts=True)
    total, t = len(keys), float((groups["toxic"].to_numpy() / size[at]).sum()) if len(keys) else 0.0
    if not 0 < t < total:
        return empty
    sent = spark.sparkContext.broadcast((keys, 1 / size))  # a number for each document of the sample, at most

    def presence(batches):
        keys, weights = sent.value
        for part in slices(batches, 1):
            doc, feature, _ = counted(*text_features(part)[:2])
            weight = weights[np.searchsorted(keys, _copy_key(part).view(np.int64))]
            kinds, at = np.unique(feature, return_inverse=True)
            toxic = part.batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(at, (weight * toxic)[doc], minlength=len(kinds))), pa.array(np.bincount(at, weight[doc], minlength=len(kinds)))], ["feature", "a", "n"])

    expected = F.col("n") * (t / total)
    chi = (F.col("a") - expected) ** 2 / expected * total / (total - t) * total / F.greatest(total - F.col("n"), F.lit(1.0))
    counts = rows.mapInArrow(presence, "feature long, a double, n double").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    best = counts.where((F.col("n") >= MIN_DOCS) & (F.col("a") >= MIN_SHARE * t) & (F.col("a") * (total - t) > MIN_ODDS * (F.col("n") - F.col("a")) * t)).withColumn("chi", chi).where("chi > 20").orderBy(F.desc("chi"), "feature").limit(FEATURES).collect()
    used = np.sort(np.array([r.feature for r in best], np.int64).view(np.uint64))
    if not len(used):
        return empty
    model = Ordinal(used, np.ones(len(used)), np.zeros(1))

    def hits(batches):
        for part in slices(batches, 1):
            key, count = model.found(part)
            cuts = np.searchsorted(key // len(used), np.arange(len(part) + 1))
            pieces = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays([part.batch.column(0), pa.array([key[a:b] % len(used) for a, b in pieces], pa.list_(pa.int32())), pa.array([count[a:b] for a, b in pieces], pa.list_(pa.int32()))], ["toxic", "place", "counts"])

    table = rows.mapInArrow(hits, "toxic long, place array<int>, counts array<int>").toArrow()
    listed = table["place"].combine_chunks()
    sizes = np.diff(listed.offsets.to_numpy())
    doc, place, count = np.repeat(np.arange(len(sizes)), sizes), listed.flatten().to_numpy(), table["counts"].combine_chunks().flatten().to_numpy()
    toxic = table["toxic"].to_numpy() > 0
    amount = np.bincount(doc, np.log1p(count), minlength=len(sizes))
    cut = np.quantile(amount[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + (amount > cut[0]).astype(int) + (amount > cut[1]), 0)
    w, theta = fit_ordinal(doc, place, np.log1p(count), grade, len(used))
    return Ordinal(used, w, theta)


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, **label_columns) -> DataFrame:
    """doc_id, n_toxic_features, severity (expected grade, 0 to 3), grade (the likeliest), p_toxic (P(grade > 0)), toxic (p_toxic >= 0.5).

    A null or empty text has no features and the severity of a text without any. Without labels, or
    without a word that tells toxic documents, nothing is called toxic. Null and repeated ids are
    rows like any other.
    """
    sent = df.sparkSession.sparkContext.broadcast(fit_toxicity(df, labels, id_col, text_col, sample=sample, **label_columns))  # FEATURES weights

    def work(part: Slice) -> dict:
        model = sent.value
        z, n = model.scores(part)
        p = model.probabilities(z)
        return {"doc_id": part.batch.column(0), "n_toxic_features": n.astype(np.int64), "severity": p @ np.arange(p.shape[1]), "grade": p.argmax(1).astype(np.int32), "p_toxic": 1 - p[:, 0], "toxic": p[:, 0] <= 0.5}

    return map_slices(doc_texts(df, id_col, text_col), "doc_id long, n_toxic_features long, severity double, grade int, p_toxic double, toxic boolean", work)
