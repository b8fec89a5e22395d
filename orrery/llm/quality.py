"""Quality classifier by weak labels.

Overlapping heuristic labellers vote bad, good or nothing on every document
(most of those here know a kind of bad text only; three also know marks of plain prose). The counts of all vote
patterns over the whole corpus (at most 3**labellers of them) are what expectation-maximisation
needs to estimate each labeller's accuracy without any true label. The posterior of a pattern is the
soft label of its documents, and a bounded sample of them trains a linear scorer over hashed word
features; the scorer then decides on every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, SPACE, Slice, doc_texts, map_slices, mix, prefix_hash, slices, span_hash, words_of

LABELLERS = ("symbols", "capitals", "repeats", "exclamations", "word_length", "sentences", "bars", "variety", "odd_bytes", "plain_words")
BITS = 15
#: About so many documents train the scorer, chosen by a hash of id and text.
SAMPLE = 4000
#: Prior of a labeller's bad votes on good documents: their share, and its weight in documents, so that counts outweigh it.
#: Kinds of bad text exclude each other; what keeps them in one class is that the votes for good go against all of them.
FALSE_ALARM, ALARM_WEIGHT = 0.002, 50.0

_SYMBOL, _UPPER, _LETTER, _BANG, _STOP, _BAR = (np.zeros(256, np.uint8) for _ in range(6))
_SYMBOL[np.frombuffer(b"#$%&*<>@^~{}[]\\+=", np.uint8)] = 1
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = 1
_BANG[33] = 1
_STOP[np.frombuffer(b".?!;:", np.uint8)] = 1
_BAR[ord("|")] = 1
_ODD = np.maximum(_SYMBOL, np.maximum(_BAR, _BANG))  # what plain prose has little of


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def votes(part: Slice) -> tuple[np.ndarray, tuple]:
    """A matrix of -1 (bad), 0 (no vote) and 1 (good), documents by labellers; and the parsed words."""
    data, offsets = part.data, part.offsets
    starts, ends, bounds = words_of(data, offsets, ~SPACE)
    words = span_hash(prefix_hash(BYTE_VALUES[0][data]), starts, ends)
    n = np.diff(bounds)
    some = np.maximum(n, 1)
    size = np.maximum(np.diff(offsets), 1)
    letters = _per_doc(_LETTER[data], offsets)
    share = {"symbols": _per_doc(_SYMBOL[data], offsets) / size, "capitals": _per_doc(_UPPER[data], offsets) / np.maximum(letters, 1), "exclamations": _per_doc(_BANG[data], offsets) / size, "bars": _per_doc(_BAR[data], offsets) / size}
    same = np.zeros(len(words), np.uint8)
    for back in (1, 5):  # a word again at once, or a phrase of five again
        same[back:] |= words[back:] == words[:-back] if len(words) > back else 0
    same[bounds[:-1][n > 0]] = 0
    share["repeats"] = _per_doc(same, bounds) / some
    length = _per_doc(((data & 0xC0) != 0x80) & ~SPACE[data], offsets) / some
    share["odd_bytes"] = _per_doc(_ODD[data], offsets) / size
    odd_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ODD[data], out=odd_before[1:])
    share["plain_words"] = _per_doc(odd_before[ends] == odd_before[starts], bounds) / some
    stops = _per_doc(_STOP[data], offsets)
    per_stop = n / np.maximum(stops, 1)
    doc = np.repeat(np.arange(len(part), dtype=np.uint64), n)
    kinds = np.zeros(len(part), np.int64)
    if len(words):
        order = np.sort(((doc << np.uint64(44)) | (words >> np.uint64(20))))
        new = np.r_[True, order[1:] != order[:-1]]
        kinds = np.bincount((order[new] >> np.uint64(44)).astype(np.int64), minlength=len(part))
    variety = kinds / some
    out = np.zeros((len(part), len(LABELLERS)), np.int8)

    def put(name: str, bad: np.ndarray, good: np.ndarray) -> None:
        out[:, LABELLERS.index(name)] = np.where(bad, -1, np.where(good, 1, 0))

    never = np.zeros(len(part), bool)
    put("symbols", share["symbols"] > 0.05, never)
    put("capitals", (share["capitals"] > 0.5) & (letters >= 20), never)
    put("repeats", (share["repeats"] > 0.3) & (n >= 8), never)
    put("exclamations", (share["exclamations"] > 0.08) & (n >= 5), never)
    put("word_length", (n >= 5) & ((length < 2) | (length > 14)), never)
    put("sentences", (n >= 60) & (per_stop > 60), (n > 0) & (per_stop >= 4) & (per_stop <= 40))
    put("bars", share["bars"] > 0.04, never)
    put("variety", (n >= 50) & (variety < 0.15 * np.sqrt(50 / some)), (n > 0) & (variety > 0.5 * np.sqrt(50 / np.maximum(some, 50))))
    put("odd_bytes", (share["odd_bytes"] > 0.06) & (n >= 5), never)
    put("plain_words", (share["plain_words"] < 0.7) & (n >= 5), (n > 0) & (share["plain_words"] > 0.97))
    return out, (words, starts, ends, bounds, same)


def pattern(matrix: np.ndarray) -> np.ndarray:
    return (matrix.astype(np.int64) + 1) @ (3 ** np.arange(matrix.shape[1]))


def unpattern(codes: np.ndarray, k: int) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(k) % 3 - 1


@dataclass
class WeakLabels:
    """What expectation-maximisation found: the share of good documents, and P(vote | class) of each labeller."""

    good: float
    table: np.ndarray  # labellers x classes (bad, good) x votes (-1, 0, 1)

    def posterior(self, matrix: np.ndarray) -> np.ndarray:
        """P(good) of rows of votes. That a labeller is silent counts too, by how often it is on either class."""
        score = np.tile(np.log([1 - self.good, self.good]), (len(matrix), 1))
        for j in range(matrix.shape[1]):
            score += np.log(self.table[j][:, matrix[:, j] + 1]).T
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -60, 60)))


def fit_labellers(matrix: np.ndarray, counts: np.ndarray, rounds: int = 100) -> WeakLabels:
    """Estimates from vote patterns and how many documents have each; the start is that one bad vote makes a document bad."""
    k = matrix.shape[1]
    p = np.where((matrix < 0).any(1), 0.05, 0.95)
    fit = WeakLabels(0.5, np.zeros((k, 2, 3)))
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        good = float(np.clip(weight[1].sum() / max(weight.sum(), 1e-9), 0.02, 0.98))
        table = np.empty((k, 2, 3))
        for j in range(k):
            for v in (-1, 0, 1):
                table[j, :, v + 1] = weight[:, matrix[:, j] == v].sum(1) + 1.0
            other = table[j, 1, 1:] / table[j, 1, 1:].sum()
            table[j, 1] += ALARM_WEIGHT * np.array([FALSE_ALARM, *((1 - FALSE_ALARM) * other)])
        fit = WeakLabels(good, table / table.sum(2, keepdims=True))
        new = fit.posterior(matrix)
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return fit


def features(parsed: tuple, data: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of hashed features, as shares of a document's words: the word, its last three bytes, its shape."""
    words, starts, ends, bounds, same = parsed
    n = np.diff(bounds)
    doc = np.repeat(np.arange(n_docs), n)
    if not len(words):
        return doc, doc, doc.astype(np.float64)
    padded = np.concatenate([np.zeros(3, np.uint8), data])
    last = [padded[ends + 2 - i].astype(np.uint64) * (ends - starts > i) for i in range(3)]
    tail = last[0] | last[1] << np.uint64(8) | last[2] << np.uint64(16)
    letter, upper = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data] | (data >= 128), out=letter[1:])
    np.cumsum(_UPPER[data], out=upper[1:])
    size = ends - starts
    letters, uppers = letter[ends] - letter[starts], upper[ends] - upper[starts]
    shape = np.minimum(size, 15) + 16 * np.minimum(size - letters, 3) + 64 * ((uppers > 0) + (uppers == letters)) + 256 * same.astype(np.int64)
    keys = [words, mix(tail + np.uint64(1 << 40)), mix(shape.astype(np.uint64) + np.uint64(1 << 41)), mix(same.astype(np.uint64) + np.uint64(1 << 42))]
    bucket = np.concatenate([(k >> np.uint64(64 - BITS)).astype(np.int64) for k in keys])
    value = np.tile(1 / n[doc], len(keys))
    return np.tile(doc, len(keys)), bucket, value


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(doc, value * self.weights[bucket], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_scorer(doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 150, l2: float = 1e-6) -> Scorer:
    """Logistic regression on soft labels by AdaGrad over all rows."""
    n = len(target)
    w, b = np.zeros(1 << BITS), 0.0
    seen, seen_b = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(doc, value * w[bucket], minlength=n)
        off = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - target
        g = np.bincount(bucket, value * off[doc], minlength=1 << BITS) + l2 * w * n
        seen += g * g
        seen_b += off.sum() ** 2
        w -= 0.5 * g / np.sqrt(seen)
        b -= 0.5 * off.sum() / np.sqrt(seen_b)
    return Scorer(w, b)


def fit_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[WeakLabels, Scorer]:
    """The labellers' estimates over all documents, and the scorer from a sample of about `sample` documents (three times that at most)."""
    docs = doc_texts(df, id_col, text_col)
    counted = map_slices(docs, "pattern long, n long", lambda part: dict(zip("pn", np.unique(pattern(votes(part)[0]), return_counts=True))))
    rows = counted.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # 3**10 rows at most
    codes, counts = np.array([r.pattern for r in rows], np.int64), np.array([r.n for r in rows], np.int64)
    labels = fit_labellers(unpattern(codes, len(LABELLERS)), counts)
    share = min(1.0, sample / max(1, int(counts.sum())))
    drawn_by = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    # equal rows are one; of the others each is drawn by itself, whatever its id
    chosen = docs.withColumn("draw", drawn_by).where(F.col("draw").bitwiseAND((1 << 53) - 1) < int(share * (1 << 53))).groupBy("draw").agg(F.first("text").alias("text")).select("draw", "text")

    def drawn(batches):
        for part in slices(batches, 1):
            matrix, parsed = votes(part)
            doc, bucket, value = features(parsed, part.data, len(part))
            key = doc << BITS | bucket
            kinds, at = np.unique(key, return_inverse=True)
            value = np.bincount(at, value, minlength=len(kinds)) if len(kinds) else value
            cuts = np.searchsorted(kinds >> BITS, np.arange(len(part) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(pattern(matrix)), pa.array([kinds[a:b] & ((1 << BITS) - 1) for a, b in zip(cuts[:-1], cuts[1:])], pa.list_(pa.int32())), pa.array([value[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.list_(pa.float32()))], ["pattern", "bucket", "value"])

    table = chosen.mapInArrow(drawn, "pattern long, bucket array<int>, value array<float>").limit(3 * sample).toArrow()  # a bound that chance does not reach
    if not table.num_rows:
        return labels, Scorer(np.zeros(1 << BITS), 1.0)
    bucket = table["bucket"].combine_chunks()
    sizes = np.diff(bucket.offsets.to_numpy())
    doc = np.repeat(np.arange(len(sizes)), sizes)
    target = labels.posterior(unpattern(table["pattern"].to_numpy(), len(LABELLERS)))
    return labels, fit_scorer(doc, bucket.flatten().to_numpy(), table["value"].combine_chunks().flatten().to_numpy(), target)


def quality_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_votes, weak_label (posterior of the votes), quality (the scorer's P(good)), kept (quality >= threshold).

    A null or empty text gets no votes: its weak label is what silence of all labellers says and its quality
    that of the scorer's bias. Ids may be null or repeated; each row is scored by itself. An empty
    table gives no rows.
    """
    labels, scorer = fit_quality(df, id_col, text_col, sample)
    sent = df.sparkSession.sparkContext.broadcast((labels, scorer))  # 2**BITS weights

    def work(part: Slice) -> dict:
        labels, scorer = sent.value
        matrix, parsed = votes(part)
        p = scorer.score(*features(parsed, part.data, len(part)), len(part))
        return {"doc_id": part.batch.column(0), "n_votes": (matrix != 0).sum(1).astype(np.int64), "weak_label": labels.posterior(matrix), "quality": p, "kept": p >= threshold}

    return map_slices(doc_texts(df, id_col, text_col), "doc_id long, n_votes long, weak_label double, quality double, kept boolean", work)


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of df whose text the scorer accepts, with all their columns."""
    labels, scorer = fit_quality(df, id_col, text_col, sample)
    sent, place = df.sparkSession.sparkContext.broadcast(scorer), df.columns.index(text_col)

    def run(batches):
        for part in slices(batches, place):
            _, parsed = votes(part)
            p = sent.value.score(*features(parsed, part.data, len(part)), len(part))
            yield part.batch.filter(pa.array(p >= threshold))

    return df.mapInArrow(run, df.schema)
