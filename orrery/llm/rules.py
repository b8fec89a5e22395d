"""Quality rules: base counts, and divergence of a document's histograms from those of its language.

Two histograms of each document, of character classes and of common words, are compared with
reference histograms of its language by Jensen-Shannon distance. The references are gathered from
all documents of the language that pass the base rules; a language with little text, or none given,
uses the histogram of all languages together. Texts below a minimum length are not judged by distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, LOWER, SPACE, Slice, char_count, discard, lists_of, mix, prefix_hash, slices, span_hash, window_hash, words_of, written

#: Distances (square root of the divergence in bits) above which a text is not kept.
CHAR_LIMIT, WORD_LIMIT = 0.3, 0.5
MIN_CHARS, MIN_WORDS = 200, 50
#: Words of text below which a language has no reference of its own.
LANGUAGE_WORDS = 2000

# Common words by language.
COMMON = {
    "en": "the of and to in is that it for was on are as with be by this from at or an not have which you",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se avec ce",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}
WORDS = sorted({w for line in COMMON.values() for w in line.split()})

_CLASS = np.full(256, 8, np.uint8)  # 8: other control characters
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10] = 0, 1, 2, 3, 4
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 5  # punctuation
_CLASS[np.frombuffer(b"#*$%&|<>", np.uint8)] = 6
_CLASS[0xC0:] = 7  # first byte of a longer character; its other bytes are not counted
_CLASS[0x80:0xC0] = 9
CLASSES = 9

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1


def _word_keys() -> tuple[np.ndarray, np.ndarray]:
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(WORDS)), pa.int64()), pa.array(WORDS, pa.string())], ["i", "w"])
    part = next(slices([batch], 1))
    low = LOWER[part.data]
    starts, ends, _ = words_of(low, part.offsets, ~SPACE)
    keys = span_hash(prefix_hash(BYTE_VALUES[0][low]), starts, ends)
    order = np.argsort(keys)
    return keys[order], order


WORD_KEYS, WORD_ORDER = _word_keys()
_SIEVE = np.zeros(1 << 16, bool)
_SIEVE[(WORD_KEYS >> np.uint64(48)).astype(np.int64)] = True


@dataclass
class Counts:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    chars: np.ndarray  # documents x CLASSES
    words: np.ndarray  # documents x (common words and all others)

    @property
    def failed(self) -> np.ndarray:
        return (self.n_words < 50) | (100 * self.n_repeat_words > 50 * self.n_words)


def _ranked(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Equal numbers for equal (document, key), by a hash of both."""
    return mix(key + mix(doc.astype(np.uint64) + np.uint64(0x51ED270B)))


def count(part: Slice) -> Counts:
    data, offsets, n_docs = part.data, part.offsets, len(part)
    starts, ends, bounds = words_of(data, offsets, ~SPACE)
    n = np.diff(bounds)
    prefix = prefix_hash(BYTE_VALUES[0][data])
    hashes = span_hash(prefix, starts, ends)
    doc = np.repeat(np.arange(n_docs), n)
    chars = char_count(data)
    char_total = np.concatenate([[0], np.cumsum(chars[ends] - chars[starts])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data], dtype=np.int64)])

    # lines: from a document's begin or behind a line end, to the next line end or the document's end
    breaks = np.flatnonzero(data == 10)
    first = np.concatenate([offsets[:-1], breaks + 1])
    line_doc = np.concatenate([np.arange(n_docs), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((first, line_doc))
    first, line_doc = first[order], line_doc[order]
    behind = np.searchsorted(breaks, first)
    last = np.minimum(np.concatenate([breaks, [len(data)]])[behind], offsets[line_doc + 1]) if len(first) else first
    worded = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last, line_doc = first[worded], last[worded], line_doc[worded]
    line_key = _ranked(line_doc, span_hash(prefix, first, last))
    _, kept = np.unique(line_key, return_index=True)
    n_dup = np.bincount(line_doc, minlength=n_docs) - np.bincount(line_doc[kept], minlength=n_docs)

    # words in windows of three that stand twice or more in their text
    windows = window_hash(hashes, 3)
    own = doc[: len(windows)] == doc[2:] if len(windows) else np.empty(0, bool)
    at = np.flatnonzero(own)
    key = _ranked(doc[at], windows[at])
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1] if len(ranked) else np.empty(0, bool)
    again = np.zeros(len(at), bool)
    if len(at):
        again[order[1:][same]] = again[order[:-1][same]] = True
    marked = np.zeros(len(hashes) + 3, bool)
    for j in range(3):
        marked[at[again] + j] = True
    repeats = np.bincount(doc, marked[: len(doc)], minlength=n_docs).astype(np.int64)

    # histograms
    owner = np.repeat(np.arange(n_docs) * 10, np.diff(offsets))
    by_class = np.bincount(owner + _CLASS[data], minlength=n_docs * 10).reshape(n_docs, 10)[:, :CLASSES]
    low = LOWER[data]
    low_hash = span_hash(prefix_hash(BYTE_VALUES[0][low]), starts, ends)
    maybe = np.flatnonzero(_SIEVE[(low_hash >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(WORD_KEYS, low_hash[maybe]), len(WORD_KEYS) - 1)
    hit = WORD_KEYS[place] == low_hash[maybe]
    width = len(WORDS) + 1
    common = np.bincount(doc[maybe[hit]] * width + WORD_ORDER[place[hit]], minlength=n_docs * width).reshape(n_docs, width)
    common[:, -1] = n - common.sum(1)
    return Counts(n, np.diff(char_total[bounds]), np.diff(symbols[offsets]), n_dup, repeats, by_class, common)


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row from the reference row beside it, both made shares; 0 for an empty row."""
    total, base = counts.sum(1, keepdims=True), reference.sum(1, keepdims=True)
    p, q = counts / np.maximum(total, 1), reference / np.maximum(base, 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where((total[:, 0] > 0) & (base[:, 0] > 0), np.sqrt(np.maximum(bits, 0) / 2), 0.0)


def references(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, np.ndarray]:
    """A table (lang, reference) of all languages with LANGUAGE_WORDS, and the histogram of all languages; of all documents that pass the base rules.

    A reference has the character classes and then the words. The table is kept in the shared folder,
    so that its size is known to the joins with it.
    """
    docs = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    width = CLASSES + len(WORDS) + 1

    def gather(batches):
        for part in slices(batches, 1):
            found = count(part)
            both = np.concatenate([found.chars, found.words], 1)[~found.failed]
            codes = part.batch.column(0).fill_null("").dictionary_encode() if part.batch.num_rows else None
            group = codes.indices.to_numpy()[~found.failed]
            for g in np.unique(group).tolist():
                sums = both[group == g].sum(0)
                yield pa.RecordBatch.from_arrays([pa.array([codes.dictionary[g].as_py()] * width, pa.string()), pa.array(range(width), pa.int32()), pa.array(sums, pa.int64())], ["lang", "bin", "n"])

    sums = written(docs.mapInArrow(gather, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")), "language-sums")
    everything = {r.bin: r.n for r in sums.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # width rows
    own = sums.where("lang <> ''").groupBy("lang").agg(F.sum(F.when(F.col("bin") >= CLASSES, F.col("n"))).alias("words"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found"))
    found = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("found", i), F.lit(0)).cast("double"))
    out = written(own.where(F.col("words") >= LANGUAGE_WORDS).select("lang", found.alias("reference")), "language-references")
    discard(sums)
    return out, np.array([everything.get(i, 0) for i in range(width)], np.float64)


RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"

COUNTED = RULES[: RULES.index(", char_distance")] + ", lang string, histogram array<int>"
COUNTED_NAMES = [x.split()[0] for x in COUNTED.split(", ")]


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """The base counts, the two distances, and kept: base passed and both distances within their limits.

    Below MIN_CHARS characters the character distance, and below MIN_WORDS words the word distance,
    is 0 and judges nothing. A null text is an empty one and fails the base rule of 50 words; a null
    or unknown language is compared with all languages together. Null and repeated ids are rows like
    any other, an empty table gives none.
    """
    known, everything = references(df, id_col, text_col, lang_col)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    width = CLASSES + len(WORDS) + 1

    def run(batches):
        for part in slices(batches, 1):
            found = count(part)
            both = np.concatenate([found.chars, found.words], 1).astype(np.int32)
            histogram = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(both.ravel()))
            columns = [part.batch.column(0), found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words, found.failed, part.batch.column(2), histogram]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], COUNTED_NAMES)

    def judge(batches):
        for b in batches:
            if not b.num_rows:
                continue
            counts = lists_of(b.column("histogram"))[0].reshape(-1, width)
            values, bounds = lists_of(b.column("reference"))
            reference = np.tile(everything, (b.num_rows, 1))
            reference[np.diff(bounds) > 0] = values.reshape(-1, width)
            char = distance(counts[:, :CLASSES], reference[:, :CLASSES])
            word = distance(counts[:, CLASSES:], reference[:, CLASSES:])
            char[counts[:, :CLASSES].sum(1) < MIN_CHARS] = 0
            word[b.column("n_words").to_numpy() < MIN_WORDS] = 0
            kept = ~b.column("base_failed").to_numpy(zero_copy_only=False) & (char <= char_limit) & (word <= word_limit)
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(char), pa.array(word), pa.array(kept)], [x.split()[0] for x in RULES.split(", ")])

    counted = docs.mapInArrow(run, COUNTED).join(known, "lang", "left")  # broadcast or sorted, by the size of known
    return counted.select(*COUNTED_NAMES[:7], "histogram", "reference").mapInArrow(judge, RULES)
