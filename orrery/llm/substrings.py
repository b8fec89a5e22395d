"""Substring dedup by level-wise doubling over word windows.

The first level has windows of `start` words. Only where they are found in two rows are they extended to
twice that length, and so on up to the asked length; where no candidate survives there is no further
level, and past the asked length a longer repeat cannot cover another word. Two things keep a level
small. Of the windows of a level only one in each full window is looked at, its anchor: the one of
smallest hash, which is the same wherever the full window stands. And full windows around one anchor of
the last level before the asked length are handled as a run: if a whole run stands in an earlier
document, its windows need not be looked at one by one.

Rows go by a hash of id and text, so that what is gathered for a row is bounded by its text. Every table
that is kept between steps is written to the shared folder. Groups of equal runs or windows are only ever
counted (smallest document id) and joined back, never gathered in one place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, SPACE, Slice, anchors, discard, doc_texts, lists_of, mix, prefix_hash, slices, span_hash, words_of, written

WIDTH = 13
#: Words of the first level's windows.
START = 7


def _parse(part: Slice) -> tuple:
    starts, ends, bounds = words_of(part.data, part.offsets, ~SPACE)
    words = span_hash(prefix_hash(BYTE_VALUES[0][part.data]), starts, ends)
    return starts, ends, bounds, prefix_hash(words), len(words)


def levels(width: int, start: int) -> list[int]:
    """Lengths of the windows of each level below the asked length."""
    out = [min(start, width)]
    while 2 * out[-1] < width:
        out.append(2 * out[-1])
    return out


def _runs(part: Slice, width: int, length: int, go: np.ndarray | None = None) -> tuple:
    """Runs of full windows that share an anchor of so many words: document, first word, number of windows, hash of the anchor, hash of the run. Of windows where go is true only."""
    _, _, bounds, prefix, n = _parse(part)
    at = np.arange(max(0, n - length + 1))
    grams = span_hash(prefix, at, at + length)
    doc = np.repeat(np.arange(len(part)), np.diff(bounds))
    m = max(0, n - width + 1)
    valid = doc[:m] == doc[width - 1 :] if m else np.empty(0, bool)
    first, number, anchor = anchors(grams, width - length + 1, valid if go is None else valid & go)
    return doc[first], first, number, grams[anchor], span_hash(prefix, first, first + number + width - 1), bounds


def _surviving(part: Slice, width: int, length: int, list_at: int) -> np.ndarray:
    """Which full windows have an anchor that is listed for their row."""
    doc, first, number, h, _, bounds = _runs(part, width, length)
    values, cuts = lists_of(part.batch.column(list_at))
    owner = np.repeat(np.arange(len(part), dtype=np.uint64), np.diff(cuts))
    own = np.isin(mix(h + mix(doc.astype(np.uint64))), mix(values.view(np.uint64) + mix(owner)))
    out = np.zeros(max(0, int(bounds[-1]) - width + 1), bool)
    first, number = first[own], number[own]
    out[np.repeat(first - np.cumsum(number) + number, number) + np.arange(number.sum())] = True
    return out


def _with(docs: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """doc_id, text, key of each row, with what was found for it."""
    return docs.join(found.withColumnRenamed("key", "own"), F.col("key") == F.col("own"), how).drop("own")


def candidates(docs: DataFrame, width: int = WIDTH, start: int = START) -> tuple[DataFrame, int]:
    """key, alive: the anchors of each row that are found in another row, at the last level. And that level's length. docs: doc_id, text, key."""
    alive, before = None, 0
    for length in levels(width, start):

        def level(batches, length=length, before=before):
            for part in slices(batches, 1):
                doc, _, _, h, _, _ = _runs(part, width, length, _surviving(part, width, before, 3) if before else None)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])][: len(h)]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), part.batch.column(2).take(pa.array(doc[new]))], ["h", "key"])

        given = docs if alive is None else _with(docs, alive)
        seen = written(given.mapInArrow(level, "h long, key long"), f"windows-of-{length}")
        repeated = seen.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("h")
        last, alive = alive, written(seen.join(repeated, "h").groupBy("key").agg(F.collect_set("h").alias("alive")), "survivors")
        discard(seen, *([last] if last is not None else []))
        before = length
    return alive, before


def duplicate_windows(docs: DataFrame, width: int = WIDTH, start: int = START) -> DataFrame:
    """key, first, n: runs of n windows, from word number `first` on, that also start in a document of a smaller id. docs: doc_id, text, key."""
    docs = docs.where("doc_id is not null and text is not null")
    alive, length = candidates(docs, width, start)

    def full(batches):
        for part in slices(batches, 1):
            doc, first, number, h, c, bounds = _runs(part, width, length, _surviving(part, width, length, 3))
            ids = [part.batch.column(i).take(pa.array(doc)) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), *ids, pa.array((first - bounds[doc]).astype(np.int32)), pa.array(number.astype(np.int32))], ["h", "c", "doc_id", "key", "first", "n"])

    runs = written(_with(docs, alive).mapInArrow(full, "h long, c long, doc_id long, key long, first int, n int"), "runs")
    discard(alive)
    kinds = written(runs.groupBy("h", "c").agg(F.min("doc_id").alias("least")), "kinds")
    mixed = kinds.groupBy("h").agg(F.min("least").alias("lo"), F.max("least").alias("hi"), F.count("*").alias("kinds")).where("kinds > 1").select("h", F.lit(True).alias("mixed"))
    placed = runs.join(kinds.join(mixed, "h", "left"), ["h", "c"])
    # a run of an earlier document is done; the first of its kind is opened if another kind has the same anchor
    placed = written(placed.where("doc_id > least or mixed").select("key", "first", "n", (F.col("doc_id") > F.col("least")).alias("whole")), "placed")
    discard(runs, kinds)

    def opened(batches):
        for part in slices(batches, 1):
            _, _, bounds, prefix, _ = _parse(part)
            (first, cuts), (number, _) = lists_of(part.batch.column(3)), lists_of(part.batch.column(4))
            doc = np.repeat(np.arange(len(part)), np.diff(cuts))
            doc, first = np.repeat(doc, number), np.repeat(first.astype(np.int64), number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            at = first + bounds[doc]
            window = span_hash(prefix, at, at + width)
            half = (width + 1) // 2  # both halves again, so that equal windows agree in 128 bits
            check = mix(span_hash(prefix, at, at + half) + mix(span_hash(prefix, at + width - half, at + width)))
            ids = [part.batch.column(i).take(pa.array(doc)) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), pa.array(check.view(np.int64)), *ids, pa.array(first.astype(np.int32))], ["w", "v", "doc_id", "key", "first"])

    listed = placed.where("not whole").groupBy("key").agg(F.collect_set(F.struct("first", "n")).alias("runs")).select("key", F.col("runs.first").alias("firsts"), F.col("runs.n").alias("ns"))
    windows = written(_with(docs, listed).mapInArrow(opened, "w long, v long, doc_id long, key long, first int"), "windows")
    early = windows.groupBy("w", "v").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("w", "v", "least")
    single = windows.join(early, ["w", "v"]).where("doc_id > least").select("key", "first", F.lit(1).alias("n"))
    out = written(placed.where("whole").select("key", "first", "n").unionByName(single), "found-windows")
    discard(placed, windows)
    return out


def drop_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, start: int = START, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), and with with_text the kept text.

    Words are runs of anything but ASCII white space. A null text has no words. A row without an id
    is neither cut nor a reason to cut; rows that share an id do not cut each other. An empty table
    gives no rows.
    """
    docs = doc_texts(df, id_col, text_col).withColumn("key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = duplicate_windows(docs, width, start).groupBy("key").agg(F.collect_set(F.struct("first", "n")).alias("runs")).select("key", F.col("runs.first").alias("firsts"), F.col("runs.n").alias("ns"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def run(batches):
        for part in slices(batches, 1):
            starts, ends, bounds, _, n = _parse(part)
            (first, cuts), (number, _) = lists_of(part.batch.column(3)), lists_of(part.batch.column(4))
            at = first + bounds[np.repeat(np.arange(len(part)), np.diff(cuts))]
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + number + width - 1, -1)
            cut = np.cumsum(step)[:-1] > 0
            removed = np.diff(np.r_[0, np.cumsum(cut)][bounds])
            digests, texts = [], []
            raw = part.data.tobytes()
            for d in range(len(part)):
                words = raw[part.offsets[d] : part.offsets[d + 1]].split()
                if removed[d]:
                    words = [w for w, x in zip(words, cut[bounds[d] : bounds[d + 1]].tolist()) if not x]
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "replace") if with_text else None)
            columns = [part.batch.column(0), pa.array(np.diff(bounds)), pa.array(removed), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, [x.split()[0] for x in schema.split(", ")])

    return _with(docs, found, "left").mapInArrow(run, schema)
