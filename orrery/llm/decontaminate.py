"""Benchmark decontamination: an FM-index for each shard of training text, searched backward for all windows.

A shard is a slice of documents as a sequence of word numbers. Words that no benchmark window uses
end a run, because no occurrence can cross them, and runs shorter than the shortest window cannot
hold one; what is left is indexed: suffix order by prefix doubling, its Burrows-Wheeler transform in
a wavelet matrix, and every SAMPLE-th text position kept with its suffix. All windows are searched
at once, word by word from their ends, and their occurrences are located by walking back to a
sampled position. Memory is bounded by the slice and by the block of benchmark windows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, BYTE_VALUES, LOWER, Slice, doc_texts, prefix_hash, slices, span_hash, words_of

SAMPLE = 8
#: Bytes of benchmark text in one block, and of texts that are searched for one block after the other where there are several.
BLOCK_BYTES = 4 << 20
GROUP_BYTES = 16 << 20


def suffix_order(text: np.ndarray) -> np.ndarray:
    """All suffixes of an int sequence in order, by prefix doubling over ranks."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    step = 1
    value = text[order]
    rank[order] = np.cumsum(np.r_[False, value[1:] != value[:-1]])
    while n and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * np.int64(n + 1) + second
        order = np.argsort(key, kind="stable")
        value = key[order]
        rank[order] = np.cumsum(np.r_[False, value[1:] != value[:-1]])
        step *= 2
    return order


class WaveletMatrix:
    """rank(symbol, i): how often the symbol stands in the first i places, for many (symbol, i) at once."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.zeros, self.ones = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(i), np.int64), i.astype(np.int64)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = self.ones[level][low], self.ones[level][high]
            low, high = np.where(one, self.zeros[level] + a, low - a), np.where(one, self.zeros[level] + b, high - b)
        return high - low


class FmIndex:
    """Backward search over a sequence of symbols 1..n_symbols; 0 ends a run."""

    def __init__(self, text: np.ndarray, n_symbols: int) -> None:
        order = suffix_order(text)
        self.bwt = text[order - 1]
        self.bits = max(1, int(n_symbols).bit_length())
        self.first = np.zeros(n_symbols + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=n_symbols + 1), out=self.first[1:])
        self.wave = WaveletMatrix(self.bwt, self.bits)
        kept = (order % SAMPLE == 0) | (self.bwt == 0)  # run starts too, so that no walk crosses a separator
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept = kept
        self.position = order[kept]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of each row; rows are right-aligned in the matrix."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1):
            live = live[(sizes[live] >= back) & (high[live] > low[live])]
            if not len(live):
                break
            symbol = patterns[live, -back]
            low[live] = self.first[symbol] + self.wave.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wave.rank(symbol, high[live])
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps to the suffix one place before until one is sampled."""
        out, at, steps = np.empty(len(at), np.int64), at.copy(), np.zeros(len(at), np.int64)
        todo = np.arange(len(at))
        while len(todo):
            done = self.kept[at[todo]]
            hit = todo[done]
            out[hit] = self.position[self.kept_before[at[hit]]] + steps[hit]
            todo = todo[~done]
            symbol = self.bwt[at[todo]]
            at[todo] = self.first[symbol] + self.wave.rank(symbol, at[todo])
            steps[todo] += 1
        return out


@dataclass
class Windows:
    """The distinct windows of a block of benchmark items, as numbers of words. Arrays only: 44 bytes a window and 8 a word."""

    vocabulary: np.ndarray  # sorted hashes; word number = place + 1
    patterns: np.ndarray  # right-aligned
    sizes: np.ndarray
    owners: np.ndarray  # places in ids of the items of each window, window after window
    bounds: np.ndarray
    ids: list
    shortest: int

    def items(self, window: int) -> list:
        return [self.ids[i] for i in self.owners[self.bounds[window] : self.bounds[window + 1]].tolist()]

    @staticmethod
    def of(rows: list[tuple], width: int) -> Windows:
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array([t or "" for _, t in rows], pa.string())], ["i", "t"])
        found = [hashed_words(part)[:2] for part in slices([batch], 1)]
        hashes = np.concatenate([h for h, _ in found]) if found else np.empty(0, np.uint64)
        n = np.concatenate([np.diff(b) for _, b in found]) if found else np.empty(0, np.int64)
        used, number = np.unique(hashes, return_inverse=True)
        windows = np.where(n > 0, np.maximum(1, n - width + 1), 0)
        owner = np.repeat(np.arange(len(n)), windows)
        first = (np.cumsum(n) - n)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        sizes = np.minimum(n, width)[owner]
        at = first[:, None] + np.arange(width) + sizes[:, None] - width
        patterns = np.where(at >= first[:, None], number.astype(np.int32)[np.maximum(at, 0)] + 1, 0).astype(np.int32) if len(owner) else np.zeros((0, width), np.int32)
        row, which = np.unique(np.ascontiguousarray(patterns).view(np.dtype((np.void, 4 * width))).ravel(), return_index=True, return_inverse=True)[1:]
        pairs = np.unique(which.astype(np.int64) * max(1, len(n)) + owner) if len(owner) else np.empty(0, np.int64)
        window, item = np.divmod(pairs, max(1, len(n)))
        sizes = sizes[row].astype(np.int64)
        return Windows(used, patterns[row], sizes, item.astype(np.int32), np.searchsorted(window, np.arange(len(row) + 1)), [x for x, _ in rows], int(sizes.min()) if len(sizes) else 0)


def hashed_words(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = LOWER[part.data]
    starts, ends, bounds = words_of(low, part.offsets, ALNUM)
    return span_hash(prefix_hash(BYTE_VALUES[0][low]), starts, ends), bounds, starts, ends


def occurrences(hashes: np.ndarray, bounds: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, window numbers) of all occurrences in the shard, through its FM-index."""
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(windows.sizes) or not len(hashes):
        return nothing
    vocab = windows.vocabulary
    sieve = np.zeros(1 << 16, bool)
    sieve[(vocab >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(sieve[(hashes >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(vocab, hashes[maybe]), len(vocab) - 1)
    known = vocab[place] == hashes[maybe]
    at, number = maybe[known], place[known] + 1
    if not len(at):
        return nothing
    doc = np.searchsorted(bounds, at, "right")
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(doc) != 0)]
    run = np.cumsum(new) - 1
    long_run = np.bincount(run) >= windows.shortest
    keep = long_run[run]
    at, number, new = at[keep], number[keep], new[keep]
    if not len(at):
        return nothing
    ends = np.cumsum(new) - 1  # one separator before each run, and one at the end
    place = np.arange(len(at)) + ends + 1
    text = np.zeros(len(at) + int(new.sum()) + 1, np.int64)
    word_at = np.full(len(text), -1, np.int64)
    text[place], word_at[place] = number, at
    index = FmIndex(text, len(vocab))
    low, high = index.search(windows.patterns, windows.sizes)
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count)), count)
    if not len(which):
        return nothing
    rows = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return word_at[index.locate(rows)], which


def covered(at: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which of n words stand inside any of the spans."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + sizes, -1)
    return np.cumsum(step)[:-1] > 0


def spans_in(marked: np.ndarray) -> np.ndarray:
    """Runs of marked places as rows (first, behind the last)."""
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def _blocks(bench: DataFrame, width: int, item_col: str, item_text_col: str, block_bytes: int) -> list[Broadcast]:
    """The windows of groups of items (by a hash of id and text) whose texts have block_bytes together, about; a broadcast for each group."""
    bench = bench.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, out = max(1, -(-int(total) // block_bytes)), []
    for i in range(n):
        rows = [tuple(r) for r in bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()]  # a block of bounded size
        out.append(bench.sparkSession.sparkContext.broadcast(Windows.of(rows, width)))
    return out


def _searched(batches: Iterable[pa.RecordBatch], text: int, blocks: list[Broadcast]) -> Iterator[tuple[Slice, tuple, np.ndarray | None, dict[int, set]]]:
    """Each slice with its parsed words, which of them stand in windows of any block (None for none of them), and the items by document.

    All blocks are searched for in the texts as they were given. Of several blocks one at a time is held, for GROUP_BYTES of texts.
    """

    def search(group: list[Slice]):
        parsed = [hashed_words(part) for part in group]
        marked: list[np.ndarray | None] = [None] * len(group)
        found: list[dict[int, set]] = [defaultdict(set) for _ in group]
        for block in blocks:
            windows = block.value
            for k, (hashes, bounds, _, _) in enumerate(parsed):
                at, which = occurrences(hashes, bounds, windows)
                if len(at):
                    own = covered(at, windows.sizes[which], len(hashes))
                    marked[k] = own if marked[k] is None else marked[k] | own
                    for d, w in {*zip((np.searchsorted(bounds, at, "right") - 1).tolist(), which.tolist())}:
                        found[k][d].update(windows.items(w))
            if len(blocks) > 1 and block._path is not None:
                del windows, block._value  # read again from the worker's file
        yield from zip(group, parsed, marked, found)

    group, size = [], 0
    for part in slices(batches, text):
        group.append(part)
        size += len(part.data)
        if len(blocks) == 1 or size >= GROUP_BYTES:
            yield from search(group)
            group, size = [], 0
    yield from search(group)


SPANS = "doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


def contaminated_spans(df: DataFrame, bench: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: its number of words, the merged spans of words to remove, and the items found (as text).

    An item of fewer words than width is one window, an item without words has none. Items without an
    id are searched for like any other, and are together one null among the items. Null texts have no
    words; repeated ids are repeated rows. A benchmark of more than block_bytes is searched for in
    blocks, and the blocks' spans are merged in each row: no item is left out.
    """
    blocks = _blocks(bench, width, item_col, item_text_col, block_bytes)

    def run(batches):
        for part, (_, bounds, _, _), marked, found in _searched(batches, 1, blocks):
            spans = [spans_in(marked[bounds[d] : bounds[d + 1]]).tolist() if d in found else [] for d in range(len(part))]
            columns = [
                part.batch.column(0), pa.array(np.diff(bounds), pa.int64()),
                pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int32())), pa.array([[b for _, b in s] for s in spans], pa.list_(pa.int32())),
                pa.array([sorted(found[d], key=lambda x: (x is None, x or "")) if d in found else [] for d in range(len(part))], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SPANS.split(", ")])

    return doc_texts(df, id_col, text_col).mapInArrow(run, SPANS)


def contamination_report(df: DataFrame, bench: DataFrame, width: int = 10, **columns) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, from the merged spans.

    All items without an id count as one in n_items, and items_sha256 leaves them out.
    """
    spans = contaminated_spans(df, bench, width, **columns)
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return spans.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


def remove_contamination(df: DataFrame, bench: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The table with each span cut from its text, from the span's first word to its last; all other columns as they are.

    A document without hits keeps its text unchanged, null included. The spans of all blocks of a
    benchmark over block_bytes are found in the given text, merged, and cut at once.
    """
    blocks = _blocks(bench, width, item_col, item_text_col, block_bytes)
    place, schema = df.columns.index(text_col), df.schema

    def run(batches):
        for part, (_, bounds, starts, ends), marked, found in _searched(batches, place, blocks):
            if marked is not None:
                texts = part.batch.column(place).to_pylist()
                for d in sorted(found):
                    base, raw = part.offsets[d], part.data[part.offsets[d] : part.offsets[d + 1]].tobytes()
                    out, last = [], 0
                    for a, b in spans_in(marked[bounds[d] : bounds[d + 1]]).tolist():
                        out.append(raw[last : starts[bounds[d] + a] - base])
                        last = ends[bounds[d] + b - 1] - base
                    texts[d] = b"".join([*out, raw[last:]]).decode("utf-8", "replace")
                columns = list(part.batch.columns)
                columns[place] = pa.array(texts, part.batch.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.batch.schema)
            else:
                yield part.batch

    return df.mapInArrow(run, schema)
