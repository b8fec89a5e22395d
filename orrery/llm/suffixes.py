"""Suffix-array dedup of byte strings.

Equal strings of PASSAGE bytes or more hold the same anchor: the 64-byte gram of smallest hash in their
first PASSAGE bytes. So the bytes around anchors that occur once are unique and need no sorting, and the
bytes around anchors of equal hash are brought together. Contexts of equal hash are one with a count, and
two of their places are looked at. On each batch of contexts a suffix array is built by two-stage sorting;
common prefixes of neighbours are counted on the bytes, and a string is repeated if its suffix has width
bytes in common with the one before or behind it. Hashes only say what need not be looked at.

A hash with more contexts than HOT (the edges of a passage that very many documents share) is not
brought together in one task: its strings are counted by a 128-bit hash over all tasks instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Slice, anchors, discard, lists_of, map_slices, mix, prefix_hash, slices, span_hash, written

WIDTH, GRAM = 400, 64
#: Bytes from which on repeats are reported: some fifty words. Shorter ones are not looked for.
PASSAGE = 300
HOT = 4096
BATCH_BYTES = 1 << 20
#: A byte that no UTF-8 text holds.
STOP = 0xFF


def types_b(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last one is not."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.zeros(n, bool)
    known = at < n
    out[:-1][known] = step[at[known]] > 0
    return out


def sort_suffixes(text: np.ndarray, which: np.ndarray, width: int) -> np.ndarray:
    """The given suffixes in order of their first width bytes: by 8 bytes, then by the next 8, then those still equal by the bytes themselves."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(text) + 9, 8), (1, 1))
    first = np.ascontiguousarray(words[which]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(first, kind="stable")
    which, first = which[order], first[order]
    tied = np.zeros(len(which), bool)
    tied[1:] = first[1:] == first[:-1]
    tied[:-1] |= tied[1:].copy()
    at = np.flatnonzero(tied)
    if len(at):
        group = np.cumsum(np.r_[True, first[at][1:] != first[at][:-1]])
        second = np.ascontiguousarray(words[np.minimum(which[at] + 8, len(text) + 8)]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((second, group))
        which[at] = which[at][order]
        group, second = group[order], second[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(at)])
        many = np.repeat(size > 1, size)
        left = at[many]
        raw = text.tobytes()
        ends = np.cumsum(size[size > 1])
        done = 0
        while done < len(left):  # whole groups, some ten thousand suffixes at a time
            to = int(ends[min(np.searchsorted(ends, done + 20_000), len(ends) - 1)])
            part = which[left[done:to]].tolist()
            part.sort(key=lambda i: raw[i : i + width])
            which[left[done:to]] = part
            done = to
    return which


def suffix_array(text: np.ndarray, width: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of a byte sequence, ordered by their first width bytes at least: all of them, or those wanted and some more.

    Only suffixes smaller than their successors are sorted directly. A scan over the buckets of first
    bytes, in order, then places each other suffix: it comes in the order of its successor, which
    stands in an earlier place. Whole buckets, and levels of a run of one byte, are placed at a time.
    Where some are wanted only, those between them and their next directly sorted suffix are placed too.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    b = types_b(text)
    if wanted is None:
        needed = np.ones(n, bool)
    else:
        last = np.maximum.accumulate(np.where(wanted, np.arange(n), -1))  # the wanted place at or before each
        sorted_before = np.concatenate([[0], np.cumsum(b)])[:-1]
        needed = (last >= 0) & (sorted_before == sorted_before[last])  # nothing from there to here is sorted directly
    sorted_b = sort_suffixes(text, np.flatnonzero(b & needed), width)
    cuts = np.searchsorted(text[sorted_b], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1]:
        waiting[text[-1]].append(np.array([n - 1]))  # its successor is empty, and so before all
    out = []
    for c in range(256):
        levels = []
        level = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        while len(level):
            levels.append(level)
            before = level[level > 0] - 1
            level = before[(text[before] == c) & needed[before]]
        bucket = np.concatenate([*levels, sorted_b[cuts[c] : cuts[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & needed[before]]
        if len(before):
            byte = text[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            edge = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            for x, y in zip(edge, np.r_[edge[1:], len(before)]):
                waiting[byte[x]].append(before[x:y])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes of each pair have in common, `most` at most; eight at a time."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.zeros(len(text) + 1, np.uint64)
    for i in range(8):
        eight |= padded[i : i + len(eight)].astype(np.uint64) << np.uint64(8 * i)
    out = np.zeros(len(left), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        off = eight[left[live] + out[live]] ^ eight[right[live] + out[live]]
        equal = (off & -off).astype(np.float64)  # the lowest bit that differs; its byte is the first that does
        out[live] += np.where(off == 0, 8, np.log2(np.maximum(equal, 1)).astype(np.int64) // 8)
        live = live[(off == 0) & (out[live] < most[live])]
    return np.minimum(out, most)


def adjacent_common_prefixes(text: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in the order with the one before it; ends: where the context of each place ends.

    If the neighbours of two adjoining places adjoin too, in the same order, the second pair has one byte
    less in common than the first. So only the first pair of each such chain is compared.
    """
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0)
    other = before[at]
    chained = np.zeros(len(at), bool)
    chained[1:] = (np.diff(at) == 1) & (np.diff(other) == 1) & (text[at[:-1]] == text[other[:-1]]) & (at[:-1] < ends[at[:-1]]) & (other[:-1] < ends[other[:-1]])
    first = np.flatnonzero(~chained)
    a, b = at[first], other[first]
    common = common_prefixes(text, a, b, np.minimum(ends[a] - a, ends[b] - b))
    chain = np.cumsum(~chained) - 1
    by_place = np.zeros(len(text), np.int64)
    by_place[at] = common[chain] - (at - a[chain])
    out[1:] = by_place[order[1:]]
    return out


def longest_repeats(contexts: list[bytes], starts: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, bounds): for each of the first starts[i] places of each context, the bytes that it has in common with another such place, at most."""
    sizes = np.array([len(c) + 1 for c in contexts])
    text = np.frombuffer(bytes([STOP]).join([*contexts, b""]), np.uint8)
    begin = np.cumsum(sizes) - sizes
    ends = np.repeat(begin + sizes - 1, sizes)  # of each place
    wanted = np.arange(len(text)) - np.repeat(begin, sizes) < np.repeat(starts, sizes)
    order = suffix_array(text, width, wanted)
    order = order[wanted[order]]
    common = adjacent_common_prefixes(text, order, ends)
    out = np.zeros(len(text), np.int64)
    out[order] = common
    out[order[:-1]] = np.maximum(out[order[:-1]], common[1:])
    return out, np.append(begin, len(text))


def covered_runs(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, behind the last) byte of the runs that strings of width bytes at these starts cover."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > width)
    return starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + width


RUNS = "firsts array<int>, ends array<int>, p_firsts array<int>, p_ends array<int>"


def repeated_runs(df: DataFrame, width: int = WIDTH, passage: int = PASSAGE) -> DataFrame:
    """k1, k2 (hashes of a text), firsts, ends: the runs of bytes that repeated strings of width bytes cover, and p_firsts, p_ends: those of passage bytes. Runs may overlap. df: doc_id, text, k1, k2."""
    passage = min(passage, width)
    gram = min(GRAM, passage)
    source = df.where(F.octet_length("text") >= passage)

    def scan(part: Slice) -> dict | None:
        prefix = prefix_hash(BYTE_VALUES[0][part.data])
        n = len(part.data)
        m = max(0, n - passage + 1)
        room = np.zeros(n + 1, np.int32)
        np.add.at(room, part.offsets[:-1], 1)
        np.add.at(room, np.maximum(part.offsets[1:] - passage + 1, part.offsets[:-1]), -1)
        valid = np.cumsum(room)[:m] > 0
        at = np.arange(n - gram + 1)
        grams = span_hash(prefix, at, at + gram)
        first, number, anchor = anchors(grams, passage - gram + 1, valid)
        if not len(first):
            return None
        doc = np.searchsorted(part.offsets, first, "right") - 1
        ids = [part.batch.column(i).take(pa.array(doc)) for i in (0, 2, 3)]
        second = prefix_hash(BYTE_VALUES[1][part.data])
        end = np.minimum(first + number + width - 1, part.offsets[doc + 1])
        context = mix(span_hash(prefix, first, end) + mix(span_hash(second, first, end) + number.astype(np.uint64)))
        return {"doc_id": ids[0], "k1": ids[1], "k2": ids[2], "h": grams[anchor].view(np.int64), "c": context.view(np.int64), "first": (first - part.offsets[doc]).astype(np.int32), "n": number.astype(np.int32), "size": (end - first).astype(np.int32)}

    found = map_slices(source, "doc_id long, k1 long, k2 int, h long, c long, first int, n int, size int", scan)
    places = written(found.groupBy("h", "c", "k1", "k2", "first", "n", "size").agg(F.count("*").alias("count"), F.min("doc_id").alias("doc_id")), "anchors")
    one = F.struct("k1", "k2", "doc_id", "first", "n", "size")
    kinds = places.groupBy("h", "c").agg(F.sum("count").alias("count"), F.min(one).alias("low"), F.max(one).alias("high"))
    kinds = written(kinds.withColumn("high", F.when(F.col("count") > 1, F.col("high"))), "contexts")
    groups = kinds.groupBy("h").agg(F.sum("count").alias("total"), F.count("*").alias("kinds")).where("total > 1").select("h", "kinds")
    both = F.when(F.col("count") > 1, F.array("low", "high")).otherwise(F.array("low"))  # a text that is found twice is its own other place
    chosen = kinds.join(groups, "h").select("h", "c", "count", "kinds", F.posexplode(both).alias("copy", "at"))
    chosen = chosen.select("h", "c", "count", "kinds", "copy", F.col("at.k1").alias("r1"), F.col("at.k2").alias("r2"), F.col("at.doc_id").alias("own"), "at.first", "at.n", "at.size")
    texts = chosen.join(source, (F.col("r1") == F.col("k1")) & (F.col("r2") == F.col("k2")) & F.col("own").eqNullSafe(F.col("doc_id")))
    bytes_of = F.substring(F.col("text").cast("binary"), F.col("first") + 1, F.col("size"))
    contexts = written(texts.select("h", "c", "copy", "n", "kinds", bytes_of.alias("context")), "context-bytes")
    discard(kinds)
    schema = f"h long, c long, {RUNS}"

    def result(rows: list[tuple], lengths: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        out, keep = [], []
        for i, (h, c, copy, n) in enumerate(rows):
            own = lengths[bounds[i] : bounds[i] + n]
            if copy == 0 and (own >= passage).any():
                keep.append((h, c))
                out.append([*covered_runs(np.flatnonzero(own >= width), width), *covered_runs(np.flatnonzero(own >= passage), passage)])
        columns = [pa.array([k[j] for k in keep], pa.int64()) for j in range(2)] + [pa.array([x[j] for x in out], pa.list_(pa.int32())) for j in range(4)]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    def sort_groups(batches):
        rows, held, size, last = [], [], 0, None

        def flush():
            return result(rows, *longest_repeats(held, [r[3] for r in rows], width))

        for batch in batches:
            for h, c, copy, n, context in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if h != last and size >= BATCH_BYTES:
                    yield flush()
                    rows, held, size = [], [], 0
                if rows and rows[-1][:3] == (h, c, copy):  # repeated rows of the table bring a context again
                    continue
                last = h
                rows.append((h, c, copy, n))
                held.append(context)
                size += len(context) + 1
        if rows:
            yield flush()

    together = contexts.where(F.col("kinds") <= HOT).select("h", "c", "copy", "n", "context").repartition("h").sortWithinPartitions("h", "c", "copy")
    runs = together.mapInArrow(sort_groups, schema)

    def all_strings(size: int):
        def strings(part: Slice) -> dict:
            n = np.minimum(part.batch.column(3).to_numpy(), np.maximum(np.diff(part.offsets) - size + 1, 0))
            owner = np.repeat(np.arange(len(part)), n)
            at = part.offsets[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w, v = (span_hash(prefix_hash(values[part.data]), at, at + size).view(np.int64) for values in BYTE_VALUES)
            return {"w": w, "v": v, **{x: part.batch.column(i).take(pa.array(owner)) for x, i in (("h", 0), ("c", 2), ("copy", 4))}, "first": (at - part.offsets[owner]).astype(np.int32)}

        return strings

    made: list[DataFrame] = []
    hot = contexts.where(F.col("kinds") > HOT).dropDuplicates(["h", "c", "copy"]).select("h", "context", "c", "n", "copy")
    if not hot.isEmpty():
        marked = []
        for size in (width, passage):
            strings = written(map_slices(hot, "w long, v long, h long, c long, copy int, first int", all_strings(size)), "strings")
            made.append(strings)
            again = strings.groupBy("w", "v").agg(F.count("*").alias("total")).where("total > 1").select("w", "v")
            firsts = F.sort_array(F.collect_set(F.when(F.col("copy") == 0, F.col("first"))))
            marked.append(strings.join(again, ["w", "v"]).groupBy("h", "c").agg(firsts.alias(f"s{size}")))
        long, all_ = marked if passage < width else (marked[0], marked[0].withColumnRenamed(f"s{width}", f"t{width}"))
        short = f"s{passage}" if passage < width else f"t{width}"
        both = all_.join(long, ["h", "c"], "left").withColumn(f"s{width}", F.coalesce(f"s{width}", F.array().cast("array<int>")))
        runs = runs.union(both.select("h", "c", f"s{width}", F.transform(f"s{width}", lambda x: x + width), short, F.transform(short, lambda x: x + passage)))
    runs = written(runs, "context-runs")
    discard(contexts, *made)
    at = written(places.join(runs, ["h", "c"]).select("k1", "k2", *(F.transform(x, lambda y: y + F.col("first")).alias(x) for x in ("firsts", "ends", "p_firsts", "p_ends"))), "runs")
    discard(places, runs)
    return at.groupBy("k1", "k2").agg(*(F.flatten(F.collect_list(x)).alias(x) for x in ("firsts", "ends", "p_firsts", "p_ends")))


def _covered(part: Slice, firsts: pa.Array, ends: pa.Array) -> np.ndarray:
    """Which bytes of the slice the runs of its documents cover."""
    (first, cuts), (end, _) = lists_of(firsts), lists_of(ends)
    base = np.repeat(part.offsets[:-1], np.diff(cuts))
    step = np.zeros(len(part.data) + 1, np.int64)
    np.add.at(step, first + base, 1)
    np.add.at(step, end + base, -1)
    return np.cumsum(step)[:-1] > 0


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, passage: int = PASSAGE, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated; and with with_text the bytes that are left.

    Every byte covered by a string of width bytes that also starts anywhere else in the table goes,
    the row's own text included, and all rows are judged on what is given. n_repeated are the bytes
    covered by strings of passage bytes (width, if that is less) that also start elsewhere: what repeats
    without being long enough to go. A null text is empty. Rows are told apart by their texts, so ids
    may be null or repeated; repeated rows repeat each other's strings and lose all of a text of width
    bytes or more. An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"k1": F.xxhash64("text"), "k2": F.hash("text")})
    found = repeated_runs(docs, width, passage)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long" + (", kept binary" if with_text else "")

    def run(batches):
        for part in slices(batches, 1):
            n = len(part)
            cut, again = (_covered(part, part.batch.column(i), part.batch.column(i + 1)) for i in (2, 4))
            removed, repeated = (np.diff(np.concatenate([[0], np.cumsum(x)])[part.offsets]) for x in (cut, again))
            begins = cut.copy()
            begins[1:] &= ~cut[:-1]
            inner = part.offsets[1:-1]
            inner = inner[inner < len(cut)]
            begins[inner] = cut[inner]  # a run ends with its document
            spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[part.offsets])
            digests, kept = [], []
            for d in range(n):
                own = part.data[part.offsets[d] : part.offsets[d + 1]]
                if removed[d]:
                    own = own[~cut[part.offsets[d] : part.offsets[d + 1]]]
                own = own.tobytes()
                digests.append(hashlib.sha256(own).hexdigest())
                kept.append(own if with_text else None)
            columns = [part.batch.column(0), pa.array(np.diff(part.offsets)), pa.array(removed), pa.array(spans), pa.array(digests, pa.string()), pa.array(repeated)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_text, [x.split()[0] for x in schema.split(", ")])

    found = found.withColumnsRenamed({"k1": "f1", "k2": "f2"})
    both = docs.join(found, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left").select("doc_id", "text", "firsts", "ends", "p_firsts", "p_ends")
    return both.mapInArrow(run, schema)
