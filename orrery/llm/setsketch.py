"""Near-duplicate documents by SetSketch registers.

A document is its set of five-word shingles. Register i of its sketch is a truncated logarithm of the
minimum of exponentially distributed hash values of the set: K_i = floor(1 - log_b(min_i)), kept in
0..65535. Sketches of parts merge by the larger register, and equal registers are the likelier the more
alike two sets are. Documents of equal sets are one class. Bands of registers put classes in buckets;
pairs from a bucket are estimated by the joint likelihood of their registers, given both set sizes,
and what may reach the threshold is verified on the full sets.

Pairs are not all pairs of a bucket. First each member meets the bucket's smallest one. Where several
components share a bucket after that, its members' registers are compared in one task, which gives away only a forest
of the pairs that are near enough. The trees are clusters; the texts of a cluster are brought together
once, its members are compared on their full sets by one membership array for each of them, and only
new links leave the task. A bucket or cluster too large for a task is cut into blocks, and each pair
of blocks is a task. Every link
between classes that share a bucket is so found, or lies inside a component already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, LOWER, SPACE, Slice, _bytes_of, _table, discard, doc_texts, map_slices, mix, prefix_hash, scratch, span_hash, words_of, written

ROWS, BANDS = 4, 32
REGISTERS = ROWS * BANDS
#: So near 1 that registers of unrelated sets are rarely equal (1 in 400): candidates then grow with the links, not with all pairs.
BASE = 1.01
SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles in one block of a cluster, and members in one block of a bucket.
BLOCK_SHINGLES, BLOCK_MEMBERS = 400_000, 4096
#: Sets at the threshold have as many equal registers or more: five and a half standard deviations below what is expected.
NEAR_REGISTERS = 70
#: A pair is given up if its likelihood at the threshold is so much (natural logarithm) below its best one at less: five standard deviations.
GIVEN_UP = 13.0
_MULTIPLIERS, _OFFSETS = _table(101, REGISTERS), _table(102, REGISTERS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash), sorted, of each document's distinct shingles of its lower-cased words."""
    n_docs = len(offsets) - 1
    low = LOWER[data]
    starts, ends, bounds = words_of(low, offsets, ~SPACE)
    words = span_hash(prefix_hash(BYTE_VALUES[0][low]), starts, ends)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(n_docs), n)
    prefix = prefix_hash(words)
    at = np.flatnonzero(doc[: max(0, len(words) - k + 1)] == doc[k - 1 :]) if len(words) >= k else np.empty(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    owner = np.concatenate([doc[at], short])
    hashes = np.concatenate([span_hash(prefix, at, at + k), mix(span_hash(prefix, bounds[short], bounds[short + 1]) + n[short].astype(np.uint64))])
    bits = 12  # the same for all slices, which have 4096 documents at most: equal shingles have equal hashes, of 52 bits
    key = np.sort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (hashes >> np.uint64(bits)))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return (key >> np.uint64(64 - bits)).astype(np.int64), mix(key << np.uint64(bits))


def registers(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
    """Registers of all documents (rows); a document without shingles has zeros."""
    out = np.zeros((n_docs, REGISTERS), np.uint16)
    if not len(doc):
        return out
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    for i in range(REGISTERS):
        least = np.minimum.reduceat(hashes * _MULTIPLIERS[i] + _OFFSETS[i], first)
        exponential = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64)
        out[doc[first], i] = np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, 65535)
    return out


def _log_p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def jaccard_likelihood(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, log-likelihood lost at the threshold) of pairs, from registers and set sizes together."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = REGISTERS - up - down
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = np.maximum(_log_p(np.maximum(u - v * j, 0)), 1e-12), np.maximum(_log_p(np.maximum(v - u * j, 0)), 1e-12)
        return up * np.log(p) + down * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    grid = np.linspace(0, 1, 81)[None, :] * most
    all_l = likelihood(grid)
    best = all_l.argmax(1)[:, None]
    at = np.minimum(PERCENT / 100, most)
    lost = np.take_along_axis(all_l, best, 1) - likelihood(at)
    estimate = np.take_along_axis(grid, best, 1)
    return estimate[:, 0], np.where(estimate < at, lost, 0)[:, 0]


SKETCHES = "doc_id long, n_shingles long, s1 long, s2 long, registers binary"


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One sketch for each row: set size, a 128-bit signature of the set, registers."""

    def work(part: Slice) -> dict:
        doc, hashes = shingle_sets(part.data, part.offsets)
        n = np.bincount(doc, minlength=len(part))
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
        signs = np.zeros((2, len(part)), np.uint64)
        for i in range(2):
            if len(first):
                signs[i, doc[first]] = np.add.reduceat(mix(hashes + np.uint64(i + 1)), first)
        rows = registers(doc, hashes, len(part))
        return {
            "doc_id": part.batch.column(0), "n_shingles": n.astype(np.int64), "s1": signs[0].view(np.int64), "s2": signs[1].view(np.int64),
            "registers": pa.array([r.tobytes() for r in rows], pa.binary()),
        }

    return map_slices(doc_texts(df, id_col, text_col), SKETCHES, work)


def _near_sizes(n: str, m: str):
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may reach the threshold by the joint likelihood of their registers."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_near_sizes("n_a", "n_b")).select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = [np.frombuffer(_bytes_of(batch.column(i))[0], np.uint16).reshape(-1, REGISTERS) for i in (4, 5)]
            for first in range(0, batch.num_rows, 4096):
                part = slice(first, first + 4096)
                sizes = [batch.column(i).to_numpy()[part].astype(np.float64) for i in (2, 3)]
                estimate, lost = jaccard_likelihood(matrix[0][part], matrix[1][part], *sizes)
                keep = lost <= GIVEN_UP
                yield pa.RecordBatch.from_arrays([batch.column(0)[part].filter(pa.array(keep)), batch.column(1)[part].filter(pa.array(keep)), pa.array(estimate[keep])], ["a", "b", "estimate"])

    return both.mapInArrow(run, "a long, b long, estimate double")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that are links on their full sets."""
    side = lambda x: docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"t_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                keys, sizes = [], []
                for i in (2, 3):
                    doc, hashes = shingle_sets(*_bytes_of(part.column(i)))
                    sizes.append(np.bincount(doc, minlength=part.num_rows))
                    keys.append(mix(hashes + mix(doc.astype(np.uint64))))
                owner = np.repeat(np.arange(part.num_rows), sizes[0])
                shared = np.bincount(owner[np.isin(keys[0], keys[1])], minlength=part.num_rows)
                link = (100 * shared >= PERCENT * (sizes[0] + sizes[1] - shared)) & (sizes[0] > 0)
                yield part.select([0, 1]).filter(pa.array(link))

    return both.mapInArrow(run, "a long, b long").distinct()


def _links_within(members: list[tuple], paired: bool) -> list[tuple[int, int]]:
    """Links between members of different components that share a band; enough of them to join what they join.

    members: (side, rep, component, n, registers, text) in order of side. With paired, only links
    between the sides are looked for.
    """
    sides, reps, labels, n = (np.array([m[i] for m in members], np.int64) for i in range(4))
    bands = np.frombuffer(b"".join(m[4] for m in members), np.uint64).reshape(len(members), BANDS)  # four registers of 16 bits each
    texts = [m[5] for m in members]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    owner, ids = [], []
    data = np.frombuffer(b"".join(texts), np.uint8)
    for first in range(0, len(members), 1024):
        last = min(first + 1024, len(members))
        doc, hashes = shingle_sets(data[at[first] : at[last]], at[first : last + 1] - at[first])
        owner.append(doc + first)
        ids.append(hashes)
    owner, ids = np.concatenate(owner), np.unique(np.concatenate(ids), return_inverse=True)[1]
    bounds = np.searchsorted(owner, np.arange(len(members) + 1))
    flag = np.zeros(int(ids.max()) + 1, bool)
    out = []
    for i in range(len(members) - 1):
        others = np.arange(i + 1, len(members))
        go = (labels[others] != labels[i]) & (100 * np.minimum(n[others], n[i]) >= PERCENT * np.maximum(n[others], n[i]))
        if paired:
            go &= sides[others] != sides[i]
        others = others[go]
        others = others[(bands[others] == bands[i]).any(1)] if len(others) else others
        if not len(others):
            continue
        own = ids[bounds[i] : bounds[i + 1]]
        flag[own] = True
        if len(others) < 16:
            shared = np.array([flag[ids[bounds[j] : bounds[j + 1]]].sum() for j in others])
        else:
            running = np.concatenate([[0], np.cumsum(flag[ids])])
            shared = running[bounds[others + 1]] - running[bounds[others]]
        flag[own] = False
        for j in others[100 * shared >= PERCENT * (n[others] + n[i] - shared)].tolist():
            if labels[j] != labels[i]:
                out.append((int(reps[i]), int(reps[j])))
                labels[labels == labels[j]] = labels[i]
    return out


def _dealt(rows: DataFrame, group: str, weight, most: int) -> DataFrame:
    """rows for tasks of bounded size: a group of more than `most` is cut into blocks, and each pair of blocks is a task.

    Adds task, p, q (the pair) and side (the row's own block).
    """
    blocks = rows.groupBy(group).agg(F.ceil(weight / most).cast("int").alias("blocks"))
    dealt = rows.join(blocks, group).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    p, q = F.least("side", "other"), F.greatest("side", "other")
    return dealt.withColumns({"task": F.xxhash64(group, p, q), "p": p, "q": q}).drop("other", "blocks")


def _by_task(rows: DataFrame, columns: list[str], work) -> DataFrame:
    """Pairs (a, b) from work(rows of one task, whether it is a pair of two blocks). columns: the group first."""
    ordered = rows.select("task", columns[0], "p", "q", "side", *columns[1:]).repartition("task").sortWithinPartitions("task", columns[0], "p", "q", "side", "node")

    def run(batches):
        key, held = None, []

        def flush():
            links = work(held, key[1] != key[2]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(1, batch.num_columns))):
                if row[:3] != key:
                    if key is not None:
                        yield flush()
                    key, held = row[:3], []
                held.append(row[3:])
        if key is not None:
            yield flush()

    return ordered.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _near_forest(members: list[tuple], paired: bool) -> list[tuple[int, int]]:
    """Pairs of different components whose registers are near enough, as many as join what all such pairs join.

    members: (side, rep, component, n, registers).
    """
    sides, reps, parts, n = (np.array([m[i] for m in members], np.int64) for i in range(4))
    rows = np.frombuffer(b"".join(m[4] for m in members), np.uint16).reshape(len(members), REGISTERS)
    labels, out = np.arange(len(members)), []
    for i in range(len(members) - 1):
        later = slice(i + 1, None)
        go = (labels[later] != labels[i]) & (parts[later] != parts[i]) & (100 * np.minimum(n[later], n[i]) >= PERCENT * np.maximum(n[later], n[i]))
        if paired:
            go &= sides[later] != sides[i]
        others = np.flatnonzero(go) + i + 1
        if not len(others):
            continue
        for j in others[(rows[others] == rows[i]).sum(1) >= NEAR_REGISTERS].tolist():
            if labels[j] != labels[i]:
                out.append((int(reps[i]), int(reps[j])))
                labels[labels == labels[j]] = labels[i]
    return out


def _cluster_links(open_rows: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links of open_rows (key, rep, component): between classes that share a key and no component."""
    from .components import components

    side = classes.select(F.col("rep").alias("node"), "n", "registers")
    rows = open_rows.withColumnsRenamed({"rep": "node", "component": "part"}).join(side, "node")
    forest = _by_task(_dealt(rows, "key", F.count("*"), BLOCK_MEMBERS), ["key", "node", "part", "n", "registers"], _near_forest)
    forest = written(forest, "near")
    if forest.isEmpty():
        return forest
    nodes = open_rows.select(F.col("rep").alias("node"), F.col("component").alias("part")).distinct()
    clusters = components(forest).withColumnRenamed("component", "cluster")
    rows = nodes.join(clusters, "node").join(side, "node")
    texts = docs.select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("text"))
    full = _dealt(rows, "cluster", F.sum("n"), BLOCK_SHINGLES).join(texts, "node")
    return _by_task(full, ["cluster", "node", "part", "n", "registers", "text"], _links_within)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach, the row's own included), kept (they are equal).

    Words are runs of anything but ASCII white space, lower-cased in A-Z. With fewer than five words
    the whole sequence is one shingle; without words, or with a null text, the set is empty and the
    row is linked with nothing. Rows that share an id are one document with several texts: what links
    with one of them links with the document, and all its rows have one component. A row without an id
    is linked with nothing, has no component and is kept. An empty table gives no rows.
    """
    with scratch("near-duplicates"):
        return written(_near_duplicates(doc_texts(df, id_col, text_col)), "near-duplicates")


def _near_duplicates(docs: DataFrame) -> DataFrame:
    from .components import components

    sketch = written(sketches(docs), "sketches")
    named = sketch.where("doc_id is not null")
    real = named.where("n_shingles > 0")
    classes = real.groupBy("s1", "s2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers"))
    classes = written(classes, "classes")
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))).alias("key")
    members = classes.where("n >= 3").select(band, "rep")  # smaller sets are linked only to equal ones
    heads = members.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("size")).where("size > 1")
    shared = written(members.join(heads, "key").select("key", "rep", "head"), "buckets")
    tried = written(shared.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    # an id with several sets is tied to the representative of each
    own = ["s1", "s2", "n_shingles"]
    by_set = classes.select("s1", "s2", F.col("n").alias("n_shingles"), "rep")
    several = named.select("doc_id", *own).distinct().groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select("doc_id")
    ties = real.join(several, "doc_id").join(by_set, own).select(F.greatest("doc_id", "rep").alias("a"), F.least("doc_id", "rep").alias("b"))
    links = written(_verified(_estimated(tried, classes), docs).union(ties).distinct(), "links")

    if links.isEmpty():
        part = shared.withColumn("component", F.col("rep"))
    else:
        part = shared.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = part.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    left = written(part.join(mixed, "key", "left_semi").select("key", "rep", "component"), "open")
    discard(shared)
    if not left.isEmpty():
        links = links.union(written(_cluster_links(left, classes, docs), "links"))
    found = components(links) if not links.isEmpty() else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    placed = real.select("doc_id", *own).join(by_set, own).join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    rest = named.where("n_shingles = 0").select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    nameless = sketch.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(rest).union(nameless).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that near_duplicates() keeps, with all their columns."""
    kept = near_duplicates(df, id_col, text_col).where("kept").select("doc_id").distinct()
    ids = F.col(f"`{id_col}`").cast("long")
    return df.join(kept.withColumnRenamed("doc_id", "__kept"), ids.eqNullSafe(F.col("__kept")), "left_semi")
