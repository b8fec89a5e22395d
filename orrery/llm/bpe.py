"""Byte-level BPE encoding and decoding by length-bucketed padded matrices.

Each distinct piece of a slice (a match of the split pattern) is one row of token ids, padded to its
bucket's length. In each round every row merges its leftmost pair of minimum rank; ranks come from a
hashed table of id pairs that is probed for whole matrices, and rows without a pair left are
compacted away. A piece longer than LONGEST bytes would take a round for each of its merges over a
wide row, so it is merged with a priority queue instead, which gives the same ids in n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Slice, doc_texts, map_slices

NONE = np.int64(1 << 40)  # the rank of a pair that does not merge
LONGEST = 256
CACHE_PIECES = 200_000


class PairTable:
    """Open addressing: key = left id * 2**20 + right id, value = id of the merged token (its rank)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 2 + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            slots, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.keys[slots], self.values[slots] = keys[won], values[won]
            stay = ~np.isin(left, won, assume_unique=True)
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where they do not merge or either side is padding (negative)."""
        out = np.full(left.shape, NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left.ravel()[todo].astype(np.int64) << 20) | right.ravel()[todo]
        at, flat = self._slot(keys), out.ravel()
        while len(todo):
            have = self.keys[at]
            hit = have == keys
            flat[todo[hit]] = self.values[at[hit]]
            go = ~hit & (have != -1)
            todo, keys, at = todo[go], keys[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(left.shape)


class ByteBpe:
    """A vocabulary of byte strings by rank, as in a .tiktoken file, and the pattern that splits texts."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import regex

        self.tokens: dict[int, bytes] = {}
        for line in ranks.splitlines():
            if line.strip():
                token, rank = line.split()
                self.tokens[int(rank)] = base64.b64decode(token)
        self.ids = {t: i for i, t in self.tokens.items()}
        missing = [b for b in range(256) if bytes([b]) not in self.ids]
        if missing or max(self.tokens) >= 1 << 20:
            raise ValueError("the vocabulary needs all single bytes and ids below 2**20")
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int64))
        self.find_pieces = regex.compile(pattern).findall
        self._known: dict[str, tuple[str, int, bytes]] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece, alone."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > LONGEST:
                out[i] = self._merge_long(piece)
            elif piece:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            for first in range(0, len(rows), step := max(1, (1 << 20) // width)):
                self._merge_rows(pieces, rows[first : first + step], width, out)
        return out

    def _merge_rows(self, pieces: list[bytes], rows: list[int], width: int, out: list[np.ndarray]) -> None:
        sizes = np.array([len(pieces[i]) for i in rows])
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        row, size = np.array(rows), sizes.copy()
        while len(row):
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            over = best == NONE
            for r, n, x in zip(row[over], size[over], ids[over]):
                out[r] = x[:n]
            go = ~over
            row, size, at, best = row[go], size[go] - 1, at[go], best[go]
            if not len(row):
                break
            ids, rank, each = ids[go], rank[go], np.arange(len(row))
            ids[each, at] = best
            after = np.arange(ids.shape[1]) > at[:, None]
            moved = np.concatenate([ids[:, 1:], np.full((len(row), 1), -1, np.int32)], 1)
            ids = np.where(after, moved, ids)
            ranked = np.concatenate([rank[:, 1:], np.full((len(row), 1), NONE)], 1)
            rank = np.where(after[:, : rank.shape[1]], ranked, rank)
            left = np.maximum(at - 1, 0)
            fresh = self.pairs.find(ids[each, left], ids[each, left + 1])
            rank[each[at > 0], left[at > 0]] = fresh[at > 0]
            here = np.minimum(at, rank.shape[1] - 1)
            right = np.minimum(at + 1, ids.shape[1] - 1)
            fresh = self.pairs.find(ids[each, at], np.where(at + 1 < ids.shape[1], ids[each, right], -1))
            fits = at < rank.shape[1]
            rank[each[fits], here[fits]] = fresh[fits]
            most = int(size.max())
            if most + 1 < ids.shape[1]:  # columns that no row needs any more
                ids, rank = ids[:, : most + 1], rank[:, :most]

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].astype(np.int64)
        n = len(ids)
        after, before, part = list(range(1, n + 1)), list(range(-1, n - 1)), ids.tolist()
        rank = self.pairs.find(ids[:-1], ids[1:]).tolist() + [int(NONE)]
        heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)

        def ranked(i: int) -> None:
            j = after[i]
            token = None if j >= n else self.ids.get(self.tokens[part[i]] + self.tokens[part[j]])
            rank[i] = int(NONE) if token is None else token
            if token is not None:
                heapq.heappush(heap, (token, i))

        while heap:
            r, i = heapq.heappop(heap)
            if part[i] < 0 or rank[i] != r:
                continue
            j = after[i]
            part[i], part[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            ranked(i)
            if before[i] >= 0:
                ranked(before[i])
        return np.array([x for x in part if x >= 0], np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        pieces = self.find_pieces(text)
        parts = self.encode_pieces([p.encode() for p in pieces])
        return np.concatenate(parts).tolist() if parts else []

    def piece_table(self, pieces: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """For each piece the ids as text, their number, and the bytes that the ids decode to."""
        if len(self._known) > CACHE_PIECES:
            self._known = {}
        new = [p for p in pieces if p not in self._known]
        for p, ids in zip(new, self.encode_pieces([p.encode() for p in new])):
            ids = ids.tolist()
            self._known[p] = (",".join(map(str, ids)), len(ids), self.decode(ids))
        return self._known


@lru_cache(2)
def coder(ranks: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(ranks, pattern)


def bpe_round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes whole texts and decodes the ids: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids with with_ids).

    A null or empty text has no tokens. A null id stays null, repeated rows give repeated rows, an
    empty table gives none. The rank file is read once on the driver: its size is fixed by the
    vocabulary and does not depend on the data.
    """
    with open(ranks_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def work(part: Slice) -> dict:
        bpe = coder(ranks.value, pattern)
        texts = [str(part.data[a:b].data, "utf-8", "replace") for a, b in zip(part.offsets[:-1], part.offsets[1:])]
        n, ids, back, all_ids = [], [], [], []
        for first in range(0, len(texts), 64):
            pieces = [bpe.find_pieces(t) for t in texts[first : first + 64]]
            known = bpe.piece_table(set().union(*pieces))
            for own in pieces:
                rows = [known[p] for p in own]
                n.append(sum([r[1] for r in rows]))
                joined = ",".join([r[0] for r in rows])
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([r[2] for r in rows])).hexdigest())
                if with_ids:
                    all_ids.append([int(x) for x in joined.split(",")] if joined else [])
        out = {"doc_id": part.batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
        return out | ({"ids": pa.array(all_ids, pa.list_(pa.int32()))} if with_ids else {})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return map_slices(doc_texts(df, id_col, text_col), schema, work, max_bytes=1 << 20)
