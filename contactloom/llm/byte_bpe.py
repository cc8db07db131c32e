"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

Pre-tokens are matched by the vocabulary's pattern.  Those not met before are laid out as rows of padded matrices, one
for each range of lengths.  In each round every row merges its leftmost pair of lowest rank; pair ranks come from an
open-addressing hash table held in numpy arrays; rows without a pair left are taken out and the matrix is narrowed.
A pre-token of over LONG bytes would need as many rounds as it has bytes, so it goes by the same rule through a heap.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._batches import append_columns, binary_array, gather, text_buffers

NONE = np.int32(2**31 - 1)
LONG = 256
#: Matrix widths; a row stands in the narrowest that holds it.
WIDTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, LONG)
CELLS = 1 << 19
#: Pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 200_000
#: A vocabulary file may be this large, as every executor gets it.
LARGEST_FILE = 64 << 20


class PairTable:
    """A hash table from pairs of ids to a value, for arrays of pairs at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(len(left) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, value = self._slot(key), value.astype(np.int32)
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]  # of several for one slot the last stays
            won = self.keys[slot] == key
            self.values[slot[won]] = value[won]
            key, value, slot = key[~won], value[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pairs' values; NONE where there is none."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.values[slot], NONE)
        left_over = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        while len(left_over):
            slot[left_over] = (slot[left_over] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[left_over]]
            hit = found == key[left_over]
            out[left_over[hit]] = self.values[slot[left_over[hit]]]
            left_over = left_over[~hit & (found != -1)]
        return out


class Numbers(dict):
    """Numbers keys from 0 in the order in which they are first asked for."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value


class Codec:
    """Encoder and decoder of one rank file: lines of a base64 token and its rank, which is its id."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        pairs = [(l, r, rank) for token, rank in tokens for i in range(1, len(token)) if (l := self.ranks.get(token[:i])) is not None and (r := self.ranks.get(token[i:])) is not None]
        self.pairs = PairTable(*np.array(pairs or [(0, 0, 0)], np.int64).T)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        lengths = np.zeros(tokens[-1][1] + 1, np.int64)
        lengths[[rank for _, rank in tokens]] = [len(t) for t, _ in tokens]
        self.token_start = np.cumsum(lengths) - lengths
        self.token_length = lengths
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.find = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.seen = Numbers()
        self.flat, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and n+1 offsets."""
        if len(self.seen) > REMEMBERED:
            self._forget()
        seen, before = self.seen, len(self.seen)
        index, bounds = [], np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            pieces = self.find(text)
            index.append(np.fromiter(map(seen.__getitem__, pieces), np.int64, len(pieces)))
            bounds[k + 1] = bounds[k] + len(pieces)
        if len(seen) > before:
            fresh = list(seen)[before:]
            flat, counts = self.encode_pieces([p.encode() for p in fresh])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.flat = np.concatenate([self.flat, flat])
        piece = np.concatenate(index) if index else np.zeros(0, np.int64)
        ids, offsets = gather(self.flat, self.starts[piece], self.counts[piece])
        return ids, offsets[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all id sequences one after another, and n+1 offsets."""
        data, offsets = gather(self.token_bytes, self.token_start[ids], self.token_length[ids])
        return data, offsets[bounds]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens one after another, and how many each has."""
        out: list = [None] * len(pieces)
        rows: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = np.array([whole], np.int32)
            elif len(piece) > LONG:
                out[k] = self._merge_long(self.byte_ids[np.frombuffer(piece, np.uint8)].tolist())
            else:
                rows.setdefault(next(w for w in WIDTHS if w >= len(piece)), []).append(k)
        for width, at in rows.items():
            for i in range(0, len(at), max(1, CELLS // width)):
                block = at[i : i + max(1, CELLS // width)]
                for k, ids in zip(block, self._merge_block([pieces[k] for k in block], width), strict=True):
                    out[k] = ids
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts

    def _merge_block(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        count = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width), NONE, np.int32)
        ids[np.arange(width) < count[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        done, done_count, row = np.full((len(pieces), width), NONE, np.int32), count.copy(), np.arange(len(pieces))
        while len(row):
            best = rank.argmin(axis=1)  # the first of equal ones: the leftmost
            value = rank[np.arange(len(row)), best]
            live = value < NONE
            if not live.all():
                done[row[~live], : ids.shape[1]], done_count[row[~live]] = ids[~live], count[~live]
                width = int(count[live].max(initial=0))
                row, count, best, value = row[live], count[live], best[live], value[live]
                ids, rank = ids[live, :width], rank[live, : max(0, width - 1)]
                if not len(row):
                    break
            at, column = np.arange(len(row)), np.arange(ids.shape[1])
            ids[at, best] = value
            source = column + (column > best[:, None])
            padded = np.column_stack([ids, np.full(len(row), NONE, np.int32)])
            ids = np.take_along_axis(padded, source, axis=1)
            padded = np.column_stack([rank, np.full(len(row), NONE, np.int32)])
            rank = np.take_along_axis(padded, source[:, : rank.shape[1]], axis=1)
            count = count - 1
            first = np.flatnonzero(best > 0)
            rank[first, best[first] - 1] = self.pairs.get(ids[first, best[first] - 1], ids[first, best[first]])
            last = np.flatnonzero(best < rank.shape[1])
            rank[last, best[last]] = self.pairs.get(ids[last, best[last]], ids[last, best[last] + 1])
        return [done[k, :n] for k, n in enumerate(done_count)]

    def _merge_long(self, ids: list[int]) -> np.ndarray:
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        first = self.pairs.get(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            pair = (ids[i], ids[after[i]])
            r = known.get(pair)
            if r is None:
                r = known[pair] = int(self.pairs.get(np.array(pair[:1]), np.array(pair[1:]))[0])
            if r < NONE:
                heapq.heappush(heap, (r, i, *pair))

        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    """One codec a worker and vocabulary."""
    key = (hash(raw), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def read_vocabulary(path: str) -> bytes:
    """The bytes of a vocabulary file, of LARGEST_FILE at most, as they are sent to every executor."""
    with open(path, "rb") as f:
        raw = f.read(LARGEST_FILE + 1)
    if len(raw) > LARGEST_FILE:
        raise ValueError(f"{path} has over {LARGEST_FILE} bytes")
    return raw


def _texts(part: pa.RecordBatch, text: str) -> list[str]:
    return part.column(part.schema.get_field_index(text)).fill_null("").to_pylist()


def _pack(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return binary_array(ids.astype("<u4").view(np.uint8), bounds * 4)


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`df` with each text's token ids in column `out`, as packed little-endian unsigned 32-bit integers.

    A null text is an empty one and has no ids.  Rows keep their number and other columns; an input column named `out`
    is replaced.  An empty table gives an empty one.
    """
    raw = df.sparkSession.sparkContext.broadcast(read_vocabulary(ranks))

    def make():
        codec = _codec(raw.value, pattern)
        return lambda part: [_pack(*codec.encode(_texts(part, text)))]

    return append_columns(df, text, [T.StructField(out, T.BinaryType())], make)


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the bytes that the packed ids stand for in column `out`; null ids stand for no bytes."""
    raw = df.sparkSession.sparkContext.broadcast(read_vocabulary(ranks))
    keep = [c for c in df.columns if c.lower() != out.lower() or c == ids]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())])

    def run(batches):
        codec = _codec(raw.value, pattern)
        for batch in batches:
            packed = batch.column(batch.schema.get_field_index(ids)).fill_null(b"").to_pylist()
            bounds = np.cumsum([0, *(len(x) // 4 for x in packed)])
            data, offsets = codec.decode(np.frombuffer(b"".join(packed), "<u4").astype(np.int64), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, binary_array(data, offsets)], names=[*keep, out])

    return df.select(*[df[f"`{c}`"] for c in keep]).mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """`df` with columns `ids`, as encode() gives them, and `decoded`, as decode() gives them from these ids.

    Both in one pass over the texts.  Null and empty texts: no ids, no bytes.  Input columns of these names are replaced.
    """
    raw = df.sparkSession.sparkContext.broadcast(read_vocabulary(ranks))

    def make():
        codec = _codec(raw.value, pattern)

        def work(part):
            ids, bounds = codec.encode(_texts(part, text))
            return [_pack(ids, bounds), binary_array(*codec.decode(ids, bounds))]

        return work

    return append_columns(df, text, [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())], make)
