"""Token counts by rank-synchronous merging of ragged arrays.

All pre-tokens of a batch that were not met before stand one after another in one array of symbols.  In each round every
sequence finds its lowest pair rank and merges all its pairs of that rank, from the left and without overlap, at the
same time as all other sequences; sequences without a pair leave, and their surviving symbols are counted.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._batches import append_columns
from .byte_bpe import NONE, Numbers, PairTable, read_vocabulary

#: The pattern of byte-level tokenizers, by which their library splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Symbols that are merged together, and pre-tokens that a worker remembers before it starts afresh.
SYMBOLS, REMEMBERED = 1 << 20, 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary: itself if it prints, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Counter:
    """Counts of the tokens that a byte-level BPE vocabulary file (.json) gives a text."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        before = spec["pre_tokenizer"] or {}
        if (model["type"], before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) != ("BPE", "ByteLevel", False, True) or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE vocabularies are handled")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that depend on what surrounds them are not handled")
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        table = np.array([(vocab[a], vocab[b], k) for k, (a, b) in enumerate(merges)] or [(0, 0, 0)], np.int64)
        self.pairs = PairTable(*table.T)
        self.merged = np.array([vocab[a + b] for a, b in merges] or [0], np.int32)
        born = {vocab[a + b]: k for k, (a, b) in reversed([*enumerate(merges)])}
        #: Whether each merge ranks behind those that make its parts; only then merging all pairs of a rank at once is exact.
        self.ordered = all(born.get(vocab[a], -1) < k and born.get(vocab[b], -1) < k for k, (a, b) in enumerate(merges))
        letters = byte_letters()
        self.byte_ids = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocab[letter]
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.seen, self.counts = Numbers(), np.zeros(0, np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text; a special token's string is one token and parts the text around it."""
        if len(self.seen) > REMEMBERED:
            self._forget()
        seen, before = self.seen, len(self.seen)
        index, extra, bounds = [], np.zeros(len(texts), np.int64), np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                extra[k] = len(parts) - 1
                pieces = [p for part in parts for p in self.find(part)]
            else:
                pieces = self.find(text)
            index.append(np.fromiter(map(seen.__getitem__, pieces), np.int64, len(pieces)))
            bounds[k + 1] = bounds[k] + len(pieces)
        if len(seen) > before:
            self.counts = np.concatenate([self.counts, self.count_pieces([p.encode() for p in list(seen)[before:]])])
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.counts[np.concatenate(index)])]) if index else np.zeros(1, np.int64)
        return total[bounds[1:]] - total[bounds[:-1]] + extra

    def count_pieces(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols of each pre-token survive all merges."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < len(pieces):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SYMBOLS, side="right")))
            out[at:to] = self._merge(self.byte_ids[np.frombuffer(b"".join(pieces[at:to]), np.uint8)], size[at:to])
            at = to
        return out

    def _merge(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sequences of the given sizes one after another; a rank stands at the left symbol of each pair."""
        out, name = size.copy(), np.arange(len(size))
        starts = np.cumsum(size) - size
        rank = np.full(len(symbols), NONE, np.int32)
        rank[:-1] = self.pairs.get(symbols[:-1], symbols[1:])
        rank[starts + size - 1] = NONE
        while len(name):
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest < NONE
            if not live.all():
                out[name[~live]] = size[~live]
                kept = np.repeat(live, size)
                symbols, rank = symbols[kept], rank[kept]
                name, size, lowest = name[live], size[live], lowest[live]
                starts = np.cumsum(size) - size
                if not len(name):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            owner = np.searchsorted(starts, hit, side="right") - 1
            if self.ordered:
                fresh = np.ones(len(hit), bool)
                fresh[1:] = hit[1:] != hit[:-1] + 1
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                taken = (np.arange(len(hit)) - run) % 2 == 0  # of overlapping pairs each second one
            else:
                taken = np.ones(len(hit), bool)
                taken[1:] = owner[1:] != owner[:-1]
            hit, owner = hit[taken], owner[taken]
            symbols[hit] = self.merged[rank[hit]]
            kept = np.ones(len(symbols), bool)
            kept[hit + 1] = False
            last = np.zeros(len(symbols), bool)
            last[starts + size - 1] = True
            last[hit] |= last[hit + 1]
            symbols, rank, last = symbols[kept], rank[kept], last[kept]
            size = size - np.bincount(owner, minlength=len(size))
            starts = np.cumsum(size) - size
            now = hit - np.arange(len(hit))
            stale = np.concatenate([now, now[now > 0] - 1])
            stale = stale[~last[stale]]
            rank[stale] = self.pairs.get(symbols[stale], symbols[stale + 1])
            rank[now[last[now]]] = NONE
        return out


_counters: dict[int, Counter] = {}


def _counter(raw: bytes) -> Counter:
    if (key := hash(raw)) not in _counters:
        _counters.clear()
        _counters[key] = Counter(raw)
    return _counters[key]


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """`df` with the number of tokens of each whole text in column `out`.

    As the vocabulary's library gives them: no begin, end or other added tokens, no truncation; the string of a special
    token inside a text is that one token.  A null or empty text has none.  Rows keep their number and other columns; an
    input column named `out` is replaced; an empty table gives an empty one.
    """
    raw = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def make():
        counter = _counter(raw.value)
        return lambda part: [pa.array(counter.count(part.column(part.schema.get_field_index(text)).fill_null("").to_pylist()), pa.int64())]

    return append_columns(df, text, [T.StructField(out, T.LongType())], make)
