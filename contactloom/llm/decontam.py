"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item of some thirty words and a document of some thousands have a tiny Jaccard similarity, too small for MinHash.  So
items are partitioned by their number of shingles, and for each size class every document is cut into overlapping windows of
about that class's size: an item that stands in a document stands whole in one window, and is similar to that.  A window that
shares one of the item's MinHash values makes the document a candidate, whose containment is then computed from the words.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._batches import append_columns, text_buffers
from ._words import find_words, hash_shingles, hash_words, mix

SHINGLE, CONTAINED = 5, 0.8
#: MinHash values of a window or item.  An item of m shingles with 0.8 of them in one window has a similarity of 0.29 at
#: least there, and is missed with probability 0.71 ** HASHES, under 2e-5.
HASHES = 32
#: Items whose index is held at once; a larger benchmark is searched in blocks of this many, a pass over the documents each.
BLOCK_ITEMS = 20_000
#: Bytes of an item's text at most on the average of a block; beyond, blocks get smaller.
BLOCK_BYTES = 16 << 20
#: Items whose spelled-out shingles a worker keeps.
CACHED = 2048

_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType())])


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple]:
    data, offsets = text_buffers(texts)
    starts, ends, bounds = find_words(data, offsets)
    words = hash_words(data, starts, ends)
    hashes, at = hash_shingles(words, bounds, SHINGLE)
    return hashes, at, (data, starts, ends, bounds)


def _words(spelled: tuple, k: int) -> list[bytes]:
    """The words of one text, A-Z as a-z."""
    data, starts, ends, bounds = spelled
    lo, hi = bounds[k], bounds[k + 1]
    return bytes(data[starts[lo] : ends[hi - 1]]).lower().split() if hi > lo else []


def _runs(words: list[bytes], size: int) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def _item_runs(item: str) -> tuple[int, set[bytes]]:
    """The size of an item's shingles, five words or all of its fewer ones, and the shingles."""
    words = item.encode().lower().split()
    size = min(SHINGLE, len(words))
    return size, _runs(words, size)


def _classes(sizes: np.ndarray) -> dict[int, np.ndarray]:
    """Items by size class, the power of two that bounds their number of shingles, four at least."""
    top = np.array([max(4, 1 << math.ceil(math.log2(max(1, m)))) for m in sizes])
    return {int(c): np.flatnonzero((top == c) & (sizes > 0)) for c in np.unique(top)}


class Index:
    """MinHash values of a block of items by size class; items of fewer than five words by a hash of all their words."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        hashes, at, spelled = _shingles(pa.array(texts, pa.large_string()))
        n_words = np.diff(spelled[3])
        self.ids, self.texts = ids, texts
        #: Items are spelled out only where one is a candidate.
        self.runs = functools.lru_cache(CACHED)(lambda k: _item_runs(texts[k]))
        sizes = np.where(n_words >= SHINGLE, [len(set(hashes[at[k] : at[k + 1]].tolist())) for k in range(len(ids))], 0) if ids else np.zeros(0, np.int64)
        self.classes = []
        for top, items in _classes(sizes).items():
            tables = []
            for factor in _FACTORS:
                least = np.array([int(((hashes[at[k] : at[k + 1]] * factor) >> np.uint64(16)).min()) for k in items], np.uint64)
                order = np.argsort(least, kind="stable")
                seen = np.zeros(1 << 16, bool)
                seen[mix(least) >> np.uint64(48)] = True
                tables.append((least[order], items[order], seen))
            if len(items):
                self.classes.append((max(1, top // 4), tables))
        self.short = {}
        for size in range(1, SHINGLE):
            items = np.flatnonzero(n_words == size)
            if len(items):
                order = np.argsort(hashes[at[items]], kind="stable")
                self.short[size] = (hashes[at[items]][order], items[order])

    def search(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(item_id, n_shared, n_item) of each text's items, by item_id."""
        hashes, at, spelled = _shingles(texts)
        n = np.diff(at)
        pairs: list[np.ndarray] = []
        layout = []
        for stride, tables in self.classes:
            blocks = -(-n // stride)
            first = np.cumsum(blocks) - blocks
            owner = np.repeat(np.arange(len(n)), blocks)
            starts = np.repeat(at[:-1], blocks) + (np.arange(int(blocks.sum())) - np.repeat(first, blocks)) * stride
            layout.append((starts, owner, tables))
        for h, factor in enumerate(_FACTORS if len(hashes) else ()):
            values = (hashes * factor) >> np.uint64(16)
            for starts, owner, tables in layout:
                least, items, seen = tables[h]
                block = np.minimum.reduceat(values, starts)
                window = block.copy()
                for step in range(1, 5):  # a window is five blocks, fewer where its text ends
                    if step < len(block):
                        same = owner[step:] == owner[:-step]
                        window[:-step] = np.where(same, np.minimum(window[:-step], block[step:]), window[:-step])
                hit = np.flatnonzero(seen[mix(window) >> np.uint64(48)])
                lo, hi = np.searchsorted(least, window[hit], "left"), np.searchsorted(least, window[hit], "right")
                hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
                count = hi - lo
                which = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                pairs.append(np.unique(np.repeat(owner[hit], count) * len(self.ids) + items[which]))
        if self.short:
            data, starts, ends, bounds = spelled
            words = hash_words(data, starts, ends)
        for size, (keys, items) in self.short.items():
            runs, places = hash_shingles(words, bounds, size)
            lo, hi = np.searchsorted(keys, runs, "left"), np.searchsorted(keys, runs, "right")
            hit = np.flatnonzero(hi > lo)
            count = (hi - lo)[hit]
            which = np.repeat(lo[hit] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            pairs.append(np.unique(np.repeat(np.searchsorted(places, hit, "right") - 1, count) * len(self.ids) + items[which]))
        found: list[list[tuple[int, int, int]]] = [[] for _ in n]
        own: tuple[int, dict[int, set[bytes]]] = (-1, {})
        for code in np.unique(np.concatenate(pairs)) if pairs else ():
            doc, item = divmod(int(code), len(self.ids))
            if own[0] != doc:
                words_of, own = _words(spelled, doc), (doc, {})
            size, wanted = self.runs(item)
            if size not in own[1]:
                own[1][size] = _runs(words_of, size)
            shared = len(wanted & own[1][size])
            if shared >= CONTAINED * len(wanted):
                found[doc].append((self.ids[item], shared, len(wanted)))
        return [sorted(x, key=lambda leak: (leak[0] is not None, leak[0] or 0)) for x in found]


def _leaks_array(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = [x for each in found for x in each]
    parts = [pa.array([x[k] for x in flat], pa.int64()) for k in range(3)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays(parts, names=["item_id", "n_shared", "n_item"]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "leaks") -> DataFrame:
    """`docs` with the benchmark items that each text contains in column `out`: an array of (item_id, n_shared, n_item).

    An item is contained if 0.8 or more of its distinct five-word shingles (A-Z as a-z, words parted by white space) stand in
    the text.  An item of one to four words is one shingle, and contained where these words stand in a row.  Null, empty and
    blank items are in no text, and null or empty texts contain none.  Items with a null id count under null; items that are
    repeated are found as often.  Rows keep their number and other columns; an input column named `out` is replaced; an empty
    benchmark leaves empty arrays.

    A block of the benchmark, bounded in items and bytes, is what the driver and each worker hold at a time; its blocks lie on
    disk as broadcasts.  Each block is one more step of the one pass over the documents.
    """
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("body")).where(F.col("body").isNotNull())
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    free = "_leaks"
    while any(c.lower().startswith(free) for c in docs.columns):
        free = f"_{free}"
    parts = [f"{free}{k}" for k in range(blocks)]
    for k, part in enumerate(parts):
        rows = items.where(F.pmod(F.xxhash64("id", "body"), F.lit(blocks)) == k).collect()
        shared = docs.sparkSession.sparkContext.broadcast(([r.id for r in rows], [r.body for r in rows]))

        def make(shared=shared):
            index = Index(*shared.value)
            return lambda batch: [_leaks_array(index.search(batch.column(batch.schema.get_field_index(text))))]

        docs = append_columns(docs, text, [T.StructField(part, T.ArrayType(LEAK))], make)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in parts and c.lower() != out.lower()]
    return docs.select(*kept, F.array_sort(F.concat(*parts)).alias(out) if blocks > 1 else F.col(parts[0]).alias(out))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that contain no benchmark item, with their own columns."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    return find_leaks(row, benchmark, text="_text", out="_leaks").where(F.size("_leaks") == 0).select("_row.*")
