"""Removal of passages that an earlier document has: Rabin-Karp hashes of all windows of words, counted in Spark.

Documents are dealt into chunks of a few MB by a hash.  A chunk rolls one hash over all windows of its texts and names, for each
part of the hashes' range, its distinct windows with the first document that has them.  A part gathers what all chunks have of it and
answers each with a bit a window: whether an earlier document of another chunk has it.  The chunk puts the windows' bits back on its
words and merges them into maximal intervals.

A window that a third of all documents share is one entry of each chunk, not one of each document.  Chunks and parts grow in number
with the corpus and keep their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import binary_array, gather, text_buffers
from ._words import find_words, hash_words, mix

#: Bytes of text in a chunk, as long as there are no more than MOST chunks; then larger ones, up to LARGE.
CHUNK_BYTES, MOST, LARGE = 4 << 20, 1 << 14, 64 << 20
#: Rows that are equal in id and text are dealt as one from this number of them, or this share of all rows.
REPEATS, SHARE = 64, 1_000_000
#: Bytes of a window's hash that are sent; the number of its part, from a second hash, tells as many windows apart again.
SENT = 7
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BACK = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)


def rolled(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """The Rabin-Karp hash of each run of `width` words, modulo 2^64: sum of word times a power of the base, from prefix sums."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(words) - 1, _BASES[base])]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers)])
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BACK[base])]))
    return mix((sums[width:] - sums[:-width]) * back)


class Chunk:
    """The windows of some texts: `hash` and `part` of each distinct one, sorted by part, first document and hash."""

    def __init__(self, ids: pa.Array, texts: pa.Array, width: int, parts: int):
        self.data, offsets = text_buffers(texts)
        self.starts, self.ends, self.bounds = find_words(self.data, offsets)
        words = hash_words(self.data, self.starts, self.ends, fold=False)
        count = np.diff(self.bounds)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        here = np.where(known, np.maximum(count - width + 1, 0), 0)
        text = np.repeat(np.arange(len(here)), here)
        shift = np.zeros(len(here) + 1, np.int64)
        np.cumsum(here, out=shift[1:])
        #: The first word of each window.
        self.at = np.arange(shift[-1]) - shift[text] + self.bounds[text]
        self.docs, rank = np.unique(ids.fill_null(0).to_numpy(zero_copy_only=False), return_inverse=True)
        self.rank = rank[text]
        whole = rolled(words, width, 0)[self.at] >> np.uint64(64 - 8 * SENT)
        part = (rolled(mix(words + np.uint64(1)), width, 1)[self.at] % np.uint64(parts)).astype(np.int64)
        # Equal windows beside each other, the first document's first.
        order = np.lexsort((self.rank, whole, part))
        w, p = whole[order], part[order]
        new = np.ones(len(order), bool)
        new[1:] = (w[1:] != w[:-1]) | (p[1:] != p[:-1])
        first = np.flatnonzero(new)
        hashes, where, docs = w[first], p[first], self.rank[order][first]
        sent = np.lexsort((hashes, docs, where))
        self.hash, self.part, self.first = hashes[sent], where[sent], docs[sent]
        place = np.empty(len(sent), np.int64)
        place[sent] = np.arange(len(sent))
        #: The distinct window that each window is.
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = place[np.cumsum(new) - 1]

    def spread(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(part, hashes, documents, numbers of hashes of each document) for each part with windows."""
        packed = np.ascontiguousarray(self.hash.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :SENT]
        edges = np.flatnonzero(np.diff(self.part, prepend=-1, append=-1)) if len(self.part) else np.zeros(0, np.int64)
        for a, b in zip(edges[:-1], edges[1:]):
            docs, counts = np.unique(self.first[a:b], return_counts=True)
            yield int(self.part[a]), packed[a:b].tobytes(), self.docs[docs].astype("<i8").tobytes(), counts.astype("<i4").tobytes()

    def covered(self, earlier: dict[int, bytes], width: int) -> np.ndarray:
        """Which words lie in a window that an earlier document has; `earlier` are the bits of each part."""
        old = np.zeros(len(self.hash), bool)
        edges = np.searchsorted(self.part, [[p, p + 1] for p in earlier]).reshape(-1, 2)
        for (a, b), bits in zip(edges, earlier.values()):
            if (b - a + 7) // 8 != len(bits):
                raise ValueError("a chunk has changed between its two readings")
            old[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        gone = self.at[old[self.entry] | (self.rank > self.first[self.entry])]
        steps = np.zeros(len(self.starts) + width + 1, np.int64)
        np.add.at(steps, gone, 1)
        np.add.at(steps, gone + width, -1)
        return np.cumsum(steps)[: len(self.starts)] > 0


def earlier_bits(rows: list[tuple[bytes, bytes, bytes]]) -> list[bytes]:
    """For each chunk's (hashes, documents, numbers) of one part, a bit a hash: whether a smaller document of any chunk has it."""
    raw = np.frombuffer(b"".join(h for h, _, _ in rows), np.uint8).reshape(-1, SENT)
    hashes = np.zeros((len(raw), 8), np.uint8)
    hashes[:, :SENT] = raw
    hashes = hashes.view("<u8").ravel()
    docs = np.concatenate([np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(n, "<i4")) for _, d, n in rows])
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.flatnonzero(np.concatenate([np.ones(1, bool), ordered[1:] != ordered[:-1]]))
    least = np.minimum.reduceat(docs[order], new)
    old = np.empty(len(docs), bool)
    old[order] = np.repeat(least, np.diff(np.append(new, len(docs)))) < docs[order]
    ends = np.cumsum([len(h) // SENT for h, _, _ in rows])
    return [np.packbits(x).tobytes() for x in np.split(old, ends[:-1])]


def _intervals(gone: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Maximal runs of removed words of each text, counted from its first word."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[bounds] = True
    inside = np.concatenate([np.zeros(1, bool), gone, np.zeros(1, bool)])
    starts = np.flatnonzero(gone & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(gone & (~inside[2:] | edge[1:])) + 1
    text = np.searchsorted(bounds, starts, side="right") - 1
    offsets = np.searchsorted(text, np.arange(len(bounds)))
    runs = pa.StructArray.from_arrays([pa.array(starts - bounds[text], pa.int64()), pa.array(ends - bounds[text], pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)


def _kept(chunk: Chunk, gone: np.ndarray) -> pa.Array:
    """The words of each text that stay, joined by one space."""
    stay = np.flatnonzero(~gone)
    per_text = np.searchsorted(stay, chunk.bounds)
    size = chunk.ends[stay] - chunk.starts[stay] + 1
    flat, offsets = gather(np.concatenate([chunk.data, np.full(1, 0x20, np.uint8)]), chunk.starts[stay], size)
    flat[offsets[1:] - 1] = 0x20
    # The space behind the last word of a text goes.
    last = per_text[1:][per_text[1:] > per_text[:-1]]
    drop = np.ones(len(flat), bool)
    drop[offsets[last] - 1] = False
    ends = offsets[per_text] - np.concatenate([np.zeros(1, np.int64), np.cumsum(per_text[1:] > per_text[:-1])])
    return binary_array(flat[drop], ends).cast(pa.string())


def dealt(docs: DataFrame, key: str, text: str, chunk_bytes: int | None = None) -> tuple[DataFrame, int]:
    """(chunk, id, body, copies), and the number of chunks: rows by a hash of id and text, those repeated very often as one row."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("body").cast("long")), F.lit(0)).alias("size")).first()
    size = chunk_bytes or min(max(CHUNK_BYTES, total.size // MOST), LARGE)
    chunks = max(1, -(-total.size // size))
    marked = rows.withColumn("digest", F.xxhash64("id", "body"))
    # At most SHARE rows of two numbers.
    hot = marked.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(REPEATS, total.n // SHARE)).select("digest")
    hot = docs.sparkSession.createDataFrame([(r.digest,) for r in hot.toLocalIterator()], "digest long")
    once = marked.withColumn("copies", F.lit(1).cast("long"))
    if not hot.isEmpty():
        many = marked.join(F.broadcast(hot), "digest", "left_semi").groupBy("digest", "id", "body").agg(F.count(F.lit(1)).alias("copies"))
        once = once.join(F.broadcast(hot), "digest", "left_anti").select("digest", "id", "body", "copies").unionByName(many)
    return once.select(F.pmod("digest", F.lit(chunks)).alias("chunk"), "id", "body", "copies"), chunks


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 50, chunk_bytes: int | None = None) -> DataFrame:
    """(key, n_words, n_removed, removed, kept), a row for each row of `docs`.

    Words are runs of all but space, tab and line breaks; a window is `width` of them in a row, unchanged.  Each word is removed that a
    window covers whose words also stand, in a row, in a document of a smaller key; windows are those of the input.  removed has the
    maximal runs of removed words, from start to before end, kept the other words with one space between.  A null text has no
    words, a text of fewer than `width` no window; rows of equal key never take from each other, nor do rows of a null key, which
    keep all; a document's own repeats stay.  The key is an integer.  An empty table gives an empty one; other columns are left out.

    Windows are told apart by 56 bits and by the number of their part: among n windows n * n / 2^57 / parts are expected that
    are taken for another one, of 1.4e8 windows (0.9 GB) less than 0.001.
    """
    rows, parts = dealt(docs, key, text, chunk_bytes)

    def spread(table: pa.Table) -> pa.Table:
        chunk = Chunk(_one(table["id"]), _one(table["body"]), width, parts)
        found = list(chunk.spread())
        at = table["chunk"][0].as_py() if len(table) else 0
        columns = list(zip(*found)) if found else [(), (), (), ()]
        return pa.table({"part": pa.array(columns[0], pa.int64()), "chunk": pa.array([at] * len(found), pa.int64()), "hashes": pa.array(columns[1], pa.binary()), "docs": pa.array(columns[2], pa.binary()), "counts": pa.array(columns[3], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        # Windows in one chunk only need no answer: a chunk knows its own order.
        bits = earlier_bits(list(zip(*(table[c].to_pylist() for c in ("hashes", "docs", "counts")))))
        some = pa.array([k for k, b in enumerate(bits) if any(b)], pa.int64())
        return pa.table({"chunk": table["chunk"].take(some), "part": table["part"].take(some), "bits": pa.array(bits, pa.binary()).take(some)})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(_one(left["id"]), _one(left["body"]), width, parts)
        gone = chunk.covered(dict(zip(right["part"].to_pylist(), right["bits"].to_pylist())), width)
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(gone)])
        return pa.table({
            "id": left["id"], "copies": left["copies"], "n_words": pa.array(np.diff(chunk.bounds), pa.int64()), "n_removed": pa.array(np.diff(sums[chunk.bounds]), pa.int64()),
            "removed": _intervals(gone, chunk.bounds), "kept": _kept(chunk, gone),
        })

    entries = rows.groupBy("chunk").applyInArrow(spread, "part long, chunk long, hashes binary, docs binary, counts binary")
    answers = entries.groupBy("part").applyInArrow(answer, "chunk long, part long, bits binary")
    made = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, "id long, copies long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept string")
    made = made.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return made.select(F.col("id").alias(key), "n_words", "n_removed", "removed", "kept")


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) and whole.num_chunks else whole if isinstance(whole, pa.Array) else pa.array([], column.type)
