"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time scoring.

The texts are read once, into segments of an inverted index in the shared folder.  In each segment an item's short lists are summed term
by term into accumulators; these are then one more iterator, whose bound is the largest sum, beside the item's long lists.  Iterators are
walked together, a window of documents at a time: those whose bounds together stay below the least score of the best found so far bring no
candidates, and are only looked up for candidates that can still pass it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, new_folder, remove
from ._batches import slices, text_buffers
from ._words import PUNCTUATION, find_words, hash_words

#: Bytes of text in a segment of the index.
SEGMENT_BYTES = 4 << 20
#: Items, and bytes of their text, that are searched in one pass over the index; the driver holds no more of them at a time.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: A list is short if it has one in SHORT of the segment's documents at most.
SHORT = 8
#: Documents between two looks at the least score that still counts.
STRIDE = 512
_INDEX = "n_docs long, n_terms long, ids binary, lengths binary, terms binary, starts binary, docs binary, counts binary"
_NO_ID = np.iinfo(np.int64).min


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each term, and n+1 offsets: which terms are each text's."""
    data, offsets = text_buffers(texts)
    starts, ends, bounds = find_words(data, offsets, PUNCTUATION)
    return hash_words(data, starts, ends), bounds


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """A row for each segment: its documents' keys and numbers of terms, its terms in order, and each term's documents and occurrences."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", segment_bytes):
                terms, bounds = terms_of(part.column("body"))
                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                order = np.lexsort((doc, terms))
                t, d = terms[order], doc[order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
                at = np.flatnonzero(new)
                counts, t, d = np.diff(np.append(at, len(new))), t[at], d[at]
                lists = np.flatnonzero(np.concatenate([np.ones(min(len(t), 1), bool), t[1:] != t[:-1]]))
                lengths = np.diff(bounds)
                arrays = [part.column("id").fill_null(_NO_ID).to_numpy().astype("<i8"), lengths.astype("<i4"), t[lists].astype("<u8"), np.append(lists, len(t)).astype("<i4"), d.astype("<i4"), counts.astype("<i4")]
                numbers = [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
                yield pa.RecordBatch.from_arrays([*numbers, *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=[f.split()[0] for f in _INDEX.split(", ")])

    return rows.mapInArrow(index, _INDEX)


class Segment:
    """What a row of the index has for some terms: of term k documents docs[starts[k]:starts[k + 1]] and the parts of their scores."""

    def __init__(self, row: dict, vocabulary: np.ndarray):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, lengths = read("ids", "<i8"), read("lengths", "<i4").astype(np.int64)
        terms, starts = read("terms", "<u8"), read("starts", "<i4")
        at = np.searchsorted(terms, vocabulary)
        found = np.zeros(len(vocabulary), bool)
        if len(terms):
            found = terms[np.minimum(at, len(terms) - 1)] == vocabulary
        at = np.where(found, at, 0)
        self.df = np.where(found, starts[at + 1] - starts[at], 0).astype(np.int64) if len(terms) else np.zeros(len(vocabulary), np.int64)
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.df)])
        place = np.repeat((starts[at] if len(terms) else at) - self.starts[:-1], self.df) + np.arange(self.starts[-1])
        self.docs, self.tf = read("docs", "<i4")[place], read("counts", "<i4")[place].astype(np.int64)
        self.lengths = lengths

    def weigh(self, n_docs: int, n_terms: int) -> None:
        """parts: (10^9 tf) div (1000 tf + 20 m) of each document of each list; most: the largest of each list."""
        m = 50 + (50 * self.lengths * n_docs) // max(n_terms, 1)
        self.parts = (1_000_000_000 * self.tf) // (1000 * self.tf + 20 * m[self.docs])
        self.most = np.zeros(len(self.df), np.int64)
        some = np.flatnonzero(self.df)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.parts, self.starts[some])


class Best:
    """The k best of one item, by score, then by key."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score below which nothing enters."""
        return max(1, int(self.scores[-1])) if len(self.scores) >= self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids = s[order], i[order]


def search_segment(segment: Segment, terms: np.ndarray, weights: np.ndarray, best: Best, short: int = SHORT, stride: int = STRIDE) -> None:
    """Offers `best` every document of the segment that can enter it; terms are places in the segment's vocabulary."""
    here = segment.df[terms] > 0
    terms, weights = terms[here], weights[here]
    if not len(terms):
        return
    span = lambda t: slice(segment.starts[t], segment.starts[t + 1])
    brief = segment.df[terms] * short <= len(segment.ids)
    # Term at a time: the short lists become one list of sums.
    lists: list[tuple[int, np.ndarray, np.ndarray]] = []
    if brief.any():
        sums = np.zeros(len(segment.ids), np.int64)
        for t, w in zip(terms[brief], weights[brief]):
            sums[segment.docs[span(t)]] += w * segment.parts[span(t)]
        docs = np.flatnonzero(sums)
        if len(docs):
            lists.append((int(sums.max()), docs, sums[docs]))
    for t, w in zip(terms[~brief], weights[~brief]):
        lists.append((int(w * segment.most[t]), segment.docs[span(t)], w * segment.parts[span(t)]))
    # Document at a time, lists by their bounds; bounds[k] is what the first k lists can add together.
    lists.sort(key=lambda x: x[0])
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum([b for b, _, _ in lists])])
    at = 0
    while at < len(segment.ids):
        passed = int(np.searchsorted(bounds, best.least, side="left")) - 1  # lists that even together stay below the least score
        if passed >= len(lists):
            return
        sums = np.zeros(min(stride, len(segment.ids) - at), np.int64)
        for _, docs, parts in lists[passed:]:
            a, b = np.searchsorted(docs, (at, at + stride))
            sums[docs[a:b] - at] += parts[a:b]
        live = np.flatnonzero(sums)
        scores = sums[live]
        for k in range(passed - 1, -1, -1):
            fit = scores + bounds[k + 1] >= best.least
            live, scores = live[fit], scores[fit]
            if not len(live):
                break
            _, docs, parts = lists[k]
            there = np.minimum(np.searchsorted(docs, live + at), len(docs) - 1)
            scores = scores + np.where(docs[there] == live + at, parts[there], 0)
        fit = scores >= best.least
        if fit.any():
            best.offer(scores[fit], segment.ids[live[fit] + at])
        at += stride


def top_documents(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", segment_bytes: int = SEGMENT_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item, rank, key, score): the k documents of the highest score above 0 for each item, equal ones by ascending key; ranks are unique.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z as a-z, told apart by 64-bit hashes.  With N documents that have terms, L
    terms in them all, n in one, df documents with a term and tf times it occurs, a term weighs floor(1000 ln((2N + 2) / (2df + 1))),
    and adds that times (10^9 tf) div (1000 tf + 20 m), m = 50 + (50 n N) div L, for each of the item's terms once.

    A null text has no terms.  Each row of `docs` is a document of its own, also where rows are equal; a null key comes before all others
    and is returned as null.  Items equal in id and text are one; items of one id and different texts are ranked each for
    itself.  Items or documents without terms give no rows, empty tables an empty one; other columns are left out.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "index")
    build_index(docs, key, text, segment_bytes).write.parquet(folder)
    index = spark.read.parquet(folder)
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    wanted = cut(items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("body")).where("body is not null").distinct())
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("body").cast("long")), F.lit(0)).alias("bytes")).first()
    # Blocks are dealt by a hash, so that half as many again may fall into one.
    blocks = max(1, -(-2 * size.n // block_items), -(-2 * size.bytes // BLOCK_BYTES)) if size.n > block_items or size.bytes > BLOCK_BYTES else 1
    kind = dict(wanted.dtypes)["item"]
    found = None
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b).collect()
        hits = _search(index, [r.body for r in rows], totals.docs, totals.terms, k)
        names = F.broadcast(spark.createDataFrame([(n, r.item) for n, r in enumerate(rows)], f"item int, name {kind}"))
        named = hits.join(names, "item").withColumn("block", F.lit(b))
        found = named if found is None else found.unionByName(named)
    order = [F.col("score").desc(), F.col("id").asc_nulls_first()]
    by = ["block", "item"]
    # The best of some tasks each, then of all: no task gets more than that of an item.
    some = found.withColumn("place", F.row_number().over(Window.partitionBy(*by, "group").orderBy(*order))).where(F.col("place") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    named_rank = F.row_number().over(Window.partitionBy("item").orderBy("rank", "part"))
    out = ranked.select(F.col("name").alias("item"), F.xxhash64("block", F.col("item")).alias("part"), "rank", "id", "score")
    done = cut(out.select(F.col("item").alias(item), named_rank.cast("int").alias("rank"), F.col("id").alias(key), "score"))
    remove(spark, folder)
    return done


def _search(index: DataFrame, texts: list[str], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(group, item, id, score): of each task over the index the k best of each of the items `texts`, a block of them."""
    hashes, bounds = terms_of(pa.array(texts, pa.large_string()))
    each = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    vocabulary = np.unique(hashes)
    places = [np.searchsorted(vocabulary, x) for x in each]
    context = index.sparkSession.sparkContext
    sent = context.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                total += Segment(row, sent.value).df
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    df = np.zeros(len(vocabulary), np.int64)
    for r in index.mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the vocabulary at most
        df[r.term] = r.df
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    questions = context.broadcast([(p, weights[p]) for p in places])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in questions.value]
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, sent.value)
                segment.weigh(n_docs, n_terms)
                for (terms, weights), b in zip(questions.value, best):
                    search_segment(segment, terms, weights, b)
        ids = np.concatenate([b.ids for b in best]) if best else np.zeros(0, np.int64)
        scores = np.concatenate([b.scores for b in best]) if best else np.zeros(0, np.int64)
        items = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(scores, pa.int64())], names=["item", "id", "score"])

    hits = index.select("ids", "lengths", "terms", "starts", "docs", "counts").mapInArrow(search, "item int, id long, score long")
    return hits.withColumn("group", F.floor(F.spark_partition_id() / 64))
