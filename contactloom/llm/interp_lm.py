"""Scores of a word bigram model by deleted interpolation.

p(w | v) = a(b) c(vw) / c(v) + b(b) c(w) / N + c(b) / (V + 1), where b is the bucket of the context's frequency c(v).  The
weights of each bucket are learned by expectation-maximisation on counts of one fold of the training documents, held out from
the counts that they weigh; the scores then use the counts of all training documents.

Counts are gathered in blocks.  Documents are dealt into chunks as they follow each other; a chunk lists its distinct words and pairs
as sorted hashes, cut into parts by the hash, so that a row of the shuffle holds many of them in a few bytes each.  Each part sums
what all chunks hold and answers each chunk with the totals in the chunk's own order; where that takes more parts than a chunk
should have rows, lists are merged and cut in several steps.  A chunk of documents and its answers are all that a task ever
holds, and both are of a size that does not depend on the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, new_folder
from ._batches import text_buffers
from ._words import find_words, hash_words, mix

#: Documents are dealt by crc32 of their key as text, modulo FOLDS: fold 2 is scored only, fold 3 sets the weights.
FOLDS, SCORED, WEIGHING = 7, 2, 3
#: Bytes of text in a chunk, and of the text whose words and pairs fall into one range of the hash.
CHUNK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
#: Bits of the hash by which lists are cut at a time.
STEP_BITS = 10
#: Bits of the hash of a word and of a pair.
WORD_BITS, PAIR_BITS = 62, 56
#: Steps of a doubling to which probabilities are rounded where weights are learned, and rounds of EM.
STEPS, ROUNDS = 4, 200
ABSENT = -(1 << 20)

_END, _BEGIN = (np.uint64(x) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
_LEFT = np.uint64(0x9FB21C651E98DF25)


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed planes of bytes, so that high bytes that are all zero take no room."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()) if len(values) else b""


def _unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


class Tokens:
    """The tokens of a chunk's documents: its words, each text's followed by an end."""

    def __init__(self, texts: pa.Array):
        data, offsets = text_buffers(texts)
        starts, ends, bounds = find_words(data, offsets)
        n = np.diff(bounds) + 1
        self.bounds = np.concatenate([[0], np.cumsum(n)])
        self.last = self.bounds[1:] - 1
        self.first = self.bounds[:-1]
        tokens = np.empty(int(n.sum()), np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[self.last] = True
        tokens[is_end], tokens[~is_end] = _END, hash_words(data, starts, ends)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.first] = _BEGIN
        self.words = tokens >> np.uint64(64 - WORD_BITS)
        self.pairs = mix(before * _LEFT + tokens) >> np.uint64(64 - PAIR_BITS)
        self.doc = np.repeat(np.arange(len(n)), n)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the chunk of each row: rows that follow each other in a partition until CHUNK_BYTES are full, those of the fold that sets
    weights in odd chunks, all others in even ones.  Repeated rows fill chunks like any others."""
    first = TaskContext.get().partitionId() << 32
    number, room = [0, 1], [CHUNK_BYTES, CHUNK_BYTES]
    for batch in batches:
        size = np.diff(text_buffers(batch.column(1))[1]).tolist()
        chunk = np.zeros(batch.num_rows, np.int64)
        for k, weighs in enumerate((batch.column(2).to_numpy() == WEIGHING).tolist()):
            if size[k] > room[weighs]:
                number[weighs], room[weighs] = number[weighs] + 2, CHUNK_BYTES
            room[weighs] -= size[k]
            chunk[k] = first + number[weighs]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk)], names=["key", "text", "fold", "chunk"])


def _one(table: pa.Table, column: str) -> pa.Array:
    return pa.concat_arrays(table[column].chunks) if table[column].num_chunks else pa.array([], table.schema.field(column).type)


def _lists(keys: dict[str, np.ndarray], counts: dict[str, np.ndarray], rests: dict[str, np.ndarray | None], skip: int, bits: int, unit: int, weighs: bool, part: int) -> pa.Table:
    """One unit's sorted words and pairs and their counts, a row for each part that holds any.

    A part is named by `part` and the `bits` bits of the hash that follow its first `skip`.  rests are the counts without the fold that
    sets weights; None stands for the same counts.
    """
    held: dict[int, dict[str, bytes]] = {}
    for name, width in (("word", WORD_BITS), ("pair", PAIR_BITS)):
        place = (keys[name] >> np.uint64(width - skip - bits)) & np.uint64((1 << bits) - 1)
        edges = [0, *(np.flatnonzero(np.diff(place)) + 1), len(place)] if len(place) else [0]
        for lo, hi in zip(edges, edges[1:]):
            row = held.setdefault(int(place[lo]), {})
            row[f"{name}s"], row[f"{name}_counts"] = _pack_keys(keys[name][lo:hi]), _pack(counts[name][lo:hi])
            row[f"{name}_rests"] = None if rests[name] is None else _pack(rests[name][lo:hi])
    columns = {f: pa.array([held[k].get(f, b"") for k in sorted(held)], pa.binary()) for f in _LISTED}
    n = len(held)
    head = {"part": pa.array([(part << bits) + k for k in sorted(held)], pa.int64()), "unit": pa.array([unit] * n, pa.int64()), "weighs": pa.array([weighs] * n, pa.bool_())}
    return pa.table(head | columns)


_LISTED = ("words", "word_counts", "word_rests", "pairs", "pair_counts", "pair_rests")
_LIST = "part long, unit long, weighs boolean, " + ", ".join(f"{c} binary" for c in _LISTED)


def _list_keys(bits: int):
    """A chunk's distinct words and pairs and how often they stand in its training documents."""

    def run(table: pa.Table) -> pa.Table:
        tokens = Tokens(_one(table, "text"))
        trains = (table["fold"].to_numpy() != SCORED)[tokens.doc]
        weighs = bool(table["fold"][0].as_py() == WEIGHING)
        keys, counts, rests = {}, {}, {}
        for name, every in (("word", tokens.words), ("pair", tokens.pairs)):
            keys[name], place = np.unique(every, return_inverse=True)
            counts[name] = np.bincount(place[trains], minlength=len(keys[name])).astype(np.uint64)
            rests[name] = np.zeros_like(counts[name]) if weighs else None
        return _lists(keys, counts, rests, 0, bits, table["chunk"][0].as_py(), weighs, 0)

    return run


def _summed(table: pa.Table, name: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct keys of all rows, each row's places among them, and their total counts, all and without the fold that sets weights."""
    keys = [_unpack_keys(x) for x in table[f"{name}s"].to_pylist()]
    counts = [_unpack(x, np.uint64) for x in table[f"{name}_counts"].to_pylist()]
    rests = [c if x is None else _unpack(x, np.uint64) for c, x in zip(counts, table[f"{name}_rests"].to_pylist(), strict=True)]
    distinct, group = np.unique(np.concatenate(keys), return_inverse=True)
    total, rest = (np.bincount(group, np.concatenate(x), len(distinct)).astype(np.uint64) for x in (counts, rests))  # exact below 2 ** 53
    return distinct, np.split(group, np.cumsum([len(k) for k in keys])[:-1]), total, rest


def _merge(skip: int, bits: int):
    """Many units' rows of one part as one unit of its own, cut by the next bits of the hash."""

    def run(table: pa.Table) -> pa.Table:
        words, _, total, rest = _summed(table, "word")
        pairs, _, pair_total, pair_rest = _summed(table, "pair")
        weighs = bool(table["weighs"].to_numpy(zero_copy_only=False).any())
        keys, counts, rests = {"word": words, "pair": pairs}, {"word": total, "pair": pair_total}, {"word": rest, "pair": pair_rest}
        return _lists(keys, counts, rests, skip, bits, table["merged"][0].as_py(), weighs, table["part"][0].as_py())

    return run


def _answered(table: pa.Table, totals: dict[str, tuple[list[np.ndarray], np.ndarray, np.ndarray]]) -> dict[str, list]:
    """Each row's totals in its own order; those without the fold that sets weights where they are asked for."""
    out: dict[str, list] = {"unit": table["unit"].to_pylist(), "part": table["part"].to_pylist()}
    weighs = table["weighs"].to_numpy(zero_copy_only=False)
    for name, (places, total, rest) in totals.items():
        out[f"{name}s"] = [_pack(total[p]) for p in places]
        out[f"{name}s_rest"] = [_pack(rest[p]) if w else b"" for p, w in zip(places, weighs, strict=True)]
    return out


def _sum_part(table: pa.Table) -> pa.Table:
    """All units' counts of one part summed; the totals in each unit's order, and a row of unit -1 with the sums of words."""
    totals = {name: _summed(table, name)[1:] for name in ("word", "pair")}
    out = _answered(table, totals)
    _, total, rest = totals["word"]
    sums = (int(total.sum()), int((total > 0).sum()), int(rest.sum()), int((rest > 0).sum()))
    tail = dict(zip(_STATS, sums, strict=True)) | {"unit": -1, "part": out["part"][0]}
    kinds = {"unit": pa.int64(), "part": pa.int64()} | {c: pa.int64() for c in _STATS}
    return pa.table({c: pa.array([*out.get(c, [0] * table.num_rows), tail.get(c, b"")], kinds.get(c, pa.binary())) for c in _ANSWERED})


def _pass_down(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """The totals that a merged unit was answered with, for each of the units that were merged."""
    totals = {}
    order = np.argsort(answers["part"].to_numpy())
    for name in ("word", "pair") if rows.num_rows else ():
        whole = lambda c: np.concatenate([_unpack(packed[k], np.uint64) for k in order]) if (packed := answers[c].to_pylist()) else np.zeros(0, np.uint64)
        places = _summed(rows, name)[1]
        total, rest = whole(f"{name}s"), whole(f"{name}s_rest")
        totals[name] = (places, total, rest if len(rest) else total)
    out = _answered(rows, totals) if rows.num_rows else {}
    kinds = {"unit": pa.int64(), "part": pa.int64()} | {c: pa.int64() for c in _STATS}
    return pa.table({c: pa.array(out.get(c, [0] * rows.num_rows), kinds.get(c, pa.binary())) for c in _ANSWERED})


_STATS = ("n", "v", "n_rest", "v_rest")
_ANSWERED = ("unit", "part", *_STATS, "words", "words_rest", "pairs", "pairs_rest")
_ANSWER = ", ".join(f"{c} long" for c in _ANSWERED[:6]) + ", " + ", ".join(f"{c} binary" for c in _ANSWERED[6:])


def _totals(lists: DataFrame, steps: list[int], units: int, skip: int = 0) -> DataFrame:
    """The totals of all units' lists, which are cut by the first of `steps` bits, and the sums in rows of unit -1.

    With one step the units' rows of a part are summed at once.  With more, the rows of as many units as there are parts are merged
    into one unit of the size that each had, which is cut by the next step, and its totals are passed down to those it was
    merged from.  So every unit has a bounded number of rows, and rows and bytes grow in proportion to the units.
    """
    if len(steps) == 1:
        return cut(lists.groupBy("part").applyInArrow(_sum_part, _ANSWER))
    lists = cut(lists)
    groups = max(1, units >> steps[0])
    skip += steps[0]
    merged = F.col("part") * groups + F.pmod(F.xxhash64("unit"), F.lit(groups))
    dealt = lists.withColumn("merged", merged)
    upper = dealt.groupBy("merged").applyInArrow(_merge(skip, steps[1]), _LIST)
    answers = _totals(upper, steps[1:], groups << steps[0], skip)
    own = answers.where("unit >= 0").withColumnRenamed("unit", "merged")
    down = dealt.groupBy("merged").cogroup(own.groupBy("merged")).applyInArrow(_pass_down, _ANSWER)
    return cut(down.unionByName(answers.where("unit = -1")))


def _counts(tokens: Tokens, answers: pa.Table, suffix: str, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token c(w), c(vw) and c(v)."""
    order = np.argsort(answers["part"].to_numpy())
    both = []
    for keys, column in ((tokens.words, f"words{suffix}"), (tokens.pairs, f"pairs{suffix}")):
        packed = answers[column].to_pylist()
        totals = np.concatenate([_unpack(packed[k], np.uint64) for k in order]).astype(np.int64)
        both.append(totals[np.unique(keys, return_inverse=True)[1]])
    context = np.empty_like(both[0])
    context[1:] = both[0][:-1]
    context[tokens.first] = n_docs
    return both[0], both[1], context


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 more than the whole part of its frequency's binary logarithm."""
    return np.where(context > 0, np.frexp(context.astype(np.float64))[1], 0)


def _round(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.rint(STEPS * np.log2(np.where(p > 0, p, 1))), ABSENT).astype(np.int64)


def _histogram(n: int, n_docs: int):
    """How often each bucket and rounded pair and word probability occurs in a chunk of the fold that sets weights."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("bucket", "pair", "word", "times")})
        word, pair, context = _counts(Tokens(_one(docs, "text")), answers, "_rest", n_docs)
        rows = np.stack([_bucket(context), _round(pair / np.maximum(context, 1)), _round(word / max(n, 1))], axis=1)
        kinds, times = np.unique(rows, axis=0, return_counts=True)
        return pa.table({"bucket": kinds[:, 0], "pair": kinds[:, 1], "word": kinds[:, 2], "times": times.astype(np.int64)})

    return run


def learn_weights(bucket: np.ndarray, pair: np.ndarray, word: np.ndarray, other: float, times: np.ndarray) -> np.ndarray:
    """Weights of pair, word and uniform probabilities for each of 65 buckets, by EM.

    A pseudo-count of one for each weight keeps all above zero.  A bucket without held-out tokens takes the weights of the
    nearest one that has some.
    """
    weights = np.full((65, 3), 1 / 3)
    p = np.stack([pair, word, np.full(len(pair), other)], axis=1)
    for _ in range(ROUNDS):
        share = weights[bucket] * p
        share *= (times / share.sum(axis=1))[:, None]
        gained = np.ones_like(weights)
        np.add.at(gained, bucket, share)
        before, weights = weights, gained / gained.sum(axis=1, keepdims=True)
        if np.abs(before - weights).max() < 1e-9:
            break
    known = np.unique(bucket)
    if len(known):
        weights = weights[[known[np.abs(known - b).argmin()] for b in range(65)]]
    return weights


def _score(n: int, v: int, n_docs: int, weights: np.ndarray):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = Tokens(_one(docs, "text"))
        if not docs.num_rows:
            word = pair = context = np.zeros(0, np.int64)
        else:
            word, pair, context = _counts(tokens, answers, "", n_docs)
        w = weights[_bucket(context)]
        p = w[:, 0] * (pair / np.maximum(context, 1)) + w[:, 1] * (word / max(n, 1)) + w[:, 2] / (v + 1)
        total = lambda x: np.add.reduceat(x, tokens.first) if len(x) else np.zeros(0, x.dtype)
        return pa.table(
            {
                "key": docs["key"],
                "held_out": pa.array(docs["fold"].to_numpy() == SCORED),
                "n_tokens": np.diff(tokens.bounds).astype(np.int64),
                "n_known": total((word > 0).astype(np.int64)),
                "train_tokens": np.full(docs.num_rows, n, np.int64),
                "base_score": total(np.log10((word + 1) / (n + (v + 1)))),
                "score": total(np.log10(p)),
            }
        )

    return run


def interpolated_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of `docs`.

    Tokens are a text's words (A-Z as a-z, parted by white space) and one end.  The model learns from the documents whose fold,
    crc32 of the key as text modulo FOLDS, is not SCORED; held_out marks the others.  train_tokens is their number of tokens N, V
    their distinct ones; n_known counts a document's tokens that are among them; base_score sums log10((c + 1) / (N + V + 1)) and
    score sums the model's log10 probabilities.

    A null or empty text is its end alone; a null key is the empty text for the fold; repeated rows each count and are each
    scored.  Without training documents N and V are zero and the uniform term alone is left.  Other columns are left out.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("fold", (F.crc32(F.coalesce(F.col("key").cast("string"), F.lit(""))) % FOLDS).cast("int"))
    path = new_folder(docs.sparkSession, "chunks")
    rows.mapInArrow(_deal, f"key {rows.schema['key'].dataType.simpleString()}, text string, fold int, chunk long").write.option("compression", "zstd").parquet(path)
    chunked = docs.sparkSession.read.parquet(path)
    weighing, scored = F.col("fold") == WEIGHING, F.col("fold") == SCORED
    number = lambda of: F.coalesce(F.sum(F.when(of, 1)), F.lit(0))
    size = F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))
    n_bytes, n_docs, n_docs_rest, chunks = chunked.agg(size, number(~scored), number(~scored & ~weighing), F.count_distinct("chunk")).first()
    bits = max(0, math.ceil(math.log2(max(1, n_bytes / RANGE_BYTES))))
    steps = [STEP_BITS] * (bits // STEP_BITS) + [bits % STEP_BITS] * (bits % STEP_BITS > 0 or bits == 0)
    lists = chunked.groupBy("chunk").applyInArrow(_list_keys(steps[0]), _LIST)
    answers = _totals(lists, steps, chunks).withColumnRenamed("unit", "chunk")
    sums = answers.where("chunk = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in _STATS])
    n, v, n_rest, v_rest = sums.first()

    def with_answers(part: DataFrame, own: DataFrame):
        return part.groupBy("chunk").cogroup(own.select("chunk", "part", "words", "words_rest", "pairs", "pairs_rest").groupBy("chunk"))

    seen = with_answers(chunked.where(weighing), answers.where("chunk >= 0 and chunk % 2 = 1")).applyInArrow(_histogram(n_rest, n_docs_rest), "bucket long, pair long, word long, times long")
    # At most 65 buckets and 4 x 64 steps of each probability, however large the corpus.
    found = np.array(seen.groupBy("bucket", "pair", "word").agg(F.sum("times")).collect(), np.int64).reshape(-1, 4)
    value = lambda x: np.where(x == ABSENT, 0.0, np.exp2(np.maximum(x, -1000) / STEPS))
    weights = learn_weights(found[:, 0], value(found[:, 1]), value(found[:, 2]), 1 / (v_rest + 1), found[:, 3])

    schema = f"key {rows.schema['key'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = with_answers(chunked, answers.where("chunk >= 0")).applyInArrow(_score(n, v, n_docs, weights), schema)
    return scores.withColumnRenamed("key", key)
