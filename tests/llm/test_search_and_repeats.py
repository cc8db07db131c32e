"""op11, op12 and op13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contactloom.llm import prefix_trie, queries, ranked_search, substring_dedup
from contactloom.llm._words import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

# ---- op11

CONV = "conv_id long, turn long, role string, text string, C string"


def trie_by_brute_force(rows, group=20):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(role, text) for _, _, role, _, text in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, own_turns in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - c % group, [])[:h] + own_turns[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for j in range(len(k) + 1):
            saved[k[:j]] += (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
            leaves[k[:j]] += k not in children
    sha = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k)).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(k, m)) for k, m in members.items()), key=repr)


def trie(df, **options):
    return sorted(map(tuple, prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.numbered_turns(df)), **options).collect()), key=repr)


def test_trie_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    want = trie_by_brute_force(map(tuple, df.collect()))
    assert trie(df) == want
    assert sorted(map(tuple, queries.op11_prefix_trie(spark, sf_dir).collect()), key=repr) == want


@pytest.mark.parametrize("height", [2, 3, 8])
def test_trie_of_odd_conversations(spark, height):
    rng = random.Random(height)
    rows = []
    for c in [-21, -3, 0, *range(1, 45, 2), 60, 61, 999]:
        for t in range(rng.randint(0, 9)):
            rows.append((c, t, rng.choice(["user", None, "bot"]), rng.choice(["", None, "a b", "a  b", "same words here"]), "x"))
    rows += [(None, 0, "user", "lost", "x"), (7, None, "user", "first", None), (7, None, "user", "early", None), (7, 0, None, None, None), (7, 0, None, None, None)]
    # A chain of 70 turns, its copy and one that leaves it half-way; a conversation whose base has only few turns.
    rows += [(200 + k, t, "user", f"turn {t}" if k != 2 or t < 35 else "else", "x") for k in range(3) for t in range(70)]
    rows += [(140, 0, "user", "only", "x"), (141, 0, "user", "a", "x"), (142, 0, "user", "b", "x"), (143, 5, "user", "c", "x")]
    assert trie(spark.createDataFrame(rows, CONV).repartition(3), height=height) == trie_by_brute_force(rows)


def test_trie_of_no_conversations(spark):
    assert trie(spark.createDataFrame([], CONV)) == []
    assert trie(spark.createDataFrame([(None, 1, "user", "x", None)], CONV)) == []


def test_trie_of_one_long_and_one_shared_conversation(spark):
    rows = [(20, t, "user", f"{t}", None) for t in range(300)] + [(100 + c, 0, "user", "hello there", None) for c in range(200)]
    assert trie(spark.createDataFrame(rows, CONV).repartition(5)) == trie_by_brute_force(rows)


def test_digests_go_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ends = spark.range(100).select(F.lit(0).cast("long").alias("d"), (F.col("id") % 3).alias("k1"), F.lit(1).cast("long").alias("k2"), (F.col("id") - 50).alias("c"))
    got = {r.k1: r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(str(c - 50) for c in range(100) if c % 3 == k).encode()).hexdigest() for k in range(3)}


# ---- op12


def best_by_brute_force(docs, items, k=50):
    terms = lambda t: TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
    bags = [(-1 << 63 if i is None else i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(x for _, b in bags for x in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 50 + (50 * sum(b.values()) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * b[x]) // (1000 * b[x] + 20 * m)) for x in set(terms(text)) if b[x])
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, None if i == -1 << 63 else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_best_of_the_tables(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = best_by_brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(tuple, queries.op12_ranked_search(spark, sf_dir).collect()), key=repr) == want
    small = ranked_search.top_documents(docs, items, segment_bytes=1 << 16, block_items=9)
    assert sorted(map(tuple, small.collect()), key=repr) == want


def test_best_of_odd_documents(spark, odd_docs, no_docs, odd_texts):
    items = [(1, "th er on"), (2, None), (3, ""), (4, odd_texts[5]), (4, odd_texts[5]), (5, "endoftext 日本語 same"), (None, "two words"), (6, "nowhere!")]
    table = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, TEXT2 int")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = best_by_brute_force(docs, sorted(set(items), key=repr), 4)
    got = ranked_search.top_documents(odd_docs, table, 4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and sorted(map(tuple, got.collect()), key=repr) == want
    assert ranked_search.top_documents(no_docs, table).count() == 0
    assert ranked_search.top_documents(odd_docs, table.where("item_id > 100")).count() == 0


def test_items_of_one_id_and_different_texts(spark, odd_docs):
    table = spark.createDataFrame([(1, "two"), (1, "words same")], "item_id long, text string")
    got = ranked_search.top_documents(odd_docs, table, 5).collect()
    assert sorted(r.rank for r in got) == list(range(1, len(got) + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=12), min_size=1, max_size=60), st.sets(st.sampled_from("abcdefgh"), min_size=1), st.integers(1, 6), st.integers(1, 9), st.sampled_from([1, 2, 8, 1000]))
def test_pruning_loses_nothing(docs, asked, k, stride, short):
    """Whatever counts as a short list and however many documents go together, the best are those of a whole scan."""
    vocabulary = np.sort(mix(np.arange(8, dtype=np.uint64)))
    number = {t: int(np.flatnonzero(vocabulary == h)[0]) for t, h in zip("abcdefgh", mix(np.arange(8, dtype=np.uint64)))}
    pairs = sorted((number[t], d, n) for d, words in enumerate(docs) for t, n in Counter(words).items())
    starts = np.searchsorted([p[0] for p in pairs], np.arange(9)) if pairs else np.zeros(9, int)
    row = {
        "ids": np.arange(len(docs))[::-1].astype("<i8").tobytes(), "lengths": np.array([len(w) for w in docs], "<i4").tobytes(), "terms": vocabulary.astype("<u8").tobytes(),
        "starts": starts.astype("<i4").tobytes(), "docs": np.array([p[1] for p in pairs], "<i4").tobytes(), "counts": np.array([p[2] for p in pairs], "<i4").tobytes(),
    }
    segment = ranked_search.Segment(row, vocabulary)
    segment.weigh(len(docs), max(1, sum(map(len, docs))))
    terms = np.array(sorted(number[t] for t in asked))
    weights = 1 + terms * 3
    best = ranked_search.Best(k)
    ranked_search.search_segment(segment, terms, weights, best, short, stride)
    scores = np.zeros(len(docs), int)
    for t, w in zip(terms, weights):
        at = slice(segment.starts[t], segment.starts[t + 1])
        scores[segment.docs[at]] += w * segment.parts[at]
    want = sorted((-s, i) for s, i in zip(scores.tolist(), segment.ids.tolist()) if s > 0)[:k]
    assert list(zip((-best.scores).tolist(), best.ids.tolist())) == want


# ---- op13


def kept_by_brute_force(rows, width=50):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - width + 1) if i is not None else ():
            run = tuple(w[k : k + width])
            first[run] = min(first.get(run, i), i)
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - width + 1) if i is not None and first[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def kept(df, **options):
    rows = substring_dedup.remove_repeats(df, **options).collect()
    for r in rows:
        assert sum(x.end - x.start for x in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))
    return sorted(((r[0], r.n_words, r.n_removed, r.kept) for r in rows), key=repr)


def test_repeats_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = kept_by_brute_force([(r.doc_id, r.text) for r in df.collect()])
    assert kept(df, chunk_bytes=1 << 16) == want
    got = queries.op13_substring_dedup(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((*x[:3], hashlib.sha256(x[3].encode()).hexdigest()) for x in want), key=repr)


@pytest.mark.parametrize("width", [1, 5, 50])
def test_repeats_of_odd_documents(spark, odd_docs, no_docs, width):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for size in (None, 1 << 12):
        assert kept(odd_docs, width=width, chunk_bytes=size) == kept_by_brute_force(rows, width)
    assert kept(no_docs) == []


def test_shared_passages_and_very_many_equal_rows(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice("abcdefghij")
    passage = [word() for _ in range(60)]
    rows = [(k, " ".join([word() for _ in range(rng.randint(0, 9))] + passage[: 50 + k % 11] + [word() for _ in range(5)]).upper() if k % 7 == 0 else " ".join(passage[k % 4 :] + [word()] * 3)) for k in range(60)]
    rows += [(4, "x " * 55)] * 70 + [(2, "x " * 60)] * 3 + [(3, None)] * 80 + [(2, "y " * 51), (2, "y " * 52)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert kept(df, chunk_bytes=2000) == kept_by_brute_force(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=2).filter(bool), max_size=40), st.integers(1, 7))
def test_rolled_hashes_tell_runs_apart(words, width):
    number = {w: k for k, w in enumerate(["a", "b", "aa", "ab", "ba", "bb"])}
    hashes = substring_dedup.rolled(mix(np.array([number[w] for w in words], np.uint64)), width, 0)
    runs = [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]
    assert len(hashes) == max(len(runs), 0)
    assert len(set(hashes.tolist())) == len(set(runs)) == len(set(zip(runs, hashes.tolist())))


def test_a_chunk_that_has_changed_is_an_error():
    chunk = substring_dedup.Chunk(pa.array([1]), pa.array(["a b c d e f g h i j k l"]), 2, 1)
    with pytest.raises(ValueError):
        chunk.covered({0: b"\0"}, 2)
