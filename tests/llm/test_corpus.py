"""op4, op9, op10 and the pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contactloom.llm import components, interp_lm, lsh_forest, queries, quote_threads, rule_ledger

from .conftest import SCHEMA, words
from .test_documents import base_spans, contained, measured, runs, split

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- op4


def test_replies(spark):
    rows = [
        (1, 0, "user", "Hello there\nhow are you?"), (1, 1, "assistant", "> Hello there\nFine."), (1, 2, "user", "Other topic"),
        (1, 3, "assistant", "On Monday Bob wrote:\n> how  ARE you?\n>> older\nStill fine"), (1, 4, "user", "ok"),
        (1, 5, None, "> > Hello there\n> Other topic\n> nobody said this\nlate"), (2, 0, None, None), (None, 3, "user", "x"), (None, 5, "user", "> x\ny"), (1, None, "user", "?"),
        (1, 4, "user", "ok"),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("Branch", F.lit(0))
    got = {(r.conv_id, r.turn): (r.parent_turn, r.by_quote, r.branch, r.place, r.depth, r.position, r.body) for r in quote_threads.reply_order(m).collect()}
    assert got == {
        (1, 0): (None, False, 0, 0, 0, 0, "Hello there\nhow are you?"), (1, 1): (0, True, 0, 1, 1, 1, "Fine."), (1, 2): (1, False, 0, 2, 2, 2, "Other topic"),
        (1, 3): (0, True, 3, 0, 1, 4, "Still fine"), (1, 4): (3, False, 3, 1, 2, 5, "ok"), (1, 5): (2, True, 0, 3, 3, 3, "late"), (2, 0): (None, False, 0, 0, 0, 0, ""),
        (None, 3): (None, False, 3, 0, 0, 0, "x"), (None, 5): (3, True, 3, 1, 1, 1, "y"), (1, None): (None, False, None, None, None, None, "?"),
    }
    assert quote_threads.reply_order(m).count() == len(rows)
    assert quote_threads.reply_order(m.limit(0)).count() == 0


def test_interleaved_threads_come_out_one_after_another(spark):
    texts = ["alpha one", "beta one", "> alpha one\nalpha two", "> beta one\nbeta two", "> alpha two\nalpha three", "> beta two\nbeta three"]
    m = spark.createDataFrame([(1, t, None, x) for t, x in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = [(r.turn, r.branch, r.place) for r in quote_threads.conversations(m).collect()]
    assert got == [(0, 0, 0), (2, 0, 1), (4, 0, 2), (1, 1, 0), (3, 1, 1), (5, 1, 2)]


def brute_threads(rows):
    """{(conversation, turn): (parent, by quote, branch, place, depth, position)} of (conversation, turn, text), the turns distinct: a tree that is walked."""
    marks = re.compile(r"(?:[ \t]*>)+")
    out = {}
    for c in {r[0] for r in rows}:
        said, last, links_of = [], None, {}
        for _, t, text in sorted(r for r in rows if r[0] == c):
            groups, now = [], None
            for line in text.split("\n"):
                m = marks.match(line)
                level, plain = (m[0].count(">") if m else 0), " ".join((line[m.end() :] if m else line).lower().split())
                now = None if not plain else now if now and now[0] == level else groups.append((level, [])) or groups[-1]
                if plain:
                    now[1].append(plain)
            each = {(level, p) for level, lines in groups for p in [*lines, " ".join(lines)]}
            links = [(-level, s) for level, p in each if level for s in [max((u for u, q in said if q == p), default=None)] if s is not None]
            links_of[t] = (max(links)[1] if links else last, bool(links))
            said += [(t, p) for level, p in each if not level]
            last = t
        answers = {}
        for t, (parent, quoted) in sorted(links_of.items()):
            answers.setdefault(parent, []).append((not quoted, t))
        walk = [(t, t, 0, 0) for _, t in sorted(answers.get(None, []), reverse=True)]
        position = 0
        while walk:
            t, branch, place, depth = walk.pop()
            out[c, t] = (*links_of[t], branch, place, depth, position)
            position += 1
            mine = [x for _, x in sorted(answers.get(t, []))]
            walk += [(x, branch, place + 1, depth + 1) if x == mine[0] else (x, x, 0, depth + 1) for x in reversed(mine)]
    return out


def random_threads(conversations, turns, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        texts = []
        for t in range(turns):
            parts = [words(rng, rng.randint(1, 4)) if rng.random() < 0.8 else "ok thanks" for _ in range(rng.randint(1, 4))]
            for _ in range(rng.randint(0, 2) if t else 0):
                source = rng.choice(texts).split("\n")
                lo = rng.randrange(len(source))
                piece = source[lo : lo + rng.randint(1, 3)]
                if rng.random() < 0.3:  # broken anew
                    piece = " ".join(piece).split(" ")
                mark = "> " if rng.random() < 0.7 else "> > "
                at = rng.randint(0, len(parts))
                parts[at:at] = [mark + x for x in piece] + ([""] if rng.random() < 0.5 else [])
            texts.append("\n".join(parts))
            rows.append((c, t * 3, texts[-1]))
    return rows


@pytest.mark.parametrize("partitions", [3, 40])
def test_threads_equal_brute_force(spark, partitions):
    rows = random_threads(4, 60, partitions)
    m = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.conv_id, r.turn): (r.parent_turn, r.by_quote, r.branch, r.place, r.depth, r.position) for r in quote_threads.reply_order(m).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == brute_threads(rows) and sum(x[1] for x in got.values()) > 60


def test_threads_equal_their_sql(spark, tmp_path):
    import duckdb

    rows = [(c, t, r, x) for k, (c, t, x) in enumerate(random_threads(3, 40, 8)) for r in [["user", None, "assistant"][k % 3]]]
    rows += [(None, 1, "user", "On Monday Al wrote:\n> a\nb"), (None, 2, None, "> B\nOn Monday Al wrote:\n> b"), (0, None, "user", "> ok thanks"), (7, 0, None, None), (0, 3, "user", "twice")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.execute(queries.SQL["op4_quote_threads"])
    names = [c[0] for c in want.description]
    assert sorted(map(str, queries.op4_quote_threads(spark, str(tmp_path)).select(*names).collect())) == sorted(map(str, [spark_row(names, r) for r in want.fetchall()]))


def spark_row(names, values):
    from pyspark.sql import Row

    return Row(**dict(zip(names, values)))


def test_quotes_at_deeper_levels_broken_anew_and_said_again(spark):
    rows = [
        (1, 0, "ok thanks"), (1, 1, "the quick brown fox\njumps over the dog"), (1, 2, "ok thanks"), (1, 3, "another matter"),
        (1, 4, "> > The quick brown\n> > fox jumps over the dog\nI see"), (1, 5, "> ok thanks\nwelcome"), (1, 6, "x" * 3000 + "\n> nobody said this"),
        (1, 7, "> another matter\n> > ok thanks\n\n\n"), (1, 8, ""), (1, 9, None),
    ]
    m = spark.createDataFrame([(c, t, None, x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.parent_turn, r.by_quote) for r in quote_threads.reply_order(m).collect()}
    assert got == {0: (None, False), 1: (0, False), 2: (1, False), 3: (2, False), 4: (1, True), 5: (2, True), 6: (5, False), 7: (3, True), 8: (7, False), 9: (8, False)}


def test_odd_and_very_long_messages(spark, odd_texts):
    lines = [f"line {k} {words(random.Random(k), 3)}" for k in range(4000)]
    texts = [*[t or "" for t in odd_texts], "\n".join(lines), "\n".join("> " + x for x in lines[1000:1500]) + "\nyes", "On " + "x" * 500 + " wrote:\n> " + lines[7] + "\nno", ">" * 300 + " a", "> \n>>\n"]
    rows = [(1, t, x) for t, x in enumerate(texts)]
    m = spark.createDataFrame([(c, t, None, x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    made = {r.turn: r for r in quote_threads.reply_order(m).collect()}
    n = len(odd_texts)
    # The line that introduces a quote says nothing itself, so the brute force reads the message without it.
    want = brute_threads([(c, t, x if t != n + 2 else "> " + lines[7] + "\nno") for c, t, x in rows])
    assert {(1, t): (r.parent_turn, r.by_quote, r.branch, r.place, r.depth, r.position) for t, r in made.items()} == want
    assert (made[n + 1].parent_turn, made[n + 2].parent_turn) == (n, n) and (made[n + 1].body, made[n + 2].body) == ("yes", "no")


def test_a_conversation_that_answers_one_message_and_one_that_is_a_chain(spark):
    rows = [(1, t, "first thing" if not t else f"> first thing\nanswer {t}") for t in range(120)] + [(2, t, f"> said {t - 2}\nsaid {t}") for t in range(150)]
    m = spark.createDataFrame([(c, t, None, x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r.conv_id, r.turn): (r.parent_turn, r.by_quote, r.branch, r.place, r.depth, r.position) for r in quote_threads.reply_order(m).collect()}
    assert got == brute_threads(rows)


def test_op4(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    got = {(r.conv_id, r.turn): r for r in queries.op4_quote_threads(spark, sf_dir).collect()}
    for r in rows:  # nobody quotes in these tables, so each answers the turn before
        own = got[r.conv_id, r.turn]
        before = max((x.turn for x in rows if x.conv_id == r.conv_id and x.turn < r.turn), default=None)
        assert (own.parent_turn, own.by_quote, own.place, own.body) == (before, False, r.turn, r.text.strip(" \t\n\r\x0b\x0c"))


# ---- op9


def sets_of(rows):
    return [(k, runs(split(t), 5) or ({tuple(WORD.findall(lower(t)))} if WORD.search(t or "") else set())) for k, t in rows]


def brute_classes(rows):
    """(key, class, links) of every row, all pairs compared."""
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        known = least.setdefault(top(i), k)
        least[top(i)] = k if known is None else known if k is None else min(k, known)
    return sorted(((k, least[top(i)], links[i]) for i, (k, _) in enumerate(rows)), key=str)


def test_prefix_is_as_long_as_recall_allows():
    depth = lsh_forest.prefix_depth(24, 8, 0.8, 0.9999)
    assert 1 - (1 - 0.8**depth) ** 24 >= 0.9999 > 1 - (1 - 0.8 ** (depth + 1)) ** 24


def test_prefixes_are_shortened_as_far_as_links_need():
    assert lsh_forest.needed_depth([]) == lsh_forest.needed_depth([19]) == lsh_forest.DEEPEST
    depths = [lsh_forest.needed_depth([k, 19]) for k in range(20)]
    assert depths == sorted(depths) and depths[0] == lsh_forest.prefix_depth(24, 8, 0.8, 0.9999) < depths[-1]


def test_paths_meet_as_often_as_similarity_says():
    rng = np.random.default_rng(1)
    for similar in (0.8, 0.85, 0.9):
        sets, pairs, size = [], 2000, 180
        shared = round(2 * size * similar / (1 + similar))
        for _ in range(pairs):
            every = rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64)
            sets += [np.sort(every[:size]), np.sort(every[size - shared :])]
        at = np.cumsum([0, *map(len, sets)])
        paths = lsh_forest._paths(np.concatenate(sets), at).reshape(pairs, 2, lsh_forest.TREES, 2)
        true = shared / (2 * size - shared)
        for depth in (5, 6, 8):
            low = paths[..., 1] >> np.uint64(16 * (lsh_forest.DEEPEST - depth))
            met = ((paths[:, 0, :, 0] == paths[:, 1, :, 0]) & (low[:, 0] == low[:, 1])).any(axis=1).mean()
            assert met >= 1 - (1 - true**depth) ** lsh_forest.TREES - 0.006
        # By chance not even labels of one half meet.
        assert (paths[:, 0] == np.roll(paths[:, 1], 1, axis=0)).sum() == 0


def test_rows_equal_in_key_and_text_leave_the_same_one(spark):
    rows = [(1, "one two three four five six", lang, None, n) for lang in ("en", "de", None, "fr") for n in (3, None, 1)]
    kept = {tuple(lsh_forest.keep_first(spark.createDataFrame(rows[k:] + rows[:k], SCHEMA).repartition(1 + k)).collect()) for k in range(5)}
    assert len(kept) == 1 and len(next(iter(kept))) == 1


def test_op9(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op9_ngram_jaccard(spark, sf_dir).collect()), key=str) == brute_classes(rows)


def test_near_copies_over_several_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    base = words(rng, 150).split()
    rows = []
    for k in range(60):  # a crowd of near copies, each with a few words changed, and exact copies of some
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((k, " ".join(w)))
    rows += [(100 + k, rows[k][1]) for k in range(10)] + [(200 + k, words(rng, 80)) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lsh_forest, "BLOCK", 8 * 650)
    got = lsh_forest.near_duplicates(docs).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(rows)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    docs = odd_docs.withColumn("class_id", F.lit("x"))
    got = lsh_forest.near_duplicates(docs).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(rows)
    first = lsh_forest.keep_first(docs)
    assert first.columns == docs.columns
    assert first.count() == len({c for (k, c, _), in zip(brute_classes(rows))})
    assert lsh_forest.near_duplicates(no_docs).count() == lsh_forest.keep_first(no_docs).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(300, 302), (302, 301), (301, 300), (400, 400), (None, 1), (300, 302)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {300: 300, 301: 300, 302: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_ends_in_one_task(spark):
    """However long a chain of a few edges is, there are few jobs; more edges than `few` are contracted first, with the same labels."""
    edges = [(i, i + 7) for i in range(3000)] + [(10_000 + i * 37 % 501, 10_000 + i * 91 % 777) for i in range(400)]
    table = spark.createDataFrame(edges, "a long, b long")
    spark.sparkContext.setJobGroup("components", "")
    got = {r.node: r.label for r in components.components(table).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12
    assert got == {r.node: r.label for r in components.components(table, few=50).collect()}
    assert all(got[i] == i % 7 for i in range(3007))


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 4000)).astype(np.uint64)) for _ in range(12)]
    for left, right in ((sets[:5], sets[5:]), (sets, sets)):
        got = lsh_forest.shared_counts(left, right)
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                if left is not right or i != j:
                    assert got[i, j] == len(np.intersect1d(a, b))


# ---- op10


def tokens(text):
    return [*WORD.findall(lower(text)), None]


def brute_scores(rows):
    fold = {i: zlib.crc32(str(k).encode() if k is not None else b"") % 7 for i, (k, _) in enumerate(rows)}
    own = [tokens(t) for _, t in rows]

    def counts(skip):
        u, p, n = Counter(), Counter(), 0
        for i, w in enumerate(own):
            if fold[i] not in skip:
                n += 1
                u.update(w)
                p.update(zip([0, *w[:-1]], w))
        return u, p, n

    (ur, pr, dr), (u, p, d) = counts({2, 3}), counts({2})
    total, kinds, rest = sum(u.values()), len(u), sum(ur.values())
    bucket = lambda c: 0 if c == 0 else 1 + int(math.floor(math.log2(c)))
    rounded = lambda x: 0 if x == 0 else 2 ** (round(4 * math.log2(x)) / 4)
    seen = Counter()
    for i, w in enumerate(own):
        if fold[i] == 3:
            for a, b in zip([0, *w[:-1]], w):
                c = dr if a == 0 else ur[a]
                seen[bucket(c), rounded(pr[a, b] / max(c, 1)), rounded(ur[b] / max(rest, 1))] += 1
    weights = {}
    for b in {x[0] for x in seen}:
        of = [((x[1], x[2], 1 / (len(ur) + 1)), n) for x, n in seen.items() if x[0] == b]
        now = [1 / 3] * 3
        for _ in range(interp_lm.ROUNDS):
            gained = [1.0] * 3
            for p_of, n in of:
                mixed = sum(w * q for w, q in zip(now, p_of))
                gained = [g + n * w * q / mixed for g, w, q in zip(gained, now, p_of)]
            now = [g / sum(gained) for g in gained]
        weights[b] = now
    weights = [np.array(weights[min(weights, key=lambda k: (abs(k - b), k))]) for b in range(65)] if weights else [np.full(3, 1 / 3)] * 65
    out = []
    for i, (k, _) in enumerate(rows):
        score = 0.0
        for a, b in zip([0, *own[i][:-1]], own[i]):
            c = d if a == 0 else u[a]
            score += math.log10(weights[bucket(c)] @ [p[a, b] / max(c, 1), u[b] / max(total, 1), 1 / (kinds + 1)])
        base = sum(math.log10((u[b] + 1) / (total + kinds + 1)) for b in own[i])
        out.append((k, fold[i] == 2, len(own[i]), sum(u[b] > 0 for b in own[i]), total, base, score))
    return out


def same_scores(got, want):
    order = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-6)


def test_op10(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same_scores(queries.op10_interp_lm(spark, sf_dir).collect(), brute_scores(rows))


def test_scores_in_many_chunks_and_ranges(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(interp_lm, "CHUNK_BYTES", 1 << 13)
    monkeypatch.setattr(interp_lm, "RANGE_BYTES", 1 << 14)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    same_scores(interp_lm.interpolated_scores(odd_docs.withColumn("SCORE", F.lit(0))).collect(), brute_scores(rows))
    assert interp_lm.interpolated_scores(no_docs).count() == 0


def test_scores_with_lists_cut_in_several_steps(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(interp_lm, "CHUNK_BYTES", 1 << 13)
    monkeypatch.setattr(interp_lm, "RANGE_BYTES", 1 << 10)
    monkeypatch.setattr(interp_lm, "STEP_BITS", 2)
    docs = odd_docs.unionByName(odd_docs.where("doc_id in (8, 9)")).repartition(2)
    same_scores(interp_lm.interpolated_scores(docs).collect(), brute_scores([(r.doc_id, r.text) for r in docs.collect()]))


def test_totals_beyond_32_bits():
    keys = {"word": np.array([5, 9], np.uint64), "pair": np.array([7], np.uint64)}
    big = {"word": np.array([1 << 33, 3], np.uint64), "pair": np.array([1 << 40], np.uint64)}
    none = {"word": None, "pair": None}
    lists = [interp_lm._lists(keys, big, none if k else {"word": big["word"] // np.uint64(2), "pair": big["pair"]}, 0, 0, k, k == 0, 0) for k in range(2)]
    got = interp_lm._sum_part(pa.concat_tables(lists)).to_pylist()
    assert [interp_lm._unpack(got[1]["words"], np.uint64).tolist(), interp_lm._unpack(got[1]["pairs"], np.uint64).tolist()] == [[1 << 34, 6], [1 << 41]]
    assert interp_lm._unpack(got[0]["words_rest"], np.uint64).tolist() == [(1 << 33) + (1 << 32), 4]
    assert (got[2]["unit"], got[2]["n"], got[2]["v"], got[2]["n_rest"]) == (-1, (1 << 34) + 6, 2, (1 << 33) + (1 << 32) + 4)


def test_model_beats_its_base_on_held_out(spark):
    scores = queries.op10_interp_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert scores[0] > 0.9 * scores[1] and scores[0] < 0


def test_packing_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 56, 5000).astype(np.uint64))
    assert (interp_lm._unpack_keys(interp_lm._pack_keys(keys)) == keys).all()
    assert len(interp_lm._unpack_keys(b"")) == 0


# ---- pipeline


def brute_pipeline(rows, items):
    """doc_id and masked text of what the stages keep."""

    def good(text):
        n, chars, symbols, dup, repeat = measured(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        shouts, capitals = (text or "").count("!!"), len(re.findall(r"[A-ZÀ-ÖØ-Þ]{2,}", text or ""))
        said = [x for x in (text or "").split("\n") if WORD.search(x)]
        bullets, dots = (sum(bool(re.search(p, x)) for x in said) for p in (r"^[ \t]*(?:[-*+\u2022]|[0-9]+[.)])[ \t]", r"(?:\.\.\.|\u2026)[ \t\r]*$"))
        digits = len(re.findall("[0-9]", text or ""))
        junk = 10 * bullets > 9 * lines or 10 * dots > 3 * lines or 2 * digits > chars
        return not (junk or n < 50 or 2 * repeat > n or 10 * symbols > n or 10 * shouts > n or 10 * capitals > 3 * n or 2 * dup > lines or chars < 2 * n or chars > 15 * n)

    kept = [(k, t) for k, t in rows if good(t)]
    kept = [(k, t) for k, t in kept if (k, k) in {(a, b) for a, b, _ in brute_classes(kept)}]
    leaked = {d for d, *_ in contained(kept, items)}
    return sorted((k, brute_mask(t)) for k, t in kept if k not in leaked)


def brute_mask(text):
    """By plain patterns, as far as the given documents need."""
    names = ("EMAIL", "IP", "CARD", "PHONE", "URL", "ACCOUNT", "SECRET")
    spans = [(a, names[k], b) for a, k, b in base_spans(text)]
    for m in re.finditer(r"(?i)(?:https?://|ftp://|ssh://|mailto:)([A-Za-z0-9._~%!$&*+,;=:@/?#\[\]-]+)", text):
        spans.append((m.start(), "URL", m.end() - len(m[1]) + len(m[1].rstrip(".,;:!?]"))))
    for m in re.finditer(r"(?i)(?<![^\W_])(?:token|api[_ -]?key|secret|password|passwd|bearer) {0,3}[:=] {0,3}[\"']?([A-Za-z0-9_+/=.-]{12,})", text):
        spans.append((m.start(1), "SECRET", m.end(1)))
    out, at = "", 0
    for a, name, b in sorted(spans, key=lambda s: (s[0], names.index(s[1]))):
        if a >= at:
            out += text[at:a] + f"[{name}]"
        at = max(at, b)
    return out + text[at:]


def test_pipeline(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in out) == brute_pipeline(rows, items)
    assert all(bytes(r.decoded).decode() == r.text and r.n_chars == len(r.text) for r in out)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, sf_dir, stage):
    assert stage(spark, no_docs, sf_dir).count() == 0
    out = stage(spark, odd_docs, sf_dir)
    assert out.columns[: len(odd_docs.columns)] == odd_docs.columns and out.count() > 0


def test_policies_name_rules():
    assert rule_ledger.mask("base") == 3 and SCHEMA.startswith("doc_id")
