"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ensure_on_workers
from . import byte_bpe, decontam, interp_lm, license_align, lsh_forest, pii_anchors, prefix_trie, quote_threads, ranked_search, ring_shards, rule_ledger, substring_dedup, token_counts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ensure_on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes decoded from them, as digests."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_license_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each license that stands in a document, and where."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return license_align.scan_licenses(docs).select("doc_id", F.inline("licenses"))


def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on shards 0 to 7 with equal numbers of rows."""
    placed = ring_shards.assign(_read(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages with their place in the tree of replies, without quotes."""
    return quote_threads.reply_order(_read(spark, sf_dir, "conversations"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by a byte-level BPE vocabulary."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of the current policy for every document."""
    judged = rule_ledger.ledger(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", *rule_ledger.MEASURES, "fail_bits", (~rule_ledger.passes("base")).alias("base_failed"),
        rule_ledger.passes(rule_ledger.CURRENT).alias("kept"), rule_ledger.failed_alone(rule_ledger.CURRENT).alias("failed_alone"),
    )


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy, and its absence, does to the whole table."""
    return rule_ledger.ablations(rule_ledger.ledger(_read(spark, sf_dir, "documents").select("doc_id", "text")), rule_ledger.CURRENT)


def op6_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in every document."""
    found = pii_anchors.detect(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii_anchors.BASE))
    return found.select(
        "doc_id", *[count(kind) for kind in pii_anchors.KINDS], F.size("pii").cast("long").alias("n_spans"),
        F.sha2(pii_anchors.digest(base).cast("binary"), 256).alias("base_sha256"), pii_anchors.digest(F.col("pii")).alias("spans"),
    )


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that it contains."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = decontam.find_leaks(docs, _read(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.inline("leaks")).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return lsh_forest.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op10_interp_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and interpolated bigram scores of every document."""
    return interp_lm.interpolated_scores(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of rebuilt conversations, with totals of their subtrees."""
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.numbered_turns(_read(spark, sf_dir, "conversations"))))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.top_documents(docs, _read(spark, sf_dir, "benchmark"), 50)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of words that every document has and loses, and a digest of those that stay."""
    done = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_license_align, op3_ring_shards, op4_quote_threads, op5_token_counts,
        op6_pii_anchors, op7_decontam, op8_rule_ledger, rule_ablations, op9_ngram_jaccard, op10_interp_lm,
        op11_prefix_trie, op12_ranked_search, op13_substring_dedup,
    )
}

#: DuckDB SQL of op8, with the strings of windows where the operator compares hashes.
_LEDGER = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
m AS (
  SELECT doc_id, body, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
w AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM m)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM w) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM d, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
n AS (
  SELECT m.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(body, '!!'))::BIGINT AS n_shouts, len(regexp_extract_all(body, '\p{Lu}{2,}'))::BIGINT AS n_capital_runs,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*(?:[-*+•]|[0-9]+[.)])[\x20\x09]')))::BIGINT AS n_bullets,
         len(list_filter(lines, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09\x0D]*$')))::BIGINT AS n_ellipses,
         len(regexp_extract_all(body, '[0-9]'))::BIGINT AS n_digits,
         len(list_intersect(words, [STOP]))::BIGINT AS n_stop_words
  FROM m LEFT JOIN r ON m.doc_id = r.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_shouts > n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_capital_runs > 3 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 64 ELSE 0 END
    + CASE WHEN 10 * n_bullets > 9 * n_lines THEN 128 ELSE 0 END + CASE WHEN 10 * n_ellipses > 3 * n_lines THEN 256 ELSE 0 END
    + CASE WHEN 2 * n_digits > word_chars THEN 512 ELSE 0 END + CASE WHEN n_stop_words < 2 THEN 1024 ELSE 0 END)::BIGINT AS fail_bits
  FROM n)
""".replace("STOP", ", ".join(f"'{w}'" for w in rule_ledger.STOP_WORDS))

_OP8 = _LEDGER + """
SELECT *, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 1023) = 0 AS kept,
       CASE WHEN bit_count(fail_bits & 1023) = 1 THEN fail_bits & 1023 ELSE 0 END AS failed_alone
FROM b
"""

_ABLATIONS = _LEDGER + f"""
SELECT unnest([{", ".join(f"'{r}'" for r in rule_ledger.POLICIES["v2"])}]) AS rule,
       unnest([{", ".join(f"count(*) FILTER ((fail_bits & {1 << k}) <> 0)" for k in range(10))}]) AS n_failed,
       unnest([{", ".join(f"count(*) FILTER ((fail_bits & 1023) = {1 << k})" for k in range(10))}]) AS n_failed_alone,
       unnest([{", ".join(["count(*) FILTER ((fail_bits & 1023) = 0)"] * 10)}]) AS n_kept, unnest([{", ".join(["count(*)"] * 10)}]) AS n_rows
FROM b
"""

#: DuckDB SQL of op4, with passages where the operator joins their hashes.
_OP4 = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id AS c, turn AS t, coalesce(role, 'user') AS role, coalesce(text, '') AS x FROM conversations),
l AS (SELECT r, c, t, generate_subscripts(string_split(x, chr(10)), 1) AS i, unnest(string_split(x, chr(10))) AS line FROM m),
k AS (SELECT *, length(regexp_replace(regexp_extract(line, 'MARKS'), '[^>]', '', 'g')) AS level, regexp_matches(line, 'SAID') AS tells FROM l),
n0 AS (SELECT *, tells AND coalesce(lead(level) OVER (PARTITION BY r ORDER BY i) > 0, false) AS intro FROM k),
n AS (SELECT *, CASE WHEN intro THEN '' ELSE trim(regexp_replace(lower(regexp_replace(line, 'MARKS', '')), '[\x20\x09-\x0D\x01\x02]+', ' ', 'g')) END AS said FROM n0),
g0 AS (SELECT *, CASE WHEN lag(level) OVER w = level AND lag(said) OVER w <> '' THEN 0 ELSE 1 END AS fresh FROM n WINDOW w AS (PARTITION BY r ORDER BY i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS grp FROM g0),
p AS (SELECT c, t, level, said FROM n WHERE said <> '' UNION SELECT c, t, level, string_agg(said, ' ' ORDER BY i) FROM g WHERE said <> '' GROUP BY r, c, t, grp, level),
q AS (SELECT c, t, said, min(level) AS level FROM p WHERE level > 0 GROUP BY ALL),
s AS (SELECT q.c, q.t, q.level, max(p.t) AS source FROM q JOIN p ON p.c IS NOT DISTINCT FROM q.c AND p.said = q.said AND p.level = 0 AND p.t < q.t GROUP BY q.c, q.t, q.said, q.level),
a AS (SELECT c, t, arg_min(source, level * 1000000000 - source) AS source FROM s GROUP BY c, t),
d AS (SELECT DISTINCT c, t FROM m),
e AS (SELECT d.c, d.t, source IS NOT NULL AS by_quote, coalesce(source, lag(d.t) OVER (PARTITION BY d.c ORDER BY d.t NULLS FIRST)) AS parent
      FROM d LEFT JOIN a ON a.c IS NOT DISTINCT FROM d.c AND a.t = d.t),
f AS (SELECT *, parent IS NOT NULL AND row_number() OVER (PARTITION BY c, parent ORDER BY NOT by_quote, t) = 1 AS first FROM e WHERE t IS NOT NULL),
y AS (SELECT c, t, [struct_pack(weak := NOT by_quote, t := t)] AS path, t AS branch, 0::BIGINT AS place, 0::BIGINT AS depth FROM f WHERE parent IS NULL
      UNION ALL
      SELECT f.c, f.t, list_append(path, struct_pack(weak := NOT by_quote, t := f.t)), CASE WHEN first THEN branch ELSE f.t END, CASE WHEN first THEN place + 1 ELSE 0 END, depth + 1
      FROM y JOIN f ON f.c IS NOT DISTINCT FROM y.c AND f.parent = y.t),
z AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY path) - 1 AS position FROM y),
h AS (SELECT e.*, branch, place, depth, position FROM e LEFT JOIN z ON z.c IS NOT DISTINCT FROM e.c AND z.t = e.t),
o AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS body FROM n WHERE level = 0 AND NOT intro GROUP BY r),
b AS (SELECT m.c, m.t, m.role, regexp_replace(coalesce(body, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body FROM m LEFT JOIN o ON m.r = o.r)
SELECT b.c AS conv_id, b.t AS turn, b.role, h.parent AS parent_turn, h.by_quote, h.branch, h.place, h.depth, h.position, b.body,
       '<|' || b.role || '|>' || chr(10) || b.body || chr(10) || '<|end|>' || chr(10) AS formatted
FROM b JOIN h ON b.c IS NOT DISTINCT FROM h.c AND b.t IS NOT DISTINCT FROM h.t
""".replace("MARKS", quote_threads._MARKS).replace("SAID", quote_threads._SAID)

#: DuckDB SQL of op11, on whole sequences of turns where the operator has hashes; crc32 is spelled out bit by bit.
_OP11 = r"""
WITH o AS (SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS m,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT c, list(m ORDER BY p) AS l FROM o GROUP BY c),
h AS (SELECT c, l, xor(list_reduce(list_prepend(4294967295::BIGINT,
        flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: list_prepend(ascii(x)::BIGINT, [256, 256, 256, 256, 256, 256, 256, 256])))),
        lambda x, e: CASE WHEN e < 256 THEN xor(x, e) ELSE xor(x >> 1, (x & 1) * 3988292384) END), 4294967295) % 4 AS h FROM g),
r AS (SELECT h.c, coalesce(list_slice(b.l, 1, h.h), []) || coalesce(list_slice(h.l, h.h + 1, len(h.l)), []) AS l FROM h LEFT JOIN g AS b ON b.c = h.c - ((h.c % 20) + 20) % 20),
e AS (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM r),
n AS (SELECT d, list_slice(l, 1, d) AS k, min(c) AS c, count(*) AS n, string_agg(CASE WHEN d = len(l) THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM e GROUP BY ALL),
f AS (SELECT d - 1 AS d, list_slice(k, 1, d - 1) AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(kids, 0) AS kids,
             CASE WHEN n.d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(n.k[n.d].text, '[^\x20\x09-\x0D]+')) END AS saved
      FROM n LEFT JOIN f ON n.d = f.d AND n.k = f.k),
u AS (SELECT list_slice(k, 1, j) AS k, j AS d, sum(saved) AS saved, count(*) FILTER (kids = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM v) GROUP BY ALL)
SELECT v.c AS conv_id, v.d AS depth, a.c AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, u.leaves AS n_leaves,
       u.saved::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN u ON u.d = v.d AND u.k = v.k LEFT JOIN n AS a ON a.d = v.d - 1 AND a.k = list_slice(v.k, 1, v.d - 1)
"""

#: DuckDB SQL of op12, on terms where the operator has hashes.
_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), 'TERM') AS terms FROM documents),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM d),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), 'TERM'))) AS term FROM benchmark),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
x AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * s.n) // s.l))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM x WHERE score > 0) WHERE rank <= 50
""".replace("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").replace("LOWER", "abcdefghijklmnopqrstuvwxyz").replace("TERM", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: DuckDB SQL of op13, on the words of windows where the operator has hashes.
_OP13 = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT r, doc_id, i, array_to_string(list_slice(words, i, i + 49), ' ') AS k FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM t)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
g AS (SELECT r, unnest(range(i, i + 50)) AS i FROM w JOIN f USING (k) WHERE first < doc_id),
x AS (SELECT DISTINCT r, i FROM g),
y AS (SELECT r, i, word FROM (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t)),
z AS (SELECT y.r, count(x.i) AS n_removed, string_agg(CASE WHEN x.i IS NULL THEN word END, ' ' ORDER BY y.i) AS kept FROM y LEFT JOIN x ON x.r = y.r AND x.i = y.i GROUP BY y.r)
SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN z USING (r)
"""

SQL: dict[str, str] = {"op11_prefix_trie": _OP11, "op12_ranked_search": _OP12, "op13_substring_dedup": _OP13, "op4_quote_threads": _OP4, "op8_rule_ledger": _OP8, "rule_ablations": _ABLATIONS}
