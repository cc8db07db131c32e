"""The trie of conversations' shared beginnings, with totals of subtrees by a rollup over bands of depths.

A node is a distinct sequence of first turns, known by running hashes of its turns, so that no conversation is gathered.  Totals go up in
bands of HEIGHT depths: inside its band a node reaches all of its ancestors along the conversation that it is named by; the tops of
bands form a trie of their own, HEIGHT times less deep, which is summed in the same way; then each top's completed total goes to its
ancestors in the band above.  A depth of D takes log D rounds, and a value has HEIGHT rows at most in each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..functions.blocks import carried, dealt

#: Depths of a band.
HEIGHT = 8
#: Ids that are joined to one piece before the pieces of a node meet.
PIECE = 1 << 16
NODE = ("d", "k1", "k2")


def numbered_turns(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, p, a, b, words): each message's place in its conversation, from 1, two hashes of role and text, and the text's words.

    Turns are ordered with null first, equal ones by role, then by the SHA-256 of their text; a null role or text is empty, and
    messages without a conversation are left out.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    m = messages.select(F.col(f"`{conversation}`").cast("long").alias("c"), F.col(f"`{turn}`").cast("long").alias("t"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), body.alias("body")).where("c is not null")
    hashed = m.select(
        "c", "t", "role", F.sha2("body", 256).alias("tie"), F.xxhash64(F.lit(1), "role", "body").alias("a"), F.xxhash64(F.lit(2), "role", "body").alias("b"),
        F.regexp_count("body", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    rows = carried(dealt(hashed, ["c"], "t", "role", "tie"), ["c"], base=(F.count(F.lit(1)), F.sum("base")))
    place = F.coalesce("base", F.lit(0)) + F.row_number().over(Window.partitionBy("block", "c").orderBy("t", "role", "tie"))
    return rows.select("c", place.cast("long").alias("p"), "a", "b", "words")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(c, d, a, b, words, size) of all rebuilt conversations, d from 1, and (c, size) of each.

    Conversation c begins with the first h turns of the first conversation of its group of `group` ids, h being the unsigned crc32 of its
    decimal id modulo most + 1, or with all of them if these are fewer; what it has itself after its first h turns follows.
    """
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(most + 1))
    sizes = turns.groupBy("c").agg(F.max("p").alias("n"))
    base = (F.col("c") - F.pmod("c", F.lit(group))).alias("base")
    convs = sizes.select("c", "n", h.alias("h"), base)
    known = sizes.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = cut(convs.join(known, "base", "left").select("c", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("size")))
    # The base's turns number `most` at the most, and belong to `group` conversations.
    first = turns.where((F.pmod("c", F.lit(group)) == 0) & (F.col("p") <= most)).withColumnRenamed("c", "base")
    head = convs.join(first, "base").where("p <= h").select("c", F.col("p").alias("d"), "a", "b", "words", "size")
    own = turns.join(convs, "c").where("p > h").select("c", (F.col("taken") + F.col("p") - F.col("h")).alias("d"), "a", "b", "words", "size")
    return head.unionByName(own), convs.select("c", "size")


def paths(turns: DataFrame) -> DataFrame:
    """(c, d, k1, k2, p1, p2, words, size): the node of each beginning of each conversation, and the one above.

    k1, k2 are what the conversation's turns to d, each hashed with its depth, add up to bit by bit.
    """
    each = turns.select("c", "d", "words", "size", F.xxhash64(F.lit(1), "d", "a", "b").alias("x1"), F.xxhash64(F.lit(2), "d", "b", "a").alias("x2"))
    rows = carried(dealt(each, ["c"], "d"), ["c"], b1=(F.bit_xor("x1"), F.bit_xor("b1")), b2=(F.bit_xor("x2"), F.bit_xor("b2")))
    run = Window.partitionBy("block", "c").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({f"k{i}": F.coalesce(f"b{i}", zero).bitwiseXOR(F.bit_xor(f"x{i}").over(run)) for i in (1, 2)})
    return rows.select("c", "d", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)], "words", "size")


def rolled_up(path: DataFrame, nodes: DataFrame, values: list[str], height: int = HEIGHT) -> DataFrame:
    """(d, k1, k2, values): sums over each node's subtree.  path is (c, d, k1, k2), nodes (c, d, k1, k2, values) with the conversation
    that names each; both must be cut."""
    deepest = nodes.agg(F.max("d")).first()[0]
    band = F.floor(F.col("d") / height).alias("band")
    total = [F.sum(v).alias(v) for v in values]
    own = path.select("c", *NODE, band).join(nodes.select("c", "d", *values), ["c", "d"], "left").na.fill(0, values)
    # From below to above along the conversation, in its band: at most `height` rows.
    below = Window.partitionBy("c", "band").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = own.select(*NODE, *[F.sum(v).over(below).alias(v) for v in values]).groupBy(*NODE).agg(*total)
    if deepest is None or deepest < height:
        return inside
    inside = cut(inside)
    on_top = lambda rows: rows.where(F.col("d") % height == 0).withColumn("d", F.floor(F.col("d") / height))
    tops = on_top(nodes.select("c", *NODE))
    top_values = cut(tops.join(on_top(inside), list(NODE)))
    complete = rolled_up(cut(on_top(path.select("c", *NODE))), top_values, values, height)
    # To the ancestors in the band above: `height` rows for each top.
    up = tops.join(complete, list(NODE)).where("d > 0").select("c", (F.col("d") - 1).alias("band"), *values)
    moved = path.select("c", *NODE, band).join(up, ["c", "band"]).select(*NODE, *values)
    return inside.unionByName(moved).groupBy(*NODE).agg(*total)


def end_digests(ends: DataFrame) -> DataFrame:
    """(d, k1, k2, ends_sha256): the SHA-256 of the ids `c` of each node's `ends`, ascending and joined by commas.

    Ids are sorted by range over all tasks and joined to pieces; only pieces of one node meet, and go through its digest one by one.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, held = None, 0, []
        out = lambda: pa.RecordBatch.from_pydict({**{n: pa.array([v], pa.int64()) for n, v in zip((*NODE, "first"), (*at, first))}, "piece": pa.array([",".join(held)])})
        for batch in batches:
            for *node, c in zip(*(x.to_pylist() for x in batch.columns)):
                if node != at or len(held) >= PIECE:
                    if held:
                        yield out()
                    at, first, held = node, c, []
                held.append(str(c))
        if held:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, None
        for batch in batches:
            done = []
            for *node, piece in zip(*(x.to_pylist() for x in batch.columns)):
                if node == at:
                    running.update(b"," + piece.encode())
                    continue
                if at is not None:
                    done.append((*at, running.hexdigest()))
                at, running = node, hashlib.sha256(piece.encode())
            if done:
                yield made(done)
        if at is not None:
            yield made([(*at, running.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        *node, sha = zip(*rows)
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in node], pa.array(sha)], names=[*NODE, "ends_sha256"])

    keys = ", ".join(f"{k} long" for k in NODE)
    ordered = ends.select(*NODE, "c").repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c")
    pieces = ordered.mapInArrow(join, f"{keys}, first long, piece string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "piece").mapInArrow(digest, f"{keys}, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node of the trie.

    turns is (c, d, a, b, words, size) with d from 1 without gaps, convs (c, size) all conversations, also those without turns; both as
    rebuilt() gives them.  A node has its smallest member's id, and is known by that and its depth.  saved_tokens is what sharing
    saves: all members but one times the words of the node's last turn, summed over its subtree; n_leaves counts the subtree's nodes
    without children, ends_sha256 is of the members that have no more turns.  No conversations give an empty table.
    """
    path = cut(paths(turns))
    convs = cut(convs)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 0")
    root = root.select(*[zero.alias(k) for k in NODE], "c", "n", zero.alias("words"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    found = path.groupBy(*NODE).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = cut(root.unionByName(found))
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, list(NODE), "left").na.fill(0, ["n_children"]))
    values = nodes.select("c", *NODE, F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved_tokens"))
    roots = convs.select("c", *[zero.alias(k) for k in NODE])
    whole = cut(path.select("c", *NODE).unionByName(roots))
    sums = rolled_up(whole, cut(values), ["n_leaves", "saved_tokens"], height)
    ends = path.where("d = size").select(*NODE, "c").unionByName(convs.where("size = 0").select(*[zero.alias(k) for k in NODE], "c"))
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("c").alias("parent"))
    out = nodes.join(sums, list(NODE)).join(end_digests(ends), list(NODE), "left").join(above, ["d", "p1", "p2"], "left")
    return out.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
