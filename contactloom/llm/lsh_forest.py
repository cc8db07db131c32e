"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Each distinct shingle set has a path in each of TREES prefix tries: DEEPEST labels of two bytes, each from a MinHash value of its own.
A path is two 64-bit integers, its first label highest, so that the order of paths is the order of a trie and a prefix is a shift.  The
shortest prefix that can be needed has 80 bits, so that by chance alone no set meets another even among 10^12.  Sets whose paths share a
prefix are candidates.  Matching starts at whole paths; what the exact verification finds at that depth
tells how far prefixes must be shortened: until pairs of every similarity at which links were found meet in some trie with the
target probability.  Only neighbourhoods that grew by it are verified again.

Sets that meet, directly or through others, make up a neighbourhood, in which Jaccard similarities are computed exactly, a block of
sets against a block.  Only counts of links and spanning stars leave a block, never its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from ._batches import append_columns, text_buffers
from ._skew import look_up
from ._words import find_words, hash_shingles, hash_words
from .components import components

SHINGLE, SIMILAR = 5, 0.8
TREES, DEEPEST, RECALL = 24, 8, 0.9999
#: Labels in one half of a path.
LABELS = 4
#: Shingles of a block, each set counting SET_WEIGHT more; a neighbourhood of more is verified block against block.
BLOCK, SET_WEIGHT = 1 << 22, 500
#: Parts in which the members of a trie node or of a large neighbourhood meet what is known of it.
SALTS = 64
#: Sets of a block that are compared at a time, and shingles that their matrices have as columns.
ROWS, COLUMNS = 512, 4096
#: Ranges of similarity, from SIMILAR to 1, in which links are counted.
RANGES = 20


def prefix_depth(trees: int, deepest: int, similar: float, recall: float) -> int:
    """The longest prefix by which a pair of that similarity meets in some trie with probability `recall`."""
    depth = deepest
    while depth > 1 and 1 - (1 - similar**depth) ** trees < recall:
        depth -= 1
    return depth


_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 31, TREES * DEEPEST, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, and n+1 offsets."""
    data, offsets = text_buffers(texts)
    starts, ends, bounds = find_words(data, offsets)
    hashes, at = hash_shingles(hash_words(data, starts, ends), bounds, SHINGLE)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    hashes = hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner[fresh], minlength=len(at) - 1))])


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _paths(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The path of each nonempty set in each trie, as two numbers of LABELS labels each."""
    out = np.zeros((len(at) - 1, TREES, 2), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return out
    first = at[:-1][some]
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for tree in range(TREES):
        for level in range(DEEPEST):
            least = np.minimum.reduceat(short * _FACTORS[tree * DEEPEST + level], first)
            least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            half = level // LABELS
            out[some, tree, half] = (out[some, tree, half] << np.uint64(16)) | ((least ^ (least >> np.uint32(12))) >> np.uint32(16)).astype(np.uint64)
    return out


def _sketch(docs: DataFrame, text: str) -> DataFrame:
    fields = [T.StructField("digest", T.BinaryType()), T.StructField("width", T.LongType()), T.StructField("paths", T.ArrayType(T.LongType()))]

    def make():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            hashes, at = _sets(part.column(part.schema.get_field_index(text)))
            digests = pa.array([_digest(hashes[at[k] : at[k + 1]]) for k in range(part.num_rows)], pa.binary())
            paths = pa.array(_paths(hashes, at).view(np.int64).ravel())
            return [digests, pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * (2 * TREES)), paths)]

        return work

    return append_columns(docs, text, fields, make).drop(text)


def _shingle_sets(docs: DataFrame, text: str) -> DataFrame:
    def make():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            hashes, at = _sets(part.column(part.schema.get_field_index(text)))
            rows = [hashes[at[k] : at[k + 1]] for k in range(part.num_rows)]
            return [pa.array(map(_digest, rows), pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())]

        return work

    return append_columns(docs, text, [T.StructField("found", T.BinaryType()), T.StructField("shingles", T.BinaryType())], make).drop(text)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left shares with each on the right; if both are one list, its diagonal is not filled.

    Sets become rows of 0/1 matrices, whose product is summed over groups of COLUMNS shingles; shingles of one side drop out.
    """
    common, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    split = sum(map(len, left))
    sides = []
    for sets, columns in ((left, place[:split]), (right, place[split:])):
        sides.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets]), columns))
    held = [np.bincount(columns, minlength=len(common)) for _, columns in sides]
    used = held[0] > 1 if left is right else (held[0] > 0) & (held[1] > 0)
    column = np.cumsum(used) - 1
    sides = [(rows[used[columns]], column[columns[used[columns]]]) for rows, columns in sides]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(used.sum()), COLUMNS):
        a, b = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        for matrix, (rows, columns) in ((a, sides[0]), (b, sides[1])):
            here = (columns >= lo) & (columns < lo + COLUMNS)
            matrix[rows[here], columns[here] - lo] = 1
        out += a @ b.T
    return out


def _links(nodes: np.ndarray, counts: np.ndarray, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Rows (node, links, hub) of the sets at places a that are linked to sets at places b, which are the same ones or others.

    links counts the documents that have a linked set; hub is the least node that can be reached here.  Rows of node -1 - r say
    in links how many pairs fall into the r-th range of similarity.
    """
    left = [sets[k] for k in a]
    shared = shared_counts(left, left if a is b else [sets[k] for k in b]).astype(np.float64)
    size = np.array([len(s) for s in sets], np.float64)
    total = size[a][:, None] + size[b][None, :] - shared
    linked = shared >= SIMILAR * total - 1e-7
    if a is b:
        np.fill_diagonal(linked, False)
    similar = shared[linked] / total[linked]
    each = np.bincount(np.clip(((similar - SIMILAR) / (1 - SIMILAR) * RANGES + 1e-9).astype(int), 0, RANGES - 1), minlength=RANGES)
    links = np.zeros(len(nodes), np.int64)
    links[a] += linked @ counts[b]
    if a is not b:
        links[b] += linked.T @ counts[a]
    hub, far = nodes.copy(), np.iinfo(np.int64).max
    while True:
        before = hub.copy()
        hub[a] = np.minimum(hub[a], np.where(linked, hub[b][None, :], far).min(axis=1, initial=far))
        hub[b] = np.minimum(hub[b], np.where(linked, hub[a][:, None], far).min(axis=0, initial=far))
        if (hub == before).all():
            break
    some, ranges = np.flatnonzero(links), np.flatnonzero(each)
    return [np.concatenate(x) for x in ((nodes[some], -1 - ranges), (links[some], each[ranges]), (hub[some], -1 - ranges))]


def _verify(table: pa.Table) -> pa.Table:
    """Links inside one pair of blocks, or inside each of a pack's neighbourhoods."""
    place, node = table["place"].to_numpy(), table["node"].to_numpy()
    count, shingles = table["copies"].to_numpy(), table["shingles"].to_pylist()
    across = table.num_rows and table["i"][0] != table["j"][0]
    side = table["side"].to_numpy()
    out: list[list[np.ndarray]] = []
    order = np.lexsort((node, place))
    for rows in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
        sets = [np.frombuffer(shingles[k], np.uint64) for k in rows]
        cut_up = lambda x: [x[k : k + ROWS] for k in range(0, len(x), ROWS)]
        if across:
            pairs = [(a, b) for a in cut_up(np.flatnonzero(side[rows] == 0)) for b in cut_up(np.flatnonzero(side[rows] == 1))]
        else:
            parts = cut_up(np.arange(len(rows)))
            pairs = [(a, b) for k, a in enumerate(parts) for b in parts[k:]]
        out += [_links(node[rows], count[rows], sets, a, b) for a, b in pairs if a is not b or len(a) > 1]
    joined = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
    return pa.table(joined, names=["node", "links", "hub"])


def row_key(key: str, text: str) -> Column:
    """Sixteen bytes by which a row is found again, the same for rows of equal key and text only."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c))
    return F.unhex(F.md5(F.concat(part(F.col(f"`{key}`").cast("string")), F.lit("\0"), part(F.col(f"`{text}`"))).cast("binary")))


def _prefix(depth: int) -> Column:
    """A 64-bit hash of the trie and of the first `depth` labels of the path (hi, lo) in it."""
    low = F.shiftrightunsigned("lo", 16 * (2 * LABELS - depth)) if depth > LABELS else F.lit(0).cast("long")
    return F.xxhash64("tree", F.shiftrightunsigned("hi", 16 * (LABELS - min(depth, LABELS))), low)


def _neighbourhoods(matched: DataFrame, depth: int) -> DataFrame:
    """(node, label): sets that share prefixes of that depth, directly or through others."""
    steps = matched.select("node", _prefix(depth).alias("prefix"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    parts = steps.groupBy("prefix", "salt").agg(F.min("node").alias("part"))
    hubs = parts.groupBy("prefix").agg(F.min("part").alias("hub"))
    inside = steps.join(parts, ["prefix", "salt"]).select(F.col("node").alias("a"), F.col("part").alias("b"))
    return components(inside.unionByName(parts.join(hubs, "prefix").select(F.col("part").alias("a"), F.col("hub").alias("b"))))


def _verified(near: DataFrame, sizes: DataFrame, shingles: DataFrame) -> DataFrame:
    """What _links says of the neighbourhoods in `sizes` (label, weight)."""
    blocked = sizes.select("label", "weight", F.ceil(F.col("weight") / BLOCK).alias("blocks"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    large = blocked.where("blocks > 1").select("label", "blocks", salts)
    placed = near.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(large, ["label", "salt"], "left").select("node", "label", "blocks")
    alone = blocked.where("blocks <= 1")
    packs = -(-(alone.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0] or 1) // BLOCK)
    few = placed.where("blocks is null").drop("blocks").join(alone.select("label"), "label").join(shingles, "node")
    small = few.select(
        F.pmod(F.xxhash64("label"), F.lit(packs)).alias("task"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"),
        F.col("label").alias("place"), "node", "copies", F.lit(0).alias("side"), "shingles",
    )
    many = placed.where("blocks is not null").join(shingles, "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    many = many.select("label", "node", "copies", "shingles", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with"))
    wide = many.select(
        F.col("label").alias("task"), F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
        F.lit(0).cast("long").alias("place"), "node", "copies", (F.col("own") > F.col("with")).cast("int").alias("side"), "shingles",
    )
    return cut(small.unionByName(wide).groupBy("task", "i", "j").applyInArrow(_verify, "node long, links long, hub long"))


def needed_depth(ranges: list[int], recall: float = RECALL) -> int:
    """The prefix by which pairs of the lowest of these ranges of similarity meet with the target probability."""
    lowest = SIMILAR + (1 - SIMILAR) * min(ranges, default=RANGES) / RANGES
    return prefix_depth(TREES, DEEPEST, lowest, recall)


def _found_links(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, links, hub) of all linked sets, by prefixes that are shortened until the target recall is met."""
    halves = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda k: F.struct(k.alias("tree"), F.get("paths", 2 * k).alias("hi"), F.get("paths", 2 * k + 1).alias("lo")))
    # Sets that meet no other at the shortest prefix that can be needed meet none at a longer one.
    steps = sets.select("node", F.inline(halves)).withColumn("prefix", _prefix(prefix_depth(TREES, DEEPEST, SIMILAR, RECALL)))
    held = steps.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    matched = cut(steps.join(held.select("prefix"), "prefix", "left_semi").select("node", "tree", "hi", "lo"))
    wanted = matched.select("node").distinct().join(sets.select("node", "copies", "digest", "width", F.col("first.rk").alias("rk")), "node")
    once = wanted.join(rows.select("rk", "text"), "rk").distinct()  # as partitioned by the join
    shingles = cut(_shingle_sets(once, "text").where("found = digest").select("node", "copies", "width", "shingles"))
    depth, found, before = DEEPEST, None, None
    while True:
        near = _neighbourhoods(matched, depth)
        weighed = near.join(shingles.select("node", "width"), "node").groupBy("label")
        sizes = cut(weighed.agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("width") + SET_WEIGHT).alias("weight")))
        grown = sizes if before is None else sizes.join(before, ["label", "size"], "left_anti")
        new = _verified(near, grown, shingles)
        if found is None:
            found = new
        else:
            again = near.join(grown.select("label"), "label", "left_semi").select("node")
            found = found.where("node < 0").unionByName(found.where("node >= 0").join(again, "node", "left_anti")).unionByName(new)
        ranges = [-1 - r.node for r in found.where("node < 0").select("node").distinct().collect()]  # RANGES rows at most
        if needed_depth(ranges) >= depth:
            return found.where("node >= 0")
        depth, before = needed_depth(ranges), sizes.select("label", "size")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row_key, class_id, n_links, is_first), a row for each row of `docs`.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles (A-Z as a-z, words parted by white
    space; a text of one to four words is one shingle) is 0.8 or more.  class_id is the least key of those that a document is
    linked to directly or through others, itself included; n_links is how many other documents it is linked to directly,
    copies included; is_first marks one document of each class, and all its repeated rows.  Null, empty and blank texts
    have no shingles and link to nothing.  Rows with null keys take part and sort after all others.  An empty table gives an
    empty one; other columns are left out.

    Recall: prefixes are shortened until pairs of each similarity at which links were found become candidates with probability
    RECALL at least; what is found is exact on 64-bit shingle hashes.  Work in a neighbourhood of k different near copies grows
    as k squared, since that many links may have to be counted, spread over tasks of two blocks each; equal sets count once.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), row_key(key, text).alias("rk"), F.col(f"`{text}`").alias("text"))
    sketch = cut(_sketch(rows, "text"))
    first = F.min(F.struct(F.col("key").isNull().alias("unknown"), F.col("key").alias("key"), F.col("rk").alias("rk")))
    sets = cut(
        sketch.where("digest is not null")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), first.alias("first"), F.first("width").alias("width"), F.first("paths").alias("paths"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    found = cut(_found_links(sets, rows))
    labels = components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    linked = cut(sets.select("node", "first").join(labels, "node"))
    leaders = linked.groupBy("label").agg(F.min("first").alias("leader"))
    led = look_up(linked.select("node", "label"), leaders, "label").select("node", "leader")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = sets.select("digest", "node", "copies", "first").join(led, "node", "left").join(links, "node", "left")
    classes = cut(named.select("digest", F.coalesce("leader", "first").alias("leader"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    own = sketch.select("key", "rk", "digest")
    joined = look_up(own.where("digest is not null"), classes, "digest").select("key", "rk", "leader", "n_links")
    blank = F.struct(F.col("key").isNull().alias("unknown"), F.col("key").alias("key"), F.col("rk").alias("rk")).alias("leader")
    joined = joined.unionByName(own.where("digest is null").select("key", "rk", blank, F.lit(0).cast("long").alias("n_links")))
    return joined.select(
        F.col("key").alias(key),
        F.col("rk").alias("row_key"),
        F.col("leader.key").alias("class_id"),
        F.col("n_links").cast("long").alias("n_links"),
        (F.col("leader.rk") == F.col("rk")).alias("is_first"),
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that are the first of their class, with their own columns; repeated rows are one.

    Null, empty and blank texts are kept, one for each key.  Of rows equal in key and text the one stays whose other columns have the
    least hash, whichever task reads it.
    """
    first = near_duplicates(docs, key, text).where("is_first").select(F.col("row_key").alias("_rk")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_key(key, text).alias("_rk"))
    others = F.xxhash64(*[F.col(f"_row.`{c}`").cast("string") for c in docs.columns])
    return row.join(first, "_rk", "left_semi").groupBy("_rk").agg(F.min_by("_row", others).alias("_row")).select("_row.*")
