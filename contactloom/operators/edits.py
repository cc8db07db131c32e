"""Edited genomes: replaying edits on layouts, and the sequences that result."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEY
from .intervals import boundaries

#: A piece: source chromosome, start, end, whether reversed.
Piece = tuple[str, int, int, bool]


def _cut(pieces: list[Piece], at: int) -> int:
    """Cuts the chromosome at a position; the index of the piece that starts there."""
    place = 0
    for k, (chrom, start, end, reverse) in enumerate(pieces):
        if at == place:
            return k
        if at < place + end - start:
            inside = at - place
            halves = [(chrom, end - inside, end, True), (chrom, start, end - inside, True)] if reverse else [(chrom, start, start + inside, False), (chrom, start + inside, end, False)]
            pieces[k : k + 1] = halves
            return k + 1
        place += end - start
    if at == place:
        return len(pieces)
    raise ValueError(f"position {at} is outside a chromosome of {place}")


def _turned(pieces: list[Piece]) -> list[Piece]:
    return [(c, s, e, not r) for c, s, e, r in reversed(pieces)]


def _taken(pieces: list[Piece], start: int, end: int) -> tuple[int, int]:
    a = _cut(pieces, start)
    return a, _cut(pieces, end)


def replay(genome: dict[str, list[Piece]], edits: list[dict]) -> dict[str, list[Piece]]:
    """Applies edits in order.  Positions are those of the edited chromosomes at that time.

    insert: source piece at pos.  invert, delete: of start to end.  duplicate: a copy of start to end of src_chrom, turned round if
    `invert`, at pos of chrom.  translocate: that part moves there; pos is counted before it is taken out.  Without src_chrom it is chrom.
    """
    for e in edits:
        own = genome.setdefault(e["chrom"], [])
        if e["op"] == "insert":
            k = _cut(own, e["pos"])
            own[k:k] = [(e["src_chrom"], e["src_start"], e["src_end"], bool(e["invert"]))]
        elif e["op"] == "invert":
            a, b = _taken(own, e["start"], e["end"])
            own[a:b] = _turned(own[a:b])
        elif e["op"] == "delete":
            a, b = _taken(own, e["start"], e["end"])
            del own[a:b]
        elif e["op"] in ("duplicate", "translocate"):
            source = genome[e["src_chrom"] or e["chrom"]]
            a, b = _taken(source, e["start"], e["end"])
            moved = _turned(source[a:b]) if e["invert"] else source[a:b]
            if e["op"] == "translocate":
                length = e["end"] - e["start"]
                at = e["pos"]
                if source is own and e["start"] < at:
                    at = max(e["start"], at - length)
                del source[a:b]
                k = _cut(own, at)
            else:
                k = _cut(own, e["pos"])
            own[k:k] = moved
        else:
            raise ValueError(e["op"])
        for chrom in genome:
            genome[chrom] = [p for p in genome[chrom] if p[2] > p[1]]
    return genome


#: Letters of a chunk of a sequence.
CHUNK = 1 << 20
#: Pieces and edits of a group of samples, some.
TOGETHER = 1 << 14
_LAYOUT = "sample string, chrom string, ord int, src_chrom string, start long, end long, is_reverse boolean"


def apply_edits(layout: DataFrame, edits: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Layouts after each sample's edits (sample, seq, op, chrom, pos, start, end, src_chrom, src_start, src_end, invert), in order of seq.

    A sample's pieces and edits are few rows, and an edit may move pieces between its chromosomes, so that a sample is edited as a whole.  Samples
    are dealt by hash into groups with some `together` pieces and edits, since a group costs far more than a sample.
    """
    held = layout.count() + edits.count()
    groups = max(1, -(-held // together))
    number = ("pos", "start", "end", "src_start", "src_end")

    def run(pieces: pa.Table, wanted: pa.Table) -> pa.Table:
        genomes: dict[str | None, dict[str, list[Piece]]] = {}
        for r in pieces.sort_by([("chrom", "ascending"), ("ord", "ascending")]).to_pylist():
            genomes.setdefault(r["sample"], {}).setdefault(r["chrom"], []).append((r["src_chrom"], r["start"], r["end"], bool(r["is_reverse"])))
        asked: dict[str | None, list[dict]] = {}
        for r in wanted.sort_by("seq").to_pylist():
            asked.setdefault(r["sample"], []).append(r | {k: int(r[k]) for k in number if r[k] is not None})
        for sample, rows in asked.items():
            genomes[sample] = replay(genomes.get(sample, {}), rows)
        flat = [(sample, chrom, k, *p) for sample, genome in genomes.items() for chrom, own in genome.items() for k, p in enumerate(own)]
        names = ("sample", "chrom", "ord", "src_chrom", "start", "end", "is_reverse")
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        return pa.table([pa.array([row[k] for row in flat], kind) for k, kind in enumerate(kinds)], names=list(names))

    dealt = lambda df: df.withColumn("_group", F.pmod(F.xxhash64("sample"), F.lit(groups))).groupBy("_group")
    return dealt(layout).cogroup(dealt(edits)).applyInArrow(run, _LAYOUT)


def sequences(layout: DataFrame, fasta: DataFrame) -> DataFrame:
    """(sample, chrom, seq): the pieces' sequences (chrom, seq), reverse-complemented on the reverse strand, one after another."""
    source = fasta.select(F.col("chrom").alias("src_chrom"), "seq")
    part = F.col("seq").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    turned = F.reverse(F.translate(part, "ACGTacgt", "TGCAtgca"))
    rows = layout.join(source, "src_chrom").select(*KEY, "ord", F.when(F.col("is_reverse"), turned).otherwise(part).alias("part"))
    ordered = F.sort_array(F.collect_list(F.struct("ord", "part")))
    return rows.groupBy(*KEY).agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias("seq"))


def sequence_chunks(layout: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(sample, chrom, chunk, seq): what sequences() gives, and takes as (chrom, chunk, seq), in chunks of `size` letters, the last one shorter.

    A piece meets the chunks of its source that it reaches into, and each part goes to the one or two chunks of the new sequence in which it
    lies, so that no task holds more than some chunks, however long a chromosome is.
    """
    part = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("from")
    pieces = boundaries(layout).where("to > at").select(*KEY, "src_chrom", "start", "end", "is_reverse", "at", part)
    source = chunks.select(F.col("chrom").alias("src_chrom"), F.col("chunk").alias("from"), F.col("seq").alias("letters"))
    first = F.col("from") * size
    lo, hi = F.greatest(F.col("start"), first), F.least(F.col("end"), first + size)
    taken = F.col("letters").substr((lo - first + 1).cast("int"), (hi - lo).cast("int"))
    turned = F.reverse(F.translate(taken, "ACGTacgt", "TGCAtgca"))
    place = F.when(F.col("is_reverse"), F.col("at") + F.col("end") - hi).otherwise(F.col("at") + lo - F.col("start"))
    parts = pieces.join(source, ["src_chrom", "from"]).select(*KEY, place.alias("place"), F.when(F.col("is_reverse"), turned).otherwise(taken).alias("part"))
    parts = parts.where("part <> ''").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("place") / size), F.floor((F.col("place") + F.char_length("part") - 1) / size))))
    skip = F.greatest(F.col("chunk") * size - F.col("place"), F.lit(0))
    stop = F.least((F.col("chunk") + 1) * size - F.col("place"), F.char_length("part"))
    cut = parts.select(*KEY, "chunk", F.struct(F.col("place") + skip, F.col("part").substr((skip + 1).cast("int"), (stop - skip).cast("int")).alias("part")).alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["part"])
    return cut.groupBy(*KEY, "chunk").agg(F.array_join(ordered, "").alias("seq"))
