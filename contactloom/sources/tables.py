"""Readers and writers of the text tables that contact-map tools exchange.  All schemas are fixed, none inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.blocks import carried, dealt

TRIPLES = "id1 long, id2 long, count long"
FRAGMENTS = "id long, chrom string, start_pos long, end_pos long, size long, gc_content double"
BINS = "chrom string, start long, end long, weight double"
PIXELS = "bin1_id long, bin2_id long, count long"
CHROMS = "name string, length long"
SITES = "chr string, start long, end long, type string, seq string, err int"
SKEW = "chr string, start long, end long, val double"
TRACK = "chrom string, start long, end long, value double"


def _tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, header=header, enforceSchema=True)


def read_pixels(spark: SparkSession, path: str, sample: str, header: bool = True) -> DataFrame:
    """(sample, id1, id2, count): a sparse map as triples of fragment numbers and counts, from 0.

    With `header` the first line of each file, whatever it says (sizes of the map or names), is left out, by its place and not by
    its values.
    """
    return _tsv(spark, path, TRIPLES, header=header).select(F.lit(sample).alias("sample"), "id1", "id2", "count")


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """The fragment list, with its header line."""
    return _tsv(spark, path, FRAGMENTS, header=True)


def read_cool_tables(spark: SparkSession, directory: str, resolution: int, sample: str, balance: bool = True) -> DataFrame:
    """(sample, chrom1, bin1, chrom2, bin2, count) from a directory {resolution}/ with bins and pixels as Parquet; bins carry their id.

    With `balance` count * weight * weight, null where a weight is.
    """
    bins = spark.read.parquet(f"{directory}/{resolution}/bins")
    place = lambda k: bins.select(F.col("id").alias(f"bin{k}_id"), F.col("chrom").alias(f"chrom{k}"), F.floor(F.col("start") / resolution).alias(f"bin{k}"), F.col("weight").alias(f"w{k}"))
    rows = spark.read.parquet(f"{directory}/{resolution}/pixels").join(place(1), "bin1_id").join(place(2), "bin2_id")
    value = F.col("count") * F.col("w1") * F.col("w2") if balance else F.col("count").cast("double")
    return rows.select(F.lit(sample).alias("sample"), "chrom1", "bin1", "chrom2", "bin2", value.alias("count"))


def read_track(spark: SparkSession, path: str, sample: str, per_position: bool = False) -> DataFrame:
    """(sample, chrom, start, end, value) of a bedGraph, or a row (sample, chrom, pos, value) for each position."""
    rows = _tsv(spark, path, TRACK).withColumn("sample", F.lit(sample))
    if not per_position:
        return rows.select("sample", "chrom", "start", "end", "value")
    return rows.where("end > start").select("sample", "chrom", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "value")


def read_sites(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(chrom, start, end, description) of a list of parS or matS sites."""
    return _tsv(spark, path, SITES, header=True).select(F.col("chr").alias("chrom"), "start", "end", F.lit(kind).alias("description"))


def read_gc_skew(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, val) of skew windows, with a header line."""
    return _tsv(spark, path, SKEW, header=True).withColumnRenamed("chr", "chrom")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq, length): a record's name is the first word of its header."""
    records = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    head = F.regexp_extract("value", r"^\s*(\S+)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return records.select(head.alias("chrom"), seq.alias("seq")).withColumn("length", F.char_length("seq").cast("long"))


def read_fasta_chunks(spark: SparkSession, path: str, size: int = 1 << 20) -> DataFrame:
    """(chrom, chunk, seq): records in chunks of `size` letters, the last one shorter; a record's name is the first word of its header, and names are unique.

    Lines are read by splits of the files and put in order by range; the last header and the letters before a line are carried over from one
    range to the next, so that a record of any length is read by many tasks.  Records without letters have no chunk.
    """
    lines = spark.read.text(path).select(F.rtrim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    name = F.when(F.col("line").startswith(">"), F.regexp_extract("line", r"^>\s*(\S*)", 1))
    seq = F.when(name.isNull(), F.regexp_replace("line", r"\s", "")).otherwise("")
    rows = dealt(lines.select("file", "split", "id", name.alias("name"), seq.alias("seq"), F.char_length(seq).cast("long").alias("length")), ["file"], "split", "id")
    rows = carried(rows, ["file"], base=(F.sum("length"), F.sum("base")))
    before = Window.partitionBy("block", "file").orderBy("split", "id")
    rows = rows.withColumn("at", F.coalesce("base", F.lit(0)) + F.sum("length").over(before) - F.col("length"))
    rows = rows.withColumn("head", F.when(F.col("name").isNotNull(), F.struct("split", "id", "name", "at")))
    rows = carried(rows, ["file"], last=(F.max("head"), F.max("last")))
    head = F.coalesce(F.max("head").over(before), F.col("last"))
    placed = rows.withColumn("head", head).where("length > 0 and head is not null").select(F.col("head.name").alias("chrom"), (F.col("at") - F.col("head.at")).alias("at"), "seq", "length")
    placed = placed.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("length") - 1) / size))))
    skip = F.greatest(F.col("chunk") * size - F.col("at"), F.lit(0))
    stop = F.least((F.col("chunk") + 1) * size - F.col("at"), F.col("length"))
    parts = placed.select("chrom", "chunk", F.struct(F.col("at") + skip, F.col("seq").substr((skip + 1).cast("int"), (stop - skip).cast("int")).alias("part")).alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["part"])
    return parts.groupBy("chrom", "chunk").agg(F.array_join(ordered, "").alias("seq"))


def write_positions(positions: DataFrame, path: str) -> None:
    """chrom, coord and description, tab-separated."""
    positions.select("chrom", "coord", "description").write.csv(path, sep="\t")


def write_table(table: DataFrame, path: str) -> None:
    """All columns, tab-separated, with a header in each file."""
    table.write.csv(path, sep="\t", header=True)


def write_partitioned(table: DataFrame, path: str) -> None:
    """Parquet by sample and chromosome, so that readers of one map open no other."""
    table.write.partitionBy("sample", "chrom").parquet(path)
