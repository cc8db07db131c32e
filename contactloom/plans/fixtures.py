"""Views over the given tables in the shapes of contact-map data, and the same in SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maps

#: Bins of the smallest derived genome's chromosomes, and bins that are left empty to make white lines.
SIZES = {"chr1": 64, "p1": 16}
WHITE = (17, 40)
SAMPLES = ("A", "N", "R")
BIN = 1000
#: Suppliers whose contacts make up the maps of one group of samples, and events that make up its tracks: with larger tables there are more.
SUPPLIERS, EVENTS = 500, 64_000
#: Suppliers for which the genome grows once more by its smallest size.
GROWTH = 100


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@functools.cache
def _times(spark: SparkSession, sf_dir: str, growth: int) -> int:
    return max(1, read(spark, sf_dir, "supplier").count() // growth)


def genome(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Bins of each chromosome, more for larger tables: every GROWTH suppliers make the genome longer."""
    return {chrom: n * _times(spark, sf_dir, GROWTH) for chrom, n in SIZES.items()}


def length(spark: SparkSession, sf_dir: str) -> int:
    """Length of chr1."""
    return genome(spark, sf_dir)["chr1"] * BIN


def _grouped(name: str, key: str, size: int):
    """A sample's name: the first group's is plain, the others have their number."""
    group = F.floor(F.col(key) / size)
    return F.concat(F.col(name), F.when(group > 0, group.cast("string")).otherwise("")).alias("sample")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, chrom1, frag1, chrom2, frag2, id1, id2, count) from lineitem: 100 bp fragments, a row for each contact."""
    rows = read(spark, sf_dir, "lineitem")
    size = {chrom: n * 10 for chrom, n in genome(spark, sf_dir).items()}
    f = (F.col("l_partkey") * 7 + F.col("l_suppkey")) % size["chr1"]
    g = (f + F.floor((F.col("l_quantity") - 1) * (F.col("l_quantity") - 1) / 4)) % size["chr1"]
    main, other = F.col("l_linenumber") <= 5, F.col("l_orderkey") % 10 == 0
    c1, c2 = F.when(main, "chr1").otherwise("p1"), F.when(main != other, "chr1").otherwise("p1")
    on = lambda c, x: F.when(c == "chr1", x).otherwise(x % size["p1"])
    rows = rows.select(_grouped("l_returnflag", "l_suppkey", SUPPLIERS), c1.alias("chrom1"), on(c1, f).alias("frag1"), c2.alias("chrom2"), on(c2, g).alias("frag2"), F.lit(1).cast("long").alias("count"))
    number = lambda k: F.col(f"frag{k}") + F.when(F.col(f"chrom{k}") == "p1", size["chr1"]).otherwise(0)
    return rows.withColumns({"id1": number(1), "id2": number(2)})


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, chrom, start_pos, end_pos, size, gc_content) of the fragments that have contacts."""
    c = contacts(spark, sf_dir)
    both = c.select(F.col("id1").alias("id"), F.col("chrom1").alias("chrom"), F.col("frag1").alias("f")).union(c.select("id2", "chrom2", "frag2")).distinct()
    return both.select("id", "chrom", (F.col("f") * 100).alias("start_pos"), (F.col("f") * 100 + 100).alias("end_pos"), F.lit(100).cast("long").alias("size"), F.lit(0.0).alias("gc_content"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, chrom1, bin1, chrom2, bin2, count)."""
    # A number for each bin of the genome.  Names are made from aggregates, so that filters on them are applied to cells and not, with
    # all of these expressions written out again and again, to contacts.
    place = lambda k: F.floor(F.col(f"id{k}") / 10)
    rows = contacts(spark, sf_dir).select("sample", F.least(place(1), place(2)).alias("a"), F.greatest(place(1), place(2)).alias("b"))
    rows = rows.groupBy("sample", "a", "b").agg(F.count(F.lit(1)).alias("count"), F.max("a").alias("lo"), F.max("b").alias("hi"))
    first = genome(spark, sf_dir)["chr1"]
    at = lambda c, k: [F.when(F.col(c) < first, "chr1").otherwise("p1").alias(f"chrom{k}"), F.when(F.col(c) < first, F.col(c)).otherwise(F.col(c) - first).alias(f"bin{k}")]
    return rows.select("sample", *at("lo", 1), *at("hi", 2), "count")


def upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper maps inside chromosomes, two bins of chr1 left empty."""
    n = F.create_map(*[F.lit(x) for pair in genome(spark, sf_dir).items() for x in pair])[F.col("chrom1")].cast("long")
    rows = pixels(spark, sf_dir).where("chrom1 = chrom2").withColumn("n", n)
    white = F.col("bin1").isin(*WHITE) | F.col("bin2").isin(*WHITE)
    rows = rows.where(~((F.col("chrom1") == "chr1") & white))
    return rows.select("sample", F.col("chrom1").alias("chrom"), "n", "bin1", "bin2", F.col("count").cast("double").alias("value"))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole maps."""
    return maps.from_upper(upper(spark, sf_dir))


def chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, chrom, length, n) of the chromosomes that have contacts."""
    # Contacts tell it: their maps need not be summed for that.
    rows = contacts(spark, sf_dir).where("chrom1 = chrom2")
    white = F.floor(F.col("frag1") / 10).isin(*WHITE) | F.floor(F.col("frag2") / 10).isin(*WHITE)
    names = rows.where(~((F.col("chrom1") == "chr1") & white)).select(F.col("chrom1").alias("chrom")).distinct()
    n = F.create_map(*[F.lit(x) for pair in genome(spark, sf_dir).items() for x in pair])[F.col("chrom")].cast("long")
    names = names.withColumn("n", n)
    return names.select(F.when(F.col("chrom") == "chr1", 0).otherwise(1).alias("ord"), "chrom", (F.col("n") * BIN).alias("length"), "n")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, chrom, pos, value) from events, positions on chr1."""
    rows = read(spark, sf_dir, "events")
    return rows.groupBy(_grouped("event_type", "event_id", EVENTS), F.lit("chr1").alias("chrom"), (F.col("event_id") * 37 % length(spark, sf_dir)).alias("pos")).agg(F.max("value").alias("value"))


def gc_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, start, end, val) from orders: 300 windows, positive from the 40th to the 189th."""
    i = F.col("o_orderkey") % 300
    rows = read(spark, sf_dir, "orders").groupBy(i.alias("i")).agg(F.avg("o_totalprice").alias("p"))
    sign = F.when((F.col("i") >= 40) & (F.col("i") <= 189), 0.5).otherwise(-0.5)
    return rows.select(F.lit("chr1").alias("chrom"), (F.col("i") * 200).alias("start"), (F.col("i") * 200 + 399).alias("end"), ((F.col("p") - 250000) / 250000 + sign).alias("val"))


def sites(spark: SparkSession, sf_dir: str, offset: int) -> DataFrame:
    """(id, chrom, start, end) from suppliers with even keys."""
    end = length(spark, sf_dir)
    start = (offset + F.col("s_suppkey") * 13) % end
    rows = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    return rows.select(F.col("s_suppkey").alias("id"), F.lit("chr1").alias("chrom"), start.alias("start"), (start + 16).alias("end")).where(F.col("end") <= end)


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, chrom, gene_id, tss, strand, rpkm) from parts, by turns for the samples of the first group."""
    rows = read(spark, sf_dir, "part")
    strand = F.when(F.col("p_size") % 2 == 0, "+").otherwise("-")
    sample = F.element_at(F.array(*[F.lit(x) for x in SAMPLES]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return rows.select(sample.alias("sample"), F.lit("chr1").alias("chrom"), F.col("p_partkey").alias("gene_id"), (F.col("p_partkey") * 37 % length(spark, sf_dir)).alias("tss"), strand.alias("strand"), (F.col("p_retailprice") * F.col("p_size")).alias("rpkm"))


def intervals_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, chrom, start, end, is_reverse) from orders."""
    start = F.col("o_custkey") * 10
    rows = read(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("id"), F.lit("chr1").alias("chrom"), start.alias("start"), (start + F.floor(F.col("o_totalprice") / 10000)).alias("end"), (F.col("o_orderkey") % 2 == 1).alias("is_reverse"))


def intervals_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, chrom, start, end, is_reverse) from parts."""
    start = F.col("p_partkey") * 7
    rows = read(spark, sf_dir, "part")
    return rows.select(F.col("p_partkey").alias("id"), F.lit("chr1").alias("chrom"), start.alias("start"), (start + F.col("p_size")).alias("end"), (F.col("p_partkey") % 2 == 1).alias("is_reverse"))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, chrom, ord, src_chrom, start, end, is_reverse): each customer has two chromosomes of 10,000 bp in four pieces each."""
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("sample"), F.col("c_custkey").alias("k"))
    rows = rows.withColumn("chrom", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("ord", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    start = (F.col("ord") * 2500).cast("long")
    return rows.select("sample", "chrom", "ord", F.col("chrom").alias("src_chrom"), start.alias("start"), (start + 2500).alias("end"), ((F.col("k") + F.col("ord")) % 3 == 0).alias("is_reverse"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two edits of each customer's layout, their kind and place by the key."""
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k).alias("sample"), k.alias("k")).withColumn("seq", F.explode(F.sequence(F.lit(0), (F.col("k") % 2).cast("int"))))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("insert", "invert", "delete", "translocate", "duplicate")]), ((F.col("k") + F.col("seq")) % 5 + 1).cast("int"))
    start = F.col("k") * 31 % 4000
    return rows.select(
        "sample", "seq", kind.alias("op"), F.lit("a").alias("chrom"), (F.col("k") * 17 % 5000).alias("pos"), start.alias("start"), (start + 1000).alias("end"),
        F.lit("b").alias("src_chrom"), F.lit(100).cast("long").alias("src_start"), F.lit(400).cast("long").alias("src_end"), (F.col("k") % 3 == 0).alias("invert"),
    )


def fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, seq) from documents: the letters A, C, G and T of each text; those without any are left out."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chrom"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    return rows.where("seq <> ''")


#: The same views as common table expressions of DuckDB.  grid is dense, dense has nulls in masked bins.
BASE = f"""
genome AS (SELECT 64 * k AS bins, 64000 * k AS length FROM (SELECT greatest(1, count(*) // {GROWTH}) AS k FROM supplier)),
con AS (
  SELECT l_returnflag || CASE WHEN l_suppkey >= 500 THEN CAST(l_suppkey // 500 AS VARCHAR) ELSE '' END AS sample, l_linenumber <= 5 AS main, l_orderkey % 10 = 0 AS other, (l_partkey * 7 + l_suppkey) % (BINS_ * 10) AS f,
         ((l_partkey * 7 + l_suppkey) % (BINS_ * 10) + CAST(floor((l_quantity - 1) * (l_quantity - 1) / 4) AS BIGINT)) % (BINS_ * 10) AS g
  FROM lineitem),
con2 AS (SELECT *, CASE WHEN main THEN 'chr1' ELSE 'p1' END AS chrom1, CASE WHEN main <> other THEN 'chr1' ELSE 'p1' END AS chrom2 FROM con),
contacts AS (
  SELECT sample, chrom1, chrom2, CASE WHEN chrom1 = 'chr1' THEN f ELSE f % (BINS_ * 10 // 4) END AS frag1,
         CASE WHEN chrom2 = 'chr1' THEN g ELSE g % (BINS_ * 10 // 4) END AS frag2 FROM con2),
frags AS (SELECT DISTINCT chrom, f * 100 AS start_pos, f * 100 + 100 AS end_pos
          FROM (SELECT chrom1 AS chrom, frag1 AS f FROM contacts UNION ALL SELECT chrom2, frag2 FROM contacts)),
pix AS (
  SELECT sample, CASE WHEN (chrom1, frag1 // 10) <= (chrom2, frag2 // 10) THEN chrom1 ELSE chrom2 END AS chrom1,
         CASE WHEN (chrom1, frag1 // 10) <= (chrom2, frag2 // 10) THEN frag1 // 10 ELSE frag2 // 10 END AS bin1,
         CASE WHEN (chrom1, frag1 // 10) <= (chrom2, frag2 // 10) THEN chrom2 ELSE chrom1 END AS chrom2,
         CASE WHEN (chrom1, frag1 // 10) <= (chrom2, frag2 // 10) THEN frag2 // 10 ELSE frag1 // 10 END AS bin2
  FROM contacts),
pixels AS (SELECT sample, chrom1, bin1, chrom2, bin2, count(*) AS count FROM pix GROUP BY ALL),
up AS (
  SELECT sample, chrom1 AS chrom, CASE WHEN chrom1 = 'chr1' THEN BINS_ ELSE BINS_ // 4 END AS n, bin1, bin2, CAST(count AS DOUBLE) AS value
  FROM pixels WHERE chrom1 = chrom2 AND NOT (chrom1 = 'chr1' AND (bin1 IN (17, 40) OR bin2 IN (17, 40)))),
sym AS (SELECT * FROM up UNION ALL SELECT sample, chrom, n, bin2, bin1, value FROM up WHERE bin1 <> bin2),
maps AS (SELECT DISTINCT sample, chrom, n FROM up),
bins AS (SELECT sample, chrom, n, unnest(range(n)) AS bin FROM maps),
chroms AS (SELECT DISTINCT CASE WHEN chrom = 'chr1' THEN 0 ELSE 1 END AS ord, chrom, n * 1000 AS length, n FROM up),
grid AS (
  SELECT a.sample, a.chrom, a.n, a.bin AS i, b.bin AS j, coalesce(s.value, 0) AS v
  FROM bins a JOIN bins b USING (sample, chrom, n)
  LEFT JOIN sym s ON s.sample = a.sample AND s.chrom = a.chrom AND s.bin1 = a.bin AND s.bin2 = b.bin),
zc AS (SELECT sample, chrom, n, j AS bin, count(*) FILTER (v = 0) AS zeros FROM grid GROUP BY ALL),
zm AS (SELECT sample, chrom, median(zeros) AS med FROM zc GROUP BY ALL),
zd AS (SELECT sample, chrom, med, median(abs(zeros - med)) AS mad FROM zc JOIN zm USING (sample, chrom) GROUP BY ALL),
mask AS (SELECT sample, chrom, n, bin, zeros >= greatest(1, med + 3 * mad) AS masked FROM zc JOIN zd USING (sample, chrom)),
dense AS (
  SELECT g.sample, g.chrom, g.n, g.i, g.j, CASE WHEN a.masked OR b.masked THEN NULL ELSE v END AS m
  FROM grid g JOIN mask a ON a.sample = g.sample AND a.chrom = g.chrom AND a.bin = g.i
  JOIN mask b ON b.sample = g.sample AND b.chrom = g.chrom AND b.bin = g.j),
tracks AS (SELECT event_type || CASE WHEN event_id >= 64000 THEN CAST(event_id // 64000 AS VARCHAR) ELSE '' END AS sample, 'chr1' AS chrom, pos, max(value) AS value
  FROM (SELECT *, event_id * 37 % LENGTH_ AS pos FROM events) GROUP BY ALL),
skew AS (
  SELECT i, i * 200 AS start, i * 200 + 399 AS "end", (p - 250000) / 250000 + CASE WHEN i BETWEEN 40 AND 189 THEN 0.5 ELSE -0.5 END AS val
  FROM (SELECT o_orderkey % 300 AS i, avg(o_totalprice) AS p FROM orders GROUP BY ALL)),
genes AS (
  SELECT ['A', 'N', 'R'][p_partkey % 3 + 1] AS sample, 'chr1' AS chrom, p_partkey AS gene_id, p_partkey * 37 % LENGTH_ AS tss, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand,
         p_retailprice * p_size AS rpkm FROM part),
ia AS (SELECT o_orderkey AS id, o_custkey * 10 AS s, o_custkey * 10 + CAST(floor(o_totalprice / 10000) AS BIGINT) AS e, o_orderkey % 2 = 1 AS r FROM orders),
ib AS (SELECT p_partkey AS id, p_partkey * 7 AS s, p_partkey * 7 + p_size AS e, p_partkey % 2 = 1 AS r FROM part),
lay AS (
  SELECT 'c' || c_custkey AS sample, chrom, ord, CAST(ord * 2500 AS BIGINT) AS s, CAST(ord * 2500 + 2500 AS BIGINT) AS e, (c_custkey + ord) % 3 = 0 AS r
  FROM customer, (SELECT unnest(['a', 'b']) AS chrom), (SELECT unnest(range(4)) AS ord))
"""
