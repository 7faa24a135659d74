"""Removal of lines that spread over many sites.

The spread of a line is the number of distinct sites (sources) whose documents have
it.  Each line's sites are sketched with HyperLogLog and the sketches merge by
aggregation; lines whose estimate lies within ``margin`` of the threshold get an
exact distinct count.  Beyond the band the sketch decides and its estimate is the line's ``sites``: its error
is a fourth of the band, and sketches of few sites are exact, so a wrong decision is about as
likely as an error of four deviations.  A line spread over
``min_sites`` sites or more is boilerplate and goes from all documents but the one of
smallest id, so that text is never lost altogether.

Only DataFrame operations are used.  Lines travel as hashes.  The spread lines, whose number is
checked, are looked up in every document where it is, and texts are not shuffled.

Defined results: lines are cut at line feeds and compared without outer blanks;
blank lines are never counted or removed; a null text stays null with 0 lines; an
empty one has one line; very long texts and lines are taken whole; null sites count as one site of their own;
documents without an id lose no line, as they cannot be told apart, but count for its sites; repeated rows are
treated alike, so all rows of the smallest id keep a line; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .storage import kept

MIN_SITES = 10
#: Sketches of 2**11 buckets err by about 2.3 percent; four times that is sure enough.
LG_BUCKETS = 11
MARGIN = 0.1
#: Spread lines that are sent to every task at most: some 10 MB.
FEW_LINES = 200_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_hash(line: Column) -> Column:
    """Hash of a line without outer blanks; null for a blank one."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.when(bare != "", F.xxhash64(bare))


def line_table(docs: DataFrame) -> DataFrame:
    """(row key, site, id, line hash) of every distinct line that is not blank."""
    hashes = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _line_hash), lambda h: h.isNotNull()))
    return docs.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("site"),
        F.col("doc_id").alias("id"),
        F.explode(hashes).alias("line"),
    )


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """Lines spread over ``min_sites`` sites or more: line, sites, keeper (the smallest id that has it).

    Sketches are made before the shuffle, so a hot line costs each task one sketch.
    Lines near the threshold are then looked up in the texts once more and their
    distinct sites counted.
    """
    lines = line_table(docs)
    sketched = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_BUCKETS))).alias("estimate"),
        F.min("id").alias("keeper"),
    )
    band = max(1.0, margin * min_sites)
    likely = kept(sketched.where(F.col("estimate") >= min_sites - band), "lines")
    unsure = likely.where(F.col("estimate") <= min_sites + band)
    exact = lines.join(unsure.select("line"), "line").groupBy("line", "site").count().groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    counted = unsure.join(exact, "line").where(F.col("sites") >= min_sites).select("line", "sites", "keeper")
    sure = likely.where(F.col("estimate") > min_sites + band)
    return kept(sure.select("line", F.col("estimate").alias("sites"), "keeper").unionByName(counted), "spread")


def _slots(spread: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row ``slots``: an array in whose place hash modulo its size stand the spread lines (line, keeper) of that hash."""
    size = 1 << max(4, n.bit_length())
    slot = F.pmod("line", F.lit(size)).cast("int")
    filled = spread.groupBy(slot.alias("slot")).agg(F.collect_list(F.struct("line", "keeper")).alias("held"))
    every = spread.sparkSession.range(size).select(F.col("id").cast("int").alias("slot")).join(filled, "slot", "left")
    in_order = F.array_sort(F.collect_list(F.struct("slot", "held")))
    return every.agg(F.transform(in_order, lambda x: x["held"]).alias("slots")), size


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, few: int = FEW_LINES) -> DataFrame:
    """``docs`` with lines removed from ``text``, and n_lines, n_removed.  Needs doc_id, text and source.

    Up to ``few`` spread lines, counted first, go to every task, and texts stay where they are; beyond that
    the hits of each document are gathered and joined to it.
    """
    spread = spread_lines(docs, min_sites, margin)
    n = spread.count()
    lines = _lines(F.col("text"))
    if not n:
        return _counted(docs.withColumn("__stay", F.lit(None).cast("array<string>")))
    if n <= few:
        slots, size = _slots(spread, n)
        hashed = F.transform(lines, lambda x: F.struct(x.alias("line"), _line_hash(x).alias("h")))
        mine = lambda x: F.exists(F.get(F.col("__slots"), F.pmod(x["h"], F.lit(size)).cast("int")), lambda s: (s["line"] == x["h"]) & (s["keeper"] != F.col("doc_id")))
        stay = F.transform(F.filter(hashed, lambda x: ~F.coalesce(mine(x), F.lit(False))), lambda x: x["line"])
        # One array for all rows, which the optimizer puts where it is used rather than into the rows.
        return _counted(docs.withColumn("__slots", slots.scalar()).withColumn("__stay", stay).drop("__slots"))
    hit = line_table(docs).join(spread, "line").where(F.col("id") != F.col("keeper")).groupBy("id").agg(F.collect_set("line").alias("__drop"))
    joined = docs.join(hit.withColumnRenamed("id", "__id"), F.col("doc_id") == F.col("__id"), "left")
    stay = F.filter(lines, lambda x: F.coalesce(~F.array_contains(F.col("__drop"), _line_hash(x)), F.lit(True)))
    return _counted(joined.withColumn("__stay", F.when(F.col("__drop").isNotNull(), stay)).drop("__drop", "__id"))


def _counted(df: DataFrame) -> DataFrame:
    """Takes the lines that stay (null: all) for the text and counts both."""
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(_lines(F.col("text"))))
    gone = F.coalesce(n - F.size("__stay"), F.lit(0))
    return (
        df.withColumn("n_lines", n)
        .withColumn("n_removed", F.when(F.col("__stay").isNull() | F.col("text").isNull(), F.lit(0)).otherwise(gone))
        .withColumn("text", F.when(F.col("n_removed") > 0, F.array_join("__stay", "\n")).otherwise(F.col("text")))
        .drop("__stay")
    )


def op9_line_spread(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines that spread over sites."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


#: The same rows by exact counting.
ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, u.line, u.pos
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos)
), b AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM l
), s AS (
  SELECT bare, min(doc_id) AS keeper FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= {MIN_SITES}
), d AS (
  SELECT b.doc_id, b.pos, b.line, s.bare IS NOT NULL AND b.doc_id <> s.keeper AS gone FROM b LEFT JOIN s ON b.bare = s.bare
)
SELECT x.doc_id, CAST(coalesce(g.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(g.n_removed, 0) AS INTEGER) AS n_removed,
  CASE WHEN x.text IS NULL THEN NULL ELSE coalesce(g.kept, '') END AS text
FROM documents x LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM d GROUP BY doc_id
) g ON x.doc_id = g.doc_id
"""
