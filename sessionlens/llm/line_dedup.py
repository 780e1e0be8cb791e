"""Removal of boilerplate lines by the number of distinct sites that carry them.

A line seen less often than the threshold, or on one site alone, cannot spread; counting by line hash (combined before the
shuffle) rules those out. For the occurrences that remain, one HyperLogLog sketch of sites per line is merged by
aggregation. Lines whose estimate is far above the threshold are boilerplate, far below are not, and those near it get
exact distinct counts. Every occurrence of a boilerplate line but the first (smallest doc_id, null last, then position) is
removed, so its content stays in the corpus once.

Occurrences are hashes, a document key and a position; texts move once, when documents meet the positions they lose.

Lines are compared without blanks at their ends. Defined cases: blank lines are never removed; a null site counts as one
site of its own; null text stays null and has no lines; rows that repeat a doc_id and its text are treated alike; an
empty table gives an empty result; extra columns are kept, but
`n_lines` and `n_removed` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.catalog import documents, query
from sessionlens.llm.rows import field, packed, unpacked
from sessionlens.session import scratch_path

MIN_SITES = 10
NEAR = 0.25
"""Estimates within this share of the threshold are counted exactly; sketches of 2^12 registers err by 1.6 % (1 sigma)."""

REGISTERS_LOG2 = 12
BLANKS = " \t\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def occurrences(df: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """One row per line with a word: document key, position, two hashes of the line, hash of the site."""
    body = F.btrim(F.col("_line"), F.lit(BLANKS))
    return (
        packed(df).select(
            field(doc_id).alias("_id"), F.xxhash64(field(text)).alias("_key"),
            F.xxhash64(F.coalesce(field(site), F.lit(""))).alias("_site"),
            F.posexplode(lines_of(field(text))).alias("_pos", "_line"))
        .withColumn("_body", body)
        .filter("_body != ''")
        .select("_id", "_key", "_pos", "_site", F.xxhash64("_body").alias("_h1"),
                F.xxhash64(F.lit(1), "_body").alias("_h2"))
    )


def boilerplate(spark: SparkSession, seen: DataFrame, min_sites: int) -> DataFrame:
    """The lines (_h1, _h2) of the written occurrences `seen` that lie on at least `min_sites` sites."""
    path = scratch_path(spark, "line-sketches")
    (
        seen.groupBy("_h1", "_h2").agg(F.hll_sketch_agg("_site", F.lit(REGISTERS_LOG2)).alias("_sketch"))
        .select("_h1", "_h2", F.hll_sketch_estimate("_sketch").alias("_sites"))
        .write.parquet(path)
    )
    lines = spark.read.parquet(path)
    clear = lines.filter(F.col("_sites") > min_sites * (1 + NEAR)).select("_h1", "_h2")
    near = lines.filter(F.col("_sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))).select("_h1", "_h2")
    exact = (
        seen.join(near, ["_h1", "_h2"], "left_semi").select("_h1", "_h2", "_site").distinct()
        .groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_sites).select("_h1", "_h2")
    )
    out = scratch_path(spark, "line-boilerplate")
    clear.unionByName(exact).write.parquet(out)
    return spark.read.parquet(out)


def line_dedup(df: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text",
               site: str = "source") -> DataFrame:
    """`df` with the boilerplate lines cut out of its text, and with `n_lines` (with a word) and `n_removed`."""
    spark = df.sparkSession
    every = occurrences(df, doc_id, text, site)
    often = scratch_path(spark, "line-often")
    (
        every.groupBy("_h1").agg(F.count("*").alias("_n"), F.min("_site").alias("_low"), F.max("_site").alias("_high"))
        .filter((F.col("_n") >= min_sites) & ((F.col("_low") != F.col("_high")) | F.lit(min_sites <= 1)))
        .select("_h1").write.parquet(often)
    )
    held = scratch_path(spark, "line-seen")
    every.join(spark.read.parquet(often), "_h1", "left_semi").write.parquet(held)
    seen = spark.read.parquet(held)

    spread_lines = boilerplate(spark, seen, min_sites)
    marked = scratch_path(spark, "line-marked")
    seen.join(spread_lines, ["_h1", "_h2"], "left_semi").write.parquet(marked)
    hits = spark.read.parquet(marked)
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key"),
                     F.col("_pos").alias("pos"))
    first = scratch_path(spark, "line-first")
    hits.groupBy("_h1", "_h2").agg(F.min(place).alias("_first")).select(
        F.col("_first.id").alias("_fid"), F.col("_first.key").alias("_fkey"), F.col("_first.pos").alias("_fpos"),
    ).write.parquet(first)
    kept = spark.read.parquet(first)
    same = F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_key") == F.col("_fkey")) & (F.col("_pos") == F.col("_fpos"))
    gone = scratch_path(spark, "line-gone")
    (
        hits.join(kept, same, "left_anti").groupBy("_id", "_key").agg(F.collect_set("_pos").alias("_gone"))
        .write.parquet(gone)
    )
    lost = spark.read.parquet(gone)

    lines = F.col("_lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    cut = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    words = F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    body = field(text)
    joined = packed(df).withColumn("_doc_key", F.xxhash64(body)).join(
        lost, field(doc_id).eqNullSafe(F.col("_id")) & (F.col("_doc_key") == F.col("_key")), "left")
    return unpacked(joined.withColumn("_lines", lines_of(body)), df.columns, {
        text: F.when(F.col("_gone").isNull(), body).otherwise(cut),
        "n_lines": F.size(words).cast("long"),
        "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
    })


@query("op3_line_dedup", r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS body FROM l
), b AS (
  SELECT body FROM k WHERE body <> '' GROUP BY body HAVING count(DISTINCT site) >= 10
), m AS (
  SELECT k.*, b.body IS NOT NULL AND row_number() OVER (PARTITION BY k.body ORDER BY doc_id, pos) > 1 AS gone
  FROM k LEFT JOIN b ON k.body = b.body
)
SELECT doc_id, count(*) FILTER (body <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM m GROUP BY doc_id
""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat across ten or more sources."""
    out = line_dedup(documents(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed",
                      F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))
