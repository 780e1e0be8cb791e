r"""Exact deduplication by distributed most-significant-digit radix partitioning.

All documents start in one group. Each round reads the next bytes of the normalised texts (64, then eight times as many
each round) and splits every group by them: rows alone in their group are done, texts that end here with others are
equal, and the rest goes into the next round without the bytes already read. Equality is decided by the bytes
themselves; the SHA-256 column is only reported.

Group sizes are counted by aggregation (combined before the shuffle), written, and joined back to the rows, so a group
that holds a third of all rows is split by the skewed join and never gathered. Only rows that still share a prefix carry
their remaining text on, and every round's tables lie in the shared folder.

Normalising deletes every character of `[\x20\x09-\x0D]`. Defined cases: null text counts as empty; empty texts are equal to
each other; of equal texts the row with the most code points stays, then the smallest doc_id (null last), then the
first written; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.catalog import documents, query
from sessionlens.session import drop_scratch, scratch_path

FIRST_BYTES = 64
GROWTH = 8
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without the blanks, as bytes."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out.cast("binary")


def split_round(spark: SparkSession, rows: DataFrame, width: int) -> tuple[str, str]:
    """Split all groups by their next `width` bytes; returns the paths of the split rows and of the counts."""
    rows = (
        rows.withColumn("_head", F.substring("_rest", 1, width))
        .withColumn("_ends", F.octet_length("_rest") <= width)
    )
    keys = ["_group", "_head", "_ends"]
    counts = scratch_path(spark, "radix-counts")
    (
        rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
        .withColumn("_next", F.monotonically_increasing_id()).write.parquet(counts)
    )
    out = scratch_path(spark, "radix-rows")
    shared = spark.read.parquet(counts).select(
        F.col("_group").alias("_g"), F.col("_head").alias("_hd"), F.col("_ends").alias("_e"), "_next")
    same = (F.col("_group") == F.col("_g")) & (F.col("_head") == F.col("_hd")) & (F.col("_ends") == F.col("_e"))
    state = F.when(F.col("_next").isNull(), "alone").when(F.col("_ends"), "equal").otherwise("open")
    (
        rows.join(shared.hint("merge"), same, "left")  # the same plan at every size
        .withColumn("_state", state)
        .withColumn("_group", F.col("_next"))
        .withColumn("_rest", F.when(F.col("_state") == "open", F.expr(f"substring(_rest, {width + 1})")))
        .drop("_g", "_hd", "_e", "_head", "_ends", "_next")
        .write.partitionBy("_state").parquet(out)
    )
    return out, counts


def radix_groups(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` without its text, with `_class`: null for a text that occurs once, else a number shared by equal texts."""
    spark = df.sparkSession
    rows = df.withColumn("_rest", normalised(F.col(text))).drop(text).withColumn("_group", F.lit(0).cast("long"))
    schema = T.StructType([*rows.schema.fields, T.StructField("_state", T.StringType())])
    parts, width, level = [], FIRST_BYTES, 0
    while True:
        path, counts = split_round(spark, rows, width)
        drop_scratch(spark, counts)
        table = spark.read.schema(schema).parquet(path)
        done = table.filter("_state != 'open'").withColumn(
            "_class", F.when(F.col("_state") == "equal", F.struct(F.lit(level).alias("level"), F.col("_group").alias("id"))))
        parts.append(done.drop("_state", "_rest", "_group"))
        rows = table.filter("_state = 'open'").drop("_state")
        if rows.isEmpty():
            break
        width, level = width * GROWTH, level + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = df.select(
        F.col(doc_id).alias("doc_id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("_points"),
        F.sha2(normalised(F.col(text)), 256).alias("text_sha256"),
        F.col(text).alias("_text"),
    )
    rows = radix_groups(docs, "_text").withColumn("_row", F.monotonically_increasing_id())
    alone = rows.filter("_class IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    spark = df.sparkSession
    shared = scratch_path(spark, "equal-rows")
    rows.filter("_class IS NOT NULL").write.parquet(shared)
    copies = spark.read.parquet(shared)
    rank = F.struct(-F.col("_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    best = scratch_path(spark, "equal-kept")
    copies.groupBy("_class").agg(F.count("*").alias("group_size"), F.min(rank).alias("_best")).select(
        F.col("_class").alias("_c"), "group_size", F.col("_best.doc_id").alias("keep_id"), F.col("_best._row").alias("_keep"),
    ).write.parquet(best)
    joined = copies.join(spark.read.parquet(best), F.col("_class") == F.col("_c"))
    return alone.unionByName(joined.select(
        "doc_id", "keep_id", "group_size", (F.col("_row") == F.col("_keep")).alias("kept"), "text_sha256"))


@query("op6_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), r AS (
  SELECT doc_id, body,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM r
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the equal one that stays."""
    return exact_dedup(documents(spark, sf_dir, "doc_id", "text"))
