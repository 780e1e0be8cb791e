"""Stored models: versions with checksums, and which version is active or runs in the shadow.

A model is saved below `<root>/<name>/v<version>`. The registry itself is a table of small rows that is only appended to; the
newest row of a version tells its flags. Checksums are taken over the saved files by a Spark job.
"""

from __future__ import annotations

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlens.sources.claims import create_once

FIELDS = "name string, version long, sha256 string, active boolean, shadow boolean, entry long"


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 over the digests of a folder's files in the order of their paths below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    one = F.struct(below.alias("p"), F.sha2("content", 256).alias("d"))
    digest = F.sha2(F.to_json(F.array_sort(F.collect_list(one))), 256)
    return files.agg(digest.alias("d")).first()["d"]


def entries(spark: SparkSession, root: str) -> DataFrame:
    """The newest entry of every version."""
    table = spark.read.schema(FIELDS).option("ignoreMissingFiles", "true").parquet(f"{root}/_registry")
    newest = Window.partitionBy("name", "version").orderBy(F.desc("entry"))
    return table.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def _known(spark: SparkSession, root: str, name: str) -> list:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_registry")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return []
    return entries(spark, root).filter(F.col("name") == name).orderBy("version").collect()


def _append(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(f"{root}/_registry")


def save(spark: SparkSession, model, root: str, name: str, shadow: bool = False) -> int:
    """Save a model as the next version; it becomes the active one, or with `shadow` runs beside it.

    A version is claimed by a file that one saver alone can create, so two savers never share one."""
    known = _known(spark, root, name)
    version = max((r.version for r in known), default=0) + 1
    while not create_once(spark, f"{root}/_claims/{name}-v{version}", name):
        version += 1
    path = f"{root}/{name}/v{version}"
    model.write().save(path)
    entry = max((r.entry for r in known), default=0) + 1
    rows = [(name, version, checksum(spark, path), not shadow, shadow, entry)]
    if not shadow:
        rows += [(r.name, r.version, r.sha256, False, r.shadow, entry) for r in known if r.active]
    _append(spark, root, rows)
    return version


def activate(spark: SparkSession, root: str, name: str, version: int) -> None:
    """Make a version the active one; it no longer runs in the shadow."""
    known = _known(spark, root, name)
    if version not in {r.version for r in known}:
        raise KeyError(f"{name} has no version {version}")
    entry = max(r.entry for r in known) + 1
    _append(spark, root, [
        (r.name, r.version, r.sha256, r.version == version, r.shadow and r.version != version, entry)
        for r in known if r.active or r.version == version])


def load(spark: SparkSession, root: str, name: str, version: int | None = None):
    """Load a version (default: the active one) after checking its files against the registry."""
    known = {r.version: r for r in _known(spark, root, name)}
    if version is None:
        version = next((v for v, r in known.items() if r.active), None)
    if version not in known:
        raise KeyError(f"{name} has no version {version}")
    path = f"{root}/{name}/v{version}"
    if checksum(spark, path) != known[version].sha256:
        raise ValueError(f"{path} differs from its checksum")
    return DefaultParamsReader.loadParamsInstance(path, spark)
