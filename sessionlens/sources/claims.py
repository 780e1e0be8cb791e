"""Small files in the shared folder that one writer alone can create: numbered entries of ledgers, manifests and registries."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _file_system(spark, path)
    return files.exists(target)


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with the content; False where it exists already, which the file system decides."""
    target, files = _file_system(spark, path)
    try:
        stream = files.create(target, False)
    except Py4JJavaError as e:
        if files.exists(target):
            return False
        raise e
    stream.write(bytearray(content.encode()))
    stream.close()
    return True


def entries(spark: SparkSession, folder: str) -> list[dict]:
    """The numbered entries of a folder, in order. They are few: one for each act of a caller, not for each row."""
    if not exists(spark, folder):
        return []
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "[0-9]*.json").text(folder).collect()
    return sorted((json.loads(r.value) for r in rows if r.value), key=lambda e: e["entry"])


def append(spark: SparkSession, folder: str, make, attempts: int = 100) -> dict:
    """Append an entry made from those before it. Two writers cannot take one number: the second sees the first's and tries again.

    `make(entries)` returns the new entry, or raises where there should be none.
    """
    for _ in range(attempts):
        before = entries(spark, folder)
        number = before[-1]["entry"] + 1 if before else 1
        entry = dict(make(before)) | {"entry": number}
        if create_once(spark, f"{folder}/{number:08d}.json", json.dumps(entry)):
            return entry
    raise RuntimeError(f"{folder} is written by others all the time")
