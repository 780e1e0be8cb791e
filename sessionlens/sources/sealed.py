"""Encrypted log lines: `ENC:` + base64 of nonce(12) + tag(16) + ciphertext, AES-GCM.

The key is a parameter; key files and rotation are not part of this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "ENC:"


def seal(df: DataFrame, column: str, key: Column, nonce: Column) -> DataFrame:
    """Encrypt one column of lines. The nonce must be an explicit, row-unique 12-byte expression.

    The cipher runs in its own projection, so it is evaluated once and the pieces belong together.
    """
    sealed = F.aes_encrypt(F.col(column).cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce)
    raw = F.col("_sealed")
    size = F.octet_length(raw)
    ordered = F.concat(F.substring(raw, 1, 12), raw.substr(size - 15, F.lit(16)), raw.substr(F.lit(13), size - 28))
    flat = F.regexp_replace(F.base64(ordered), r"\s", "")
    return df.withColumn("_sealed", sealed).withColumn(column, F.concat(F.lit(PREFIX), flat)).drop("_sealed")


def unseal(df: DataFrame, column: str, key: Column) -> DataFrame:
    """Decrypt one column of lines; NULL where a line cannot be decrypted."""
    text = F.when(F.col(column).startswith(PREFIX), F.substring_index(column, PREFIX, -1))
    raw = F.col("_raw")
    size = F.octet_length(raw)
    ordered = F.concat(F.substring(raw, 1, 12), raw.substr(F.lit(29), size - 28), F.substring(raw, 13, 16))
    plain = F.when(size >= 28, F.try_aes_decrypt(ordered, key, F.lit("GCM")).cast("string"))
    return df.withColumn("_raw", F.try_to_binary(text, F.lit("base64"))).withColumn(column, plain).drop("_raw")


def row_nonce(*columns: str) -> Column:
    """A 12-byte nonce derived from row-unique columns."""
    return F.substring(F.unhex(F.sha2(F.concat_ws("|", *columns), 256)), 1, 12)
