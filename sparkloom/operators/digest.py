"""Digests of contents that do not depend on the order of rows or on the number of workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.hashing import canonical_cell, canonical_row


def _row_hash(df: DataFrame) -> Column:
    """60 bits of the SHA-256 of a row's canonical cells, columns by name; nested cells count as their JSON."""
    def cell(f) -> Column:
        try:
            return canonical_cell(F.col(f"`{f.name}`"), f.dataType)
        except TypeError:
            return F.coalesce(F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))), F.lit(""))

    row = canonical_row([cell(f) for f in sorted(df.schema.fields, key=lambda f: f.name)])
    return F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def content_digest(df: DataFrame) -> DataFrame:
    """One row: rows, and the exact sum of their hashes as text."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(_row_hash(df)), F.lit(0)).cast("string").alias("digest"))


def file_digests(df: DataFrame, root: str) -> DataFrame:
    """Rows and digest per file, by its path below `root`, of a DataFrame that reads files."""
    name = F.regexp_replace("_metadata.file_path", f"^.*\\Q{root.rstrip('/')}/\\E", "")
    return df.select(name.alias("file"), _row_hash(df).alias("h")).groupBy("file").agg(F.count("*").alias("n_rows"), F.sum("h").cast("string").alias("digest"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Artifacts whose digest differs between two builds, or that only one has. Columns: name, digest."""
    a, b = before.select("name", F.col("digest").alias("was")), after.select("name", F.col("digest").alias("now"))
    return a.join(b, "name", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
