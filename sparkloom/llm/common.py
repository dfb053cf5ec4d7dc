"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.storage import cut, ensure_checkpoint_dir, fresh, released  # noqa: F401

#: Java/RE2/Python pattern of one word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashable(df: DataFrame) -> list[Column]:
    """The columns of `df` that a hash can read (maps and variants can't be hashed)."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def blocks_for(df: DataFrame, text_col: str = "text", block_mb: float = 16.0) -> int:
    """How many blocks of about `block_mb` MB of text `df` makes: memory per task stays the same at any input size.

    Input that makes few of them is cut into up to 16 smaller ones, so that more tasks have work.
    """
    chars = df.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit("")))).alias("n")).first()["n"] or 0
    return max(4, min(16, int(chars / 2e6)), int(chars / (block_mb * 1e6)) + 1)


def salted_join(rows: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join on `key`, which is unique in `small` and may be that of a third of `rows`: these are dealt to `salts` tasks by `spread`."""
    salt = fresh(rows, "salt")[0]
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(copies, [key, salt], how).drop(salt)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph; component is the smallest node reachable.

    `edges` holds columns u, v of an orderable type. Alternates large-star and small-star steps, each a
    combinable min per node and a join; the stars converge in a number of rounds logarithmic in the graph's
    size. Every round is written to the checkpoint folder, so a lost executor costs one round. Nodes that
    have no edge are not returned. Null ends are ignored; an empty input gives an empty result.
    """
    current = cut(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
                  .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    signature = None
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node points to the least of its smaller neighbours, which all point there too
        down = large.where(F.col("v") < F.col("u"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        current = cut(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        row = released(current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))).collect()[0]
        if signature == tuple(row):
            break
        signature = tuple(row)
    else:
        raise RuntimeError("the components did not converge")
    members = current.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return members.union(current.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
