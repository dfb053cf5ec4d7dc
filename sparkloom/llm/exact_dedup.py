"""Exact deduplication by skew-safe combining of full contents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import SPACE, cut, fresh, hashable

SALTS = 64


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _rank(chars: Column, doc_id: Column) -> Column:
    """One number that is largest for the row that stays: most code points, then smallest id, null id last.

    A decimal fits a hash aggregate's fixed buffer; a struct or a string would turn it into a sort.
    """
    return (chars.cast("decimal(12,0)") * _whole(2**65)).cast("decimal(38,0)") + F.coalesce(_whole(2**63) - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(38,0)"))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest=None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Contents are equal when identical without ASCII white space. Three combining steps, each of which groups
    by digest *and* full content: (1) Spark's map-side partial aggregate merges copies within a task before
    anything moves, (2) the shuffle groups by (digest, content, salt of the id), so a group with a third of
    all rows is spread over up to 64 tasks, (3) at most 64 salt winners per content meet in the global step.
    What goes back to the rows is the winner under (digest, salt): the content is not shuffled again. Should
    two contents ever share a digest, the rows of that digest are matched by content instead.

    Null text counts as empty. A null id is last in ties; keep_id is null only where no longer text or other
    id beats it. Of rows that repeat one doc_id with equal content, one is `kept`. An empty table gives no
    rows; further columns are ignored. `digest` (a function of the normalised text) may be replaced in tests.
    """
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        normalised(F.col(text_col)).alias("norm"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"),
    )
    base = base.withColumn("digest", (digest or (lambda c: F.sha2(c, 256)))(F.col("norm")))
    base = base.withColumn("sha", F.sha2("norm", 256) if digest else F.col("digest"))
    base = base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    salted = base.groupBy("digest", "norm", "salt").agg(F.max(_rank(F.col("chars"), F.col("doc_id"))).alias("rank"), F.count("*").alias("n"))
    whole = salted.groupBy("digest", "norm").agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))).alias("salts"))
    low = F.col("rank") % _whole(2**65)
    whole = whole.withColumn("keep_id", F.when(low == 0, None).otherwise((_whole(2**63) - low).cast("long")))
    winners = cut(whole.select("digest", "group_size", "salts", "keep_id"))
    clashing = winners.groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1").select("digest")
    keys, clash = ["digest", "salt"], bool(clashing.take(1))
    if clash:  # the content itself is part of the key
        keys, winners = ["digest", "norm", "salt"], whole.select("digest", "norm", "group_size", "salts", "keep_id")
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit(F.col("salts"), s) == 1)
    spread = winners.withColumn("salt", F.explode(salts)).select(*keys, "group_size", "keep_id")
    out = base.select("doc_id", *keys, "sha", "chars").join(spread, keys)
    first = F.row_number().over(Window.partitionBy(*keys, "doc_id").orderBy(F.desc("chars"))) == 1
    return out.select("doc_id", "keep_id", "group_size", (first & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their columns: one row of each group of equal contents.

    It is the row that `exact_groups` keeps: most code points, then the smallest id, a null id last. Of rows that
    repeat that id with equal content the one with the longest original stays, further ties fall to the least
    hash of the row; which of wholly equal rows stays can't be told. Contents are compared in full here too. Null
    text is empty; an empty table gives no rows; columns may have any name.
    """
    keep, sha, nth = fresh(docs, "keep", "sha", "nth")
    kept = exact_groups(docs, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(sha))
    content = normalised(F.col(text_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(keep)) & (F.sha2(content, 256) == F.col(sha))
    found = docs.join(kept, same, "left_semi")
    # a limit of one row per window is applied before the shuffle as well, so rows that repeat an id stay apart
    w = Window.partitionBy(F.col(id_col).cast("long"), F.sha2(content, 256), content)
    w = w.orderBy(F.desc(F.char_length(F.coalesce(F.col(text_col), F.lit("")))), F.xxhash64(*hashable(docs)))
    return found.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)
