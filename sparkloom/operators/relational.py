"""Joins, aggregations, windows and set operations with declared tie-breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.storage import cut, fresh


# filters and projections -------------------------------------------------------------------------


def keep_or_drop(df: DataFrame, column: str, *, keep: Sequence[str] | None = None, drop: Sequence[str] | None = None) -> DataFrame:
    """Rows whose case-folded cell is (not) in a list; null counts as empty, an unknown column raises."""
    if (keep is None) == (drop is None):
        raise ValueError("name either what to keep or what to drop")
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    cell = F.lower(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))))
    inside = cell.isin(*[x.strip().lower() for x in (keep if keep is not None else drop)])
    return df.where(inside if keep is not None else ~inside)


def switch(cell: Column, cases: dict[str, str], default: str) -> Column:
    """Value of a case-folded cell's case, else the default."""
    if not cases:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for k, v in cases.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(F.coalesce(cell, F.lit(""))))), F.lit(default))


def add_flag(flags: Column, when: Column, name: str) -> Column:
    """Sorted distinct flags with one more where the condition holds."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(flags, none), F.when(F.coalesce(when, F.lit(False)), F.array(F.lit(name))).otherwise(none))))


def split_codes(df: DataFrame, columns: Sequence[str], separator: str = ",") -> DataFrame:
    """One row per piece of the cells that hold several codes; shorter lists repeat their last piece."""
    pieces = {c: F.filter(F.transform(F.split(F.col(c), f"\\Q{separator}\\E"), lambda p: F.trim(p)), lambda p: p != "") for c in columns}
    several = {c: F.coalesce(F.size(p) > 1, F.lit(False)) for c, p in pieces.items()}
    width = F.greatest(F.lit(1), F.lit(1), *[F.when(several[c], F.size(pieces[c])).otherwise(1) for c in columns])
    out = df.withColumn("piece", F.explode(F.sequence(F.lit(1), width)))
    new = {c: F.when(several[c], F.element_at(pieces[c], F.least(F.col("piece"), F.size(pieces[c])))).otherwise(F.col(c)) for c in columns}
    return out.withColumns(new)


def as_of(df: DataFrame, moment: Column, subject: Column | None = None) -> DataFrame:
    """What was visible at a moment: availability is unknown or not later."""
    seen = F.col("available_time").isNull() | (F.col("available_time") <= moment)
    return df.where(seen if subject is None else seen & (F.col("subject_id") == subject))


# joins -------------------------------------------------------------------------------------------


def containment_match(details: DataFrame, spans: DataFrame, subject: str, at: str, start: str, end: str, span_id: str, detail_id: str) -> DataFrame:
    """Best span around each detail: of the subject's spans that hold its time, the one that starts last, then
    ends first, then has the lowest id. An equi join on the subject with the range as residual condition, then
    one `min_by`, which combines before its shuffle; details without a span are left out."""
    s = spans.select(F.col(subject).alias("__s"), F.col(start).alias("__a"), F.col(end).alias("__b"), F.col(span_id).alias("__id"))
    inside = (F.col(at) >= F.col("__a")) & (F.col("__b").isNull() | (F.col(at) <= F.col("__b")))
    rank = F.struct((-F.unix_micros(F.col("__a").cast("timestamp"))).alias("late"), F.coalesce(F.unix_micros(F.col("__b").cast("timestamp")), F.lit(2**62)).alias("short"), F.col("__id").alias("low"))
    found = details.join(s, (F.col(subject) == F.col("__s")) & inside)
    return found.groupBy(detail_id).agg(F.min_by("__id", rank).alias(span_id))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join in which null meets null; `right`'s keys are dropped."""
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(r, on, how).drop(*[f"__{k}" for k in keys])


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that cannot add rows: a key that is not unique on the right raises when the plan runs."""
    counted = right.groupBy(*keys).agg(*[F.first(c).alias(c) for c in right.columns if c not in keys], F.count("*").alias("__n"))
    safe = counted.where(F.assert_true(F.col("__n") == 1, F.lit("the lookup key is not unique")).isNull()).drop("__n")
    return left.join(safe, list(keys), "left")


def resolve_causes(events: DataFrame, declares: str, caused_by: str, event_id: str = "event_id") -> DataFrame:
    """Adds cause_id: the first event, by id, that declares the key this event names; never the event itself."""
    first = events.where(F.col(declares).isNotNull()).groupBy(F.col(declares).alias(caused_by)).agg(F.min(event_id).alias("__c"))
    out = events.join(first, caused_by, "left")
    return out.withColumn("cause_id", F.when(F.col("__c") != F.col(event_id), F.col("__c"))).drop("__c")


# aggregates --------------------------------------------------------------------------------------


def representative(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Commonest name per key, the first in order on ties: counts combine first, one row per (key, name) is ranked."""
    counts = df.where(F.col(name).isNotNull()).groupBy(*by, name).agg(F.count("*").alias("__n"))
    return counts.groupBy(*by).agg(F.min_by(name, F.struct((-F.col("__n")).alias("n"), F.col(name).alias("v"))).alias(name), F.sum("__n").alias("n"))


def best_tier(df: DataFrame, key: str, tier: str, name: str) -> DataFrame:
    """Per key the name of the lowest tier, alphabetically first, with the number of distinct names."""
    return df.groupBy(key).agg(F.min_by(name, F.struct(tier, name)).alias(name), F.min(tier).alias(tier), F.countDistinct(name).alias("candidates"))


def narrative(df: DataFrame, by: Sequence[str], line: str, text: str) -> DataFrame:
    """Text of a report from its lines: repeated lines once, in order, blank reports null."""
    lines = F.array_sort(F.collect_set(F.struct(F.col(line).alias("line"), F.col(text).alias("text"))))
    joined = F.array_join(F.transform(lines, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return df.groupBy(*by).agg(F.nullif(joined, F.lit("")).alias("text"), F.size(lines).alias("n_lines"))


def link_rate(events: DataFrame, visits: DataFrame, by: str) -> DataFrame:
    """Share of events per source whose encounter is a visit of the same subject."""
    known = visits.select("subject_id", "encounter_id").distinct().withColumn("__k", F.lit(1))
    out = events.where(F.col("encounter_id").isNotNull()).join(known, ["subject_id", "encounter_id"], "left")
    return out.groupBy(by).agg(F.count("*").alias("events"), F.count("__k").alias("linked"), (F.count("__k") / F.count("*")).alias("link_rate"))


def fingerprint(df: DataFrame, columns: Sequence[str], shape) -> DataFrame:
    """Per column: nulls, distinct values and the commonest masked shape, in one pass over the rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])
    long = df.select(F.explode(cells).alias("c")).select("c.name", "c.v")
    per_value = long.groupBy("name", "v").agg(F.count("*").alias("n"))
    shapes = per_value.groupBy("name", shape(F.col("v")).alias("shape")).agg(F.sum("n").alias("n"), F.count("v").alias("kinds"))
    rank = F.struct((-F.col("n")).alias("n"), F.col("shape").alias("s"))
    return shapes.groupBy("name").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("shape").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.sum("kinds").alias("n_distinct"), F.min_by("shape", F.when(F.col("shape").isNotNull(), rank)).alias("top_shape"))


# windows -----------------------------------------------------------------------------------------


def running_sum(df: DataFrame, order: Sequence[str], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """Adds the sum of `value` over the rows up to each one, in a total order, without a single-partition window: rows are
    range-partitioned and summed within their partition, and at most `partitions` sums give each its offset.

    The ranged rows are written once: they are read twice, for the offsets and for the rows, and a range partitioning
    that is computed twice may draw other bounds. Ties are ordered by a hash of the row, so many rows with one key
    spread as well.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, own, ahead = fresh(df, "part", "own", "ahead")
    keys = [*[F.col(c) for c in order], F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])]
    ranged = cut(df.withColumn(own, value).repartitionByRange(n, *keys).withColumn(part, F.spark_partition_id()))
    sums = ranged.groupBy(part).agg(F.sum(own).alias(ahead))
    before = sums.select(part, (F.sum(ahead).over(Window.orderBy(part)) - F.col(ahead)).alias(ahead))
    so_far = F.sum(own).over(Window.partitionBy(part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(own, so_far).join(F.broadcast(before), part).withColumn(name, F.col(ahead) + F.col(own)).select(*[c for c in df.columns if c != name], name)


def surrogate_keys(df: DataFrame, order: Sequence[str], name: str = "id", partitions: int | None = None) -> DataFrame:
    """Dense numbers from 1 in a total order, by `running_sum`."""
    return running_sum(df, order, F.lit(1).cast("bigint"), name, partitions)


def competing_targets(df: DataFrame, key: str, target: str) -> DataFrame:
    """Adds the number of distinct targets of each key."""
    return df.withColumn("n_targets", F.size(F.collect_set(target).over(Window.partitionBy(key))))


def out_of_order(df: DataFrame, shard: str, position: str, subject: str, at: str) -> DataFrame:
    """Per shard: rows earlier than the row before them of the same subject, and subjects that come back."""
    w = Window.partitionBy(shard).orderBy(position)
    step = df.withColumn("__s", F.lag(subject).over(w)).withColumn("__t", F.lag(at).over(w))
    starts = (F.col("__s").isNull() | (F.col("__s") != F.col(subject))).cast("int")
    return step.groupBy(shard).agg(F.count_if((F.col("__s") == F.col(subject)) & (F.col(at) < F.col("__t"))).alias("backwards"), (F.sum(starts) - F.countDistinct(subject)).alias("split_subjects"))


# sets --------------------------------------------------------------------------------------------


def difference_both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of either side that the other lacks, with the side they are on."""
    return a.distinct().join(b, a.columns, "left_anti").withColumn("side", F.lit("left")).unionByName(b.distinct().join(a, b.columns, "left_anti").withColumn("side", F.lit("right")))


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per filled cell: ids, name, value."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*ids, F.explode(cells).alias("c")).select(*ids, "c.name", "c.value").where(F.coalesce(F.trim("value"), F.lit("")) != "")


def split_pair(df: DataFrame, cell: str, names: tuple[str, str], separator: str = "/") -> DataFrame:
    """A cell like `120/80` as two rows of name and value; cells without both numbers give none."""
    pattern = rf"^\s*(\d+(?:\.\d+)?)\s*{separator}\s*(\d+(?:\.\d+)?)\s*$"
    pair = F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_extract(F.col(cell), pattern, i + 1).cast("double").alias("value")) for i, n in enumerate(names)])
    keep = [c for c in df.columns if c != cell]
    return df.where(F.col(cell).rlike(pattern)).select(*keep, F.explode(pair).alias("p")).select(*keep, "p.name", "p.value")


def topk_dense(queries: DataFrame, items: DataFrame, k: int, block: int = 256) -> DataFrame:
    """The k items nearest to each query by cosine, ties by id. The stated queries are packed into rows of about
    `block`; every item meets every such row once, and only the best k per query and partition leave a task.

    Columns: query_id, vector / item_id, vector. Rows: query_id, item_id, cosine, rank. A vector that is null, zero
    or not finite, or of another length, has no cosine with anything and is in no row.
    """
    def unit(v: Column) -> Column:
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y))
        return F.when((size > 0) & (size < float("inf")), F.transform(v, lambda x: F.try_divide(x, size)))

    q = queries.select("query_id", unit(F.col("vector").cast("array<double>")).alias("v")).where("v IS NOT NULL")
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // block))))).groupBy("block").agg(F.collect_list(F.struct("query_id", "v")).alias("qs"))
    i = items.select("item_id", unit(F.col("vector").cast("array<double>")).alias("u")).where("u IS NOT NULL")
    pairs = i.crossJoin(q.select("qs")).select("item_id", "u", F.explode("qs").alias("q")).where(F.size("u") == F.size("q.v"))
    dot = F.aggregate(F.zip_with("u", "q.v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select(F.col("q.query_id").alias("query_id"), "item_id", F.round(dot, 9).alias("cosine"))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "item_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# samples and profiles ----------------------------------------------------------------------------


def every_nth(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Every n-th row in a total order, numbered without a single-partition window."""
    return surrogate_keys(df, order, "__k").where(F.col("__k") % n == 0).drop("__k")


def of_top_codes(df: DataFrame, code: str, n: int) -> DataFrame:
    """The rows of the n commonest codes; ties by code. The list has n rows, so joining it back may broadcast."""
    top = df.groupBy(code).agg(F.count("*").alias("code_rows")).orderBy(F.desc("code_rows"), code).limit(n)
    return df.join(F.broadcast(top), code)


def column_profile(df: DataFrame, columns: Sequence[str], safe: str = r"^[A-Za-z0-9#_ .\-/]{1,20}$", samples: int = 3) -> DataFrame:
    """Per column: filled cells, distinct values, and the first few values that are safe to show."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])
    values = df.select(F.explode(cells).alias("c")).select("c.name", "c.v").groupBy("name", "v").agg(F.count("*").alias("n"))
    shown = values.where(F.col("v").rlike(safe)).withColumn("__i", F.row_number().over(Window.partitionBy("name").orderBy("v"))).where(F.col("__i") <= samples)
    shown = shown.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("samples"))
    counts = values.groupBy("name").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("filled"), F.count("v").alias("kinds"))
    return counts.join(shown, "name", "left")


def mark_linked(df: DataFrame, known: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Adds linked: whether the keys occur in any of the given frames."""
    every = None
    for k in known:
        every = k.select(*keys) if every is None else every.unionByName(k.select(*keys))
    return df.join(every.distinct().withColumn("__l", F.lit(True)), list(keys), "left").withColumn("linked", F.coalesce("__l", F.lit(False))).drop("__l")
