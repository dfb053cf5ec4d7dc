"""One fact from several rows: survivors, declared rules for disagreement, links and deaths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import truthy


@dataclass(frozen=True)
class Rule:
    """How a field on which rows disagree is settled: earliest, latest, null_and_flag, priority, prefer_linked, keep_all_flag."""

    name: str
    flag: str = "MERGED_BY_RULE"
    order: tuple[str, ...] = ()
    conflict_when: tuple[tuple[str, str], ...] = ()
    linked_by: str | None = None


def _aggregates(field: str, kind, rule: Rule | None, row: Column) -> dict[str, Column]:
    c = F.col(field)
    out = {
        f"{field}__first": F.min_by(c, F.when(c.isNotNull(), row)),
        f"{field}__low": F.min(c),
        f"{field}__high": F.max(c),
    }
    if rule and rule.name == "priority":
        key = F.lower(F.trim(c.cast("string")))
        place = F.array_position(F.array(*[F.lit(x.lower()) for x in rule.order]), key)
        out[f"{field}__best"] = F.min_by(c, F.when(c.isNotNull() & (place > 0), F.struct(place, row)))
        for i, (a, b) in enumerate(rule.conflict_when):
            out[f"{field}__clash{i}"] = F.bool_or(key == a.lower()) & F.bool_or(key == b.lower())
    if rule and rule.name == "prefer_linked":
        linked = F.when(truthy(F.col(rule.linked_by).cast("string")), c)
        out[f"{field}__linked_low"], out[f"{field}__linked_high"] = F.min(linked), F.max(linked)
    return out


def merge_events(rows: DataFrame, fields: list[str], rules: dict[str, Rule] | None = None, *, event_id: str = "event_id", row_id: str = "source_row_id", flags: str | None = None) -> DataFrame:
    """One row per event id: the row with the smallest source row id survives and disagreements are settled.

    Every rule is an ordinary aggregate of bounded state (min, max, min_by, bool_or), so an event with a third
    of all rows is merged by partial aggregation and nothing is collected. Nulls on the survivor are filled
    from the next row that has a value. A field with two values or more follows its rule; available_time
    without one keeps the earliest (AVAILABILITY_MERGED); others keep the survivor's value and are flagged
    MERGE_CONFLICT, with their names in `conflicts`. Flags are sorted and distinct.
    """
    rules = rules or {}
    row = F.col(row_id)
    aggregates = {"n_rows": F.count("*"), row_id: F.min(row)}
    for f in fields:
        aggregates |= _aggregates(f, rows.schema[f].dataType, rules.get(f), row)
    if flags:
        aggregates["__flags"] = F.array_distinct(F.flatten(F.collect_set(flags)))
    g = rows.groupBy(event_id).agg(*[v.alias(k) for k, v in aggregates.items()])
    none = F.array().cast("array<string>")
    say = lambda when, what: F.when(F.coalesce(when, F.lit(False)), F.array(F.lit(what))).otherwise(none)
    values, raised, conflicts = [], [F.col("__flags")] if flags else [], []
    for f in fields:
        rule, own = rules.get(f), F.col(f"{f}__first")
        differ = F.col(f"{f}__low") != F.col(f"{f}__high")
        if rule is None and f == "available_time":
            value, flag = F.col(f"{f}__low"), say(differ, "AVAILABILITY_MERGED")
        elif rule is None:
            value, flag = own, say(differ, "MERGE_CONFLICT")
            conflicts.append(F.when(F.coalesce(differ, F.lit(False)), F.lit(f)))
        elif rule.name in ("earliest", "latest"):
            value, flag = F.col(f"{f}__{'low' if rule.name == 'earliest' else 'high'}"), say(differ, rule.flag)
        elif rule.name == "null_and_flag":
            value, flag = F.when(~differ, own), say(differ, rule.flag)
        elif rule.name == "priority":
            best = F.col(f"{f}__best")
            undecided = differ & best.isNull()
            value = F.when(differ, F.coalesce(best, own)).otherwise(own)
            clash = F.lit(False)
            for i in range(len(rule.conflict_when)):
                clash = clash | F.col(f"{f}__clash{i}")
            flag = F.concat(say(differ & clash, rule.flag), say(undecided, "MERGE_CONFLICT"))
            conflicts.append(F.when(F.coalesce(undecided, F.lit(False)), F.lit(f)))
        elif rule.name == "prefer_linked":
            low, high = F.col(f"{f}__linked_low"), F.col(f"{f}__linked_high")
            one = low.isNotNull() & (low == high)
            value = F.when(differ, F.when(one, low)).otherwise(own)
            flag = F.concat(say(differ & one, "ENCOUNTER_FROM_LINKED_ROW"), say(differ & F.coalesce(~one, F.lit(True)), rule.flag))
        elif rule.name == "keep_all_flag":
            value, flag = own, say(differ, rule.flag)
        else:
            raise ValueError(f"unknown rule {rule.name}")
        values.append(value.alias(f))
        raised.append(flag)
    return g.select(event_id, row_id, "n_rows", *values, F.array_sort(F.array_distinct(F.concat(*raised))).alias("quality_flags"), F.array_compact(F.array(*conflicts) if conflicts else none).alias("conflicts"))


def conflicting_values(rows: DataFrame, field: str, event_id: str = "event_id", row_id: str = "source_row_id") -> DataFrame:
    """What null_and_flag sets aside: every row of an event on whose field rows disagree."""
    differ = rows.groupBy(event_id).agg(F.min(field).alias("__a"), F.max(field).alias("__b")).where("__a != __b").select(event_id)
    out = rows.where(F.col(field).isNotNull()).join(differ, event_id, "left_semi")
    return out.select(event_id, row_id, F.lit("VALUE_CONFLICT").alias("reason"), F.concat(F.lit(f"{field}="), F.col(field).cast("string")).alias("detail"))


def merge_links(links: DataFrame, event_id: str = "event_id", row_id: str = "source_row_id") -> DataFrame:
    """Distinct (event, row) links: the smallest row is what the event derives from, the others duplicate it.

    The smallest row comes from a combinable min that is joined back, not from a window per event.
    """
    once = links.groupBy(event_id, row_id).agg(F.min("partition_id").alias("partition_id"))
    first = once.groupBy(event_id).agg(F.min(row_id).alias("__first"))
    relation = F.when(F.col(row_id) == F.col("__first"), "derived_from").otherwise("duplicate_of")
    return once.join(first, event_id).withColumn("relation", relation).drop("__first")


def cross_partition(events: DataFrame, links: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Adds DUPLICATE_ACROSS_PARTITIONS to events whose rows lie in more than one partition."""
    spread = links.where("partition_id IS NOT NULL").groupBy(event_id).agg((F.min("partition_id") != F.max("partition_id")).alias("__spread"))
    none = F.array().cast("array<string>")
    flags = F.concat(F.coalesce("quality_flags", none), F.when(F.coalesce("__spread", F.lit(False)), F.array(F.lit("DUPLICATE_ACROSS_PARTITIONS"))).otherwise(none))
    return events.join(spread, event_id, "left").withColumn("quality_flags", F.array_sort(F.array_distinct(flags))).drop("__spread")


def merge_anchors(anchors: DataFrame, key: list[str], known: str, row_id: str) -> DataFrame:
    """One anchor per key: with a known time if any has one, then the smallest row."""
    rest = [c for c in anchors.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct((~F.coalesce(F.col(known), F.lit(False))).alias("a"), F.coalesce(row_id, F.lit("")).alias("b")))
    return anchors.groupBy(*key).agg(best.alias("__r")).select(*key, "__r.*")


def dedup_records(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the least by all columns, as text, in the order of their names."""
    names = sorted(df.columns)
    rank = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"k{i}") for i, c in enumerate(names)])
    return df.groupBy(*key).agg(F.min_by(F.struct(*[c for c in df.columns if c not in key]), rank).alias("__r")).select(*key, "__r.*")


def one_death(deaths: DataFrame, local_day: Column) -> tuple[DataFrame, DataFrame]:
    """(best death per subject, subjects with two days). A time beats a bare day, then the earlier, then the id."""
    d = deaths.withColumn("__day", local_day)
    bare = F.date_trunc("day", F.col("event_time")) == F.col("event_time")
    best = F.min_by(F.struct("event_id", "event_time"), F.struct(bare.alias("a"), F.col("event_time").alias("b"), F.col("event_id").alias("c")))
    g = d.groupBy("subject_id").agg(best.alias("r"), F.min("__day").alias("__a"), F.max("__day").alias("__b"))
    agreed = g.where("__a = __b").select("subject_id", "r.event_id", "r.event_time", F.col("__a").alias("death_date"))
    return agreed, g.where("__a != __b").select("subject_id", F.col("__a").alias("first_date"), F.col("__b").alias("last_date"))


def rewrite_links(links: DataFrame, moved: DataFrame) -> DataFrame:
    """Links of dropped events point to the one that was kept; `moved`: event_id, kept_id."""
    return links.join(moved, "event_id", "left").withColumn("event_id", F.coalesce("kept_id", "event_id")).drop("kept_id").distinct()


def flag_after_death(events: DataFrame, deaths: DataFrame, days: int = 1) -> DataFrame:
    """Adds after_death: the event is later than the subject's first death plus `days`."""
    first = deaths.groupBy("subject_id").agg(F.min("event_time").alias("__d"))
    late = F.col("event_time") > F.col("__d") + F.make_dt_interval(F.lit(days))
    return events.join(first, "subject_id", "left").withColumn("after_death", F.coalesce(late, F.lit(False))).drop("__d")


def survivors(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row per key by a window; for keys whose groups are known to be small."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
