"""Source rows to events: the five shapes, anchors, identity and quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.hashing import canonical_cell, stable_id, subject_id
from sparkloom.functions.times import plus_days, resolve_times
from sparkloom.functions.values import parse_value


def event_identity(df: DataFrame, columns: Sequence[str], prefix: str = "event:") -> Column:
    """Identity of a fact: what it says, never where or how often it was written."""
    return stable_id([canonical_cell(F.col(c), df.schema[c].dataType) for c in columns], prefix)


def point_event(rows: DataFrame, *, subject: str, kind: Column, code: str, time: str, value: str, unit: str | None = None, available: str | None = None, body: str | None = None, extras: Sequence[str] = ()) -> DataFrame:
    """One event per row; a body text takes the value's place."""
    t = resolve_times(F.col(time), F.lit(0), F.col(available) if available else F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"))
    v = parse_value(F.col(value).cast("string"), F.col(unit) if unit else None)
    out = rows.select(F.col(subject).alias("subject_id"), kind.alias("kind"), F.col(code).alias("code"), t.alias("t"), v.alias("v"), (F.col(body) if body else F.lit(None).cast("string")).alias("body"), *extras)
    flags = F.array_sort(F.array_distinct(F.concat(F.col("t.flags"), F.array_compact(F.array("v.flag")))))
    out = out.select("subject_id", "kind", "code", "t.event_time", "t.available_time", F.when(F.col("body").isNull(), F.col("v.number")).alias("value_number"), F.coalesce("body", "v.text").alias("value_text"), F.col("v.unit").alias("unit"), flags.alias("quality_flags"), *extras)
    return out.withColumn("event_id", event_identity(out, ["subject_id", "kind", "code", "event_time", "value_number", "value_text", "unit", *extras]))


def component_measurements(rows: DataFrame, *, group: Sequence[str], component: str, value: str) -> DataFrame:
    """A study event per group and an event per component that points to it."""
    keyed = rows.withColumn("parent_id", stable_id([canonical_cell(F.col(c), rows.schema[c].dataType) for c in group], "study:"))
    studies = keyed.groupBy("parent_id", *group).agg(F.count("*").alias("n")).select(F.col("parent_id").alias("event_id"), F.lit(None).cast("string").alias("parent_event_id"), *group, F.lit("study").alias("kind"), F.lit(None).cast("string").alias("component"), F.col("n").cast("double").alias("value"))
    own = stable_id([F.col("parent_id"), canonical_cell(F.col(component)), canonical_cell(F.col(value), rows.schema[value].dataType)], "component:")
    parts = keyed.select(own.alias("event_id"), F.col("parent_id").alias("parent_event_id"), *group, F.lit("component").alias("kind"), F.col(component).cast("string").alias("component"), F.col(value).cast("double").alias("value"))
    return studies.unionByName(parts.distinct())


def person_attributes(rows: DataFrame, subject: str, attributes: Sequence[str]) -> DataFrame:
    """An untimed event per filled attribute of a person row."""
    cells = F.array(*[F.struct(F.lit(a).alias("code"), F.col(a).cast("string").alias("value_text")) for a in attributes])
    return rows.select(F.col(subject).alias("subject_id"), F.explode(cells).alias("c")).select("subject_id", "c.code", "c.value_text").where("value_text IS NOT NULL")


def visits(rows: DataFrame, *, subject: str, encounter: str, start: str, end: str | None = None, stay_days: str | None = None) -> DataFrame:
    """Stays with their end, derived from the length of stay where none is written (flagged)."""
    derived = plus_days(F.col(start), F.col(stay_days)) if stay_days else F.lit(None).cast("timestamp_ntz")
    written = F.col(end) if end else F.lit(None).cast("timestamp_ntz")
    stop = F.coalesce(written, derived)
    flags = F.array_compact(F.array(F.when(written.isNull() & derived.isNotNull(), "DERIVED_END_TIME"), F.when(stop < F.col(start), "END_BEFORE_START")))
    return rows.select(F.col(subject).alias("subject_id"), F.col(encounter).alias("encounter_id"), F.col(start).alias("start_time"), stop.alias("end_time"), F.array_sort(flags).alias("quality_flags"))


def action_keys(events: DataFrame, declares: Column, caused_by: Column) -> DataFrame:
    """(event_id, role, key) of what events declare and what they name as their cause."""
    both = F.array(F.struct(F.lit("declares").alias("role"), declares.alias("key")), F.struct(F.lit("caused_by").alias("role"), caused_by.alias("key")))
    return events.select("event_id", F.explode(both).alias("k")).select("event_id", "k.role", "k.key").where("key IS NOT NULL")


def quarantine_untimed(events: DataFrame, untimed_kinds: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(timed events, refused ones): only the named kinds may lack a time."""
    ok = F.col("event_time").isNotNull() | F.col("kind").isin(*untimed_kinds)
    return events.where(ok), events.where(~ok).select("event_id", F.lit("canonical").alias("stage"), F.lit("MISSING_EVENT_TIME").alias("reason"))


def resolve_identity(rows: DataFrame, key: str, partition: str, dataset: str, salt: str = "") -> DataFrame:
    """Subject map: person_source_id, subject_id, partitions (sorted, distinct); the partitions of a dataset are few."""
    keyed = rows.where(F.trim(F.col(key).cast("string")) != "").select(F.trim(F.col(key).cast("string")).alias("person_source_id"), F.col(partition).cast("string").alias("p"))
    out = keyed.groupBy("person_source_id").agg(F.array_sort(F.collect_set("p")).alias("partitions"))
    return out.select("person_source_id", subject_id(F.lit(dataset), F.col("person_source_id"), salt).alias("subject_id"), "partitions")


def identity_collisions(subjects: DataFrame) -> DataFrame:
    return subjects.groupBy("subject_id").agg(F.count("*").alias("keys")).where("keys > 1")


def partition_overlap(subjects: DataFrame) -> DataFrame:
    return subjects.select(F.explode("partitions").alias("partition_id")).groupBy("partition_id").agg(F.count("*").alias("subjects"))


def trace(subject: DataFrame, events: DataFrame, links: DataFrame) -> DataFrame:
    """Every event of the given subjects with the source rows behind it."""
    return events.join(subject.select("subject_id"), "subject_id", "left_semi").join(links, "event_id", "left")


def birth_events(rows: DataFrame, subject: str, born: str) -> DataFrame:
    """An untimed birth event per subject and date; its id ignores the date, so two dates are a disagreement."""
    out = rows.where(F.col(born).isNotNull()).select(F.col(subject).alias("subject_id"), F.lit("birth").alias("kind"), F.col(born).cast("string").alias("value_text"))
    return out.withColumn("event_id", event_identity(out, ["subject_id", "kind"], "birth:"))


def death_events(rows: DataFrame, subject: str, at: str) -> DataFrame:
    """A death per subject and time; its id leaves the source out, so that sources share it."""
    out = rows.where(F.col(at).isNotNull()).select(F.col(subject).alias("subject_id"), F.lit("death").alias("kind"), F.col(at).alias("event_time"))
    return out.withColumn("event_id", event_identity(out, ["subject_id", "kind", "event_time"], "death:"))


def vital_status(rows: DataFrame, subject: str, status: str, dead: Sequence[str], timed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(redundant, quarantined) statements that a subject is dead: redundant if its death has a time, else refused."""
    said = rows.where(F.lower(F.trim(F.col(status))).isin(*dead)).select(F.col(subject).alias("subject_id")).distinct()
    known = timed.select("subject_id").distinct()
    return said.join(known, "subject_id", "left_semi"), said.join(known, "subject_id", "left_anti").withColumn("reason", F.lit("DEATH_WITHOUT_TIME"))


def coverage(declared: DataFrame, manifest: DataFrame) -> DataFrame:
    """State of every declared (partition_id, source_id): present, empty or not_extracted."""
    j = declared.join(manifest.select("partition_id", "source_id", "read"), ["partition_id", "source_id"], "left")
    state = F.when(F.col("read").isNull(), "not_extracted").when(F.col("read") == 0, "empty").otherwise("present")
    return j.select("partition_id", "source_id", state.alias("state"))
