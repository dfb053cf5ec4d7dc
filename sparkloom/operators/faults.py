"""Known faults as changes of the layers: each must turn the checks that it names from passed to failed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.checks import Layers

FAULTS: dict[str, tuple[Callable[[Layers], Layers], tuple[str, ...]]] = {}


def fault(*expect: str):
    def register(f):
        FAULTS[f.__name__.upper()] = (f, expect)
        return f

    return register


def swap(x: Layers, **frames: DataFrame) -> Layers:
    return replace(x, frames=x.frames | frames)


def _every(column: str, n: int = 2) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)) == 0


def _twice(df: DataFrame) -> DataFrame:
    return df.union(df)


@fault("ANCHOR_NEVER_AN_EVENT_TIME", "ANCHOR_TIMES_ARE_NOT_THE_EVENT_CLOCK")
def anchor_used_as_event_time(x):
    first = x.anchors.groupBy("subject_id").agg(F.min("anchor_time").alias("__a"))
    e = x.events.join(first, "subject_id", "left").withColumn("event_time", F.coalesce("__a", "event_time")).drop("__a")
    return replace(swap(x, events=e.select(*x.events.columns)), time_aliases=(*x.time_aliases, *x.anchor_aliases))


@fault("COHORT_LABEL_NEVER_A_CLINICAL_FACT")
def cohort_label_became_a_diagnosis(x):
    return swap(x, events=x.events.withColumn("code", F.when(F.col("kind") == "condition", x.labels[0]).otherwise(F.col("code"))))


@fault("CANONICAL_SCHEMA_AS_DECLARED")
def partition_column_leaked_into_canonical(x):
    return swap(x, events=x.events.withColumn("partition_id", F.lit("p0")))


@fault("EVENT_LINEAGE_COMPLETE", "LINK_TARGETS_EXIST")
def post_death_records_deleted(x):
    return swap(x, events=x.events.where(~_every("event_id", 3)), links=x.links.where(~_every("event_id", 2)))


@fault("QUARANTINE_IS_EXPLAINED")
def quarantine_reason_erased(x):
    return swap(x, quarantine=x.quarantine.withColumn("reason", F.lit(None).cast("string")))


@fault("LINK_TARGETS_EXIST", "EVENT_LINEAGE_COMPLETE")
def lineage_links_dangle(x):
    return swap(x, links=x.links.withColumn("event_id", F.concat("event_id", F.lit("?"))))


@fault("IDENTITY_RESOLVED_ACROSS_PARTITIONS")
def identity_not_resolved_across_partitions(x):
    return swap(x, subjects=x.subjects.unionByName(x.subjects.withColumn("subject_id", F.col("subject_id") + 1_000_000)))


@fault("OMOP_REFERENTIAL_INTEGRITY")
def withheld_patient_still_published(x):
    return swap(x, persons=x.persons.where(~_every("person_id")))


@fault("OMOP_NO_FABRICATED_MEASUREMENT_DATES")
def measurement_date_fabricated(x):
    return swap(x, events=x.events.withColumn("event_time", F.when(~_every("event_id"), F.col("event_time"))))


@fault("OMOP_PRIMARY_KEYS_UNIQUE")
def primary_key_collision(x):
    return swap(x, star=_twice(x.star))


@fault("OMOP_CONCEPTS_EXIST_AND_FIT_THEIR_DOMAIN")
def concept_placed_in_the_wrong_domain(x):
    return swap(x, star=x.star.withColumn("domain_id", F.lit("elsewhere")))


@fault("OMOP_BIRTH_YEAR_IS_REPRODUCIBLE")
def birth_year_invented_under_strict_policy(x):
    return swap(x, persons=x.persons.withColumn("birth_year", F.coalesce(F.col("birth_year") + 1, F.lit(1900))))


@fault("MEDS_NO_LABEL_LEAKAGE")
def cohort_label_leaked_into_meds_events(x):
    return swap(x, stream=x.stream.withColumn(x.labels[0], F.lit(1)))


@fault("MEDS_AVAILABILITY_PREVENTS_LEAKAGE")
def availability_precedes_occurrence(x):
    return swap(x, stream=x.stream.withColumn("available_time", F.col("time") - F.make_dt_interval(F.lit(1))))


@fault("MEDS_SHARDS_CONTIGUOUS_AND_SORTED")
def shard_not_time_sorted(x):
    return swap(x, stream=x.stream.withColumn("place", -F.col("place")))


@fault("MEDS_SPLITS_DISJOINT_AND_COMPLETE")
def subject_in_two_splits(x):
    return swap(x, splits=x.splits.unionByName(x.splits.withColumn("split", F.lit("held_out"))))


@fault("MEDS_CODES_METADATA_COMPLETE")
def code_metadata_incomplete(x):
    return swap(x, codes=x.codes.where(~F.col("code").isin(x.codes.agg(F.min("code")).first()[0])))


@fault("MEDS_CONCEPTS_ARE_OMOPS")
def meds_built_without_vocabulary(x):
    return swap(x, stream=x.stream.withColumn("concept_id", F.col("concept_id") + 1))


@fault("TEXT_SOURCES_PUBLISH_THEIR_TEXT")
def note_text_silently_dropped(x):
    return swap(x, events=x.events.withColumn("value_text", F.lit(None).cast("string")))


@fault("DUPLICATES_AGREE")
def orders_with_different_doses_merged(x):
    first = x.links.agg(F.min("event_id")).first()[0]
    return swap(x, links=x.links.withColumn("event_id", F.lit(first)), source=x.source.withColumn("content", F.col("source_row_id")), events=x.events.withColumn("quality_flags", F.array().cast("array<string>")))


@fault("SOURCE_YIELDS_EVENTS")
def source_parsed_rows_and_yielded_nothing(x):
    return swap(x, events=x.events.where(F.col("source_id") != x.source.agg(F.min("source_id")).first()[0]))


@fault("UNIT_VALUE_PLAUSIBLE")
def value_in_a_different_unit_than_its_label(x):
    return swap(x, events=x.events.withColumn("value_number", F.col("value_number") * 1000 + 1000))


@fault("DOSE_UNIT_CARRIED")
def dose_unit_dropped_from_drug_rows(x):
    return swap(x, star=x.star.withColumn("dose_unit", F.lit(None).cast("string")), events=x.events.withColumn("unit", F.coalesce("unit", F.lit("mg"))))


@fault("DEATH_PUBLISHED")
def death_date_and_time_treated_as_a_conflict(x):
    return swap(x, published_deaths=x.published_deaths.where("false"))


@fault("NOTE_TEXT_UNIQUE")
def one_note_under_two_encounters(x):
    return swap(x, events=_twice(x.events.withColumn("value_text", F.when(F.col("kind") == "note", F.coalesce("value_text", F.lit("text"))))))


@fault("RAW_COVERAGE_DECLARED")
def raw_column_never_declared(x):
    return swap(x, raw=x.raw.withColumn("declared", F.lit(False)))


@fault("UNIT_KNOWN")
def diagnosis_text_read_as_a_unit(x):
    return swap(x, events=x.events.withColumn("unit", F.lit("sinus tachycardia")))


@fault("EXCLUDED_STATUS_NOT_PUBLISHED")
def excluded_status_published(x):
    return swap(x, events=x.events.withColumn("status", F.lit("Cancelled")))
