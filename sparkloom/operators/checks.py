"""Data-quality checks over what was published. A check is one row: check_id, passed, skipped, metric."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.units import family
from sparkloom.operators.relational import difference_both_ways, out_of_order, representative

CHECKS: dict[str, Callable[[Layers], DataFrame]] = {}

#: Shares and counts that decide (fixed values).
MAX_QUARANTINE, MIN_UNITS, MIN_LINKS, MIN_MAPPED, MAX_SECOND_FAMILY = 0.05, 0.95, 0.95, 0.10, 0.01


@dataclass
class Layers:
    """The frames that checks read; a check whose frames are missing is skipped, which is not a pass.

    inputs(file_sha256, read, parsed, quarantined) source(source_row_id, partition_id, source_id, status, text)
    quarantine(source_row_id, source_id, stage, reason) subjects(person_source_id, subject_id)
    events(event_id, source_id, subject_id, kind, code_system, code, name, event_time, available_time, end_time,
    value_number, value_text, unit, encounter_id, quality_flags, concept_id, in_stream) links(event_id, source_row_id,
    partition_id, relation) anchors(subject_id, anchor_code, anchor_time) membership(subject_id, label, partition_id)
    persons(person_id, birth_year, source_year) star(table_name, row_id, event_id, person_id, concept_id, domain_id, visit_id, start_date)
    lineage(row_id, event_id) visits(visit_id, person_id, encounter_id) concepts(concept_id, domain_id) deaths(subject_id, death_date)
    published_deaths(subject_id) stream(subject_id, time, available_time, code, event_id, source_row_ids, shard, place, concept_id)
    codes(code, description) splits(subject_id, split) queue(term, status) units(spelling) ranges(code, low, high) coverage(source_id, state)
    raw(column, declared) kinds(source_id, kind).
    """

    frames: dict[str, DataFrame]
    labels: tuple[str, ...] = ()
    anchor_aliases: tuple[str, ...] = ()
    time_aliases: tuple[str, ...] = ()
    event_columns: tuple[str, ...] = ()
    stream_types: dict[str, str] = field(default_factory=dict)
    untimed_codes: tuple[str, ...] = ()
    text_sources: tuple[str, ...] = ()
    excluded_status: tuple[str, ...] = ()
    strict_birth: bool = True

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["frames"][name]
        except KeyError:
            raise AttributeError(name) from None


def check(f: Callable[[Layers], DataFrame]):
    CHECKS[f.__name__.upper()] = f
    return f


def run(layers: Layers, names: list[str] | None = None) -> DataFrame:
    """All checks as one DataFrame, a lazy union of one-row aggregates; nothing is collected between them."""
    out = None
    for name in names or CHECKS:
        try:
            row = CHECKS[name](layers)
        except AttributeError:
            spark = next(iter(layers.frames.values())).sparkSession
            row = spark.range(1).select(F.lit(False).alias("passed"), F.lit(True).alias("skipped"), F.lit(None).cast("double").alias("metric"))
        row = row.select(F.lit(name).alias("check_id"), "passed", "skipped", F.col("metric").cast("double").alias("metric"))
        out = row if out is None else out.union(row)
    return out


def _none(bad: DataFrame, most: float = 0) -> DataFrame:
    """Passes while no more than `most` rows are bad; the metric is their number."""
    return bad.agg(F.count("*").alias("metric")).select((F.col("metric") <= most).alias("passed"), F.lit(False).alias("skipped"), "metric")


def _share(rows: DataFrame, good: Column, least: float | None = None, most: float | None = None, enough: int = 1) -> DataFrame:
    """Passes if the share of good rows is inside the bounds; skipped with fewer rows than `enough`."""
    g = rows.agg(F.count("*").alias("n"), F.avg(F.coalesce(good, F.lit(False)).cast("double")).alias("metric"))
    ok = (F.col("metric") >= least) if least is not None else (F.col("metric") <= most)
    return g.select((F.coalesce(ok, F.lit(False)) & (F.col("n") >= enough)).alias("passed"), (F.col("n") < enough).alias("skipped"), "metric")


def _report(rows: DataFrame, metric: Column) -> DataFrame:
    return rows.agg(metric.alias("metric")).select(F.lit(True).alias("passed"), F.lit(False).alias("skipped"), "metric")


def _fact(layers: Layers, passed: bool, metric: float) -> DataFrame:
    spark = next(iter(layers.frames.values())).sparkSession
    return spark.range(1).select(F.lit(passed).alias("passed"), F.lit(False).alias("skipped"), F.lit(float(metric)).alias("metric"))


def _flagged(name: str) -> Column:
    return F.coalesce(F.array_contains("quality_flags", name), F.lit(False))


# inputs and lineage


@check
def input_manifest_complete(x):
    return _none(x.inputs.where("file_sha256 IS NULL OR length(file_sha256) <> 64"))


@check
def reconciliation_rows(x):
    return _none(x.inputs.where("read <> parsed + quarantined"))


@check
def source_coverage_reported(x):
    return _none(x.source.select("source_id").distinct().join(x.coverage.where("state IN ('present', 'empty', 'not_extracted')"), "source_id", "left_anti"))


@check
def event_lineage_complete(x):
    return _none(x.events.join(x.links, "event_id", "left_anti"))


@check
def link_targets_exist(x):
    return _none(x.links.join(x.events, "event_id", "left_anti"))


@check
def fan_out_and_dedup(x):
    return _report(x.links.groupBy("event_id").agg(F.count("*").alias("n")), F.count_if(F.col("n") > 1))


@check
def source_rows_accounted(x):
    accounted = x.links.select("source_row_id").union(x.quarantine.select("source_row_id")).distinct()
    twice = x.quarantine.select("source_row_id").distinct().join(x.links, "source_row_id", "left_semi")
    lost = x.source.select("source_row_id").distinct().join(accounted, "source_row_id", "left_anti")
    return _none(twice.union(lost))


@check
def quarantine_is_explained(x):
    return _none(x.quarantine.where("reason IS NULL OR trim(reason) = '' OR stage IS NULL"))


# events


@check
def anchor_never_an_event_time(x):
    both = set(x.anchor_aliases) & set(x.time_aliases)
    return _fact(x, not both, len(both))


@check
def canonical_schema_as_declared(x):
    odd = set(x.events.columns) ^ set(x.event_columns)
    return _fact(x, not odd, len(odd))


@check
def event_subjects_were_issued_by_identity(x):
    return _none(x.events.select("subject_id").distinct().join(x.subjects, "subject_id", "left_anti"))


@check
def anchor_times_are_not_the_event_clock(x):
    """A subject with eight events or more whose times all are anchor times was extracted around anchors."""
    times = x.events.where("event_time IS NOT NULL").select("subject_id", "event_time", "event_id")
    own = x.anchors.select("subject_id", F.col("anchor_time").alias("event_time")).distinct().withColumn("hit", F.lit(1))
    g = times.join(own, ["subject_id", "event_time"], "left").groupBy("subject_id").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    return _none(g.where("n >= 8 AND k = n"))


@check
def anchors_are_not_events(x):
    return _none(x.events.join(x.anchors.select(F.col("anchor_code").alias("code")).distinct(), "code", "left_semi"))


@check
def cohort_label_never_a_clinical_fact(x):
    return _none(x.events.where(F.lower("code").isin(*x.labels) | F.lower("value_text").isin(*x.labels)))


@check
def membership_kept_per_partition(x):
    return _report(x.membership.groupBy("subject_id").agg(F.countDistinct("label").alias("n")), F.count_if(F.col("n") > 1))


@check
def no_untimed_clinical_events(x):
    return _none(x.events.where(F.col("event_time").isNull() & ~F.col("code").isin(*x.untimed_codes)))


@check
def orders_and_administrations_stay_separate(x):
    return _none(x.events.where("kind = 'drug_order'").select("event_id").join(x.events.where("kind = 'drug_admin'"), "event_id", "left_semi"))


@check
def event_kind_is_one_its_source_declares(x):
    return _none(x.events.join(x.kinds, ["source_id", "kind"], "left_anti"))


@check
def text_sources_publish_their_text(x):
    g = x.events.where(F.col("source_id").isin(*x.text_sources)).groupBy("source_id").agg(F.count("value_text").alias("n"))
    return _none(g.where("n = 0"))


@check
def only_administrations_become_drug_exposure(x):
    return _none(x.star.where("table_name = 'drug_exposure'").join(x.events.where(_flagged("NOT_ADMINISTERED")), "event_id", "left_semi"))


@check
def post_death_records_flagged_not_deleted(x):
    late = x.events.join(x.deaths, "subject_id").where(F.col("event_time").cast("date") > F.date_add("death_date", 1))
    return _none(late.where(~_flagged("AFTER_DEATH")))


@check
def end_time_never_precedes_start(x):
    return _none(x.events.where((F.col("end_time") < F.col("event_time")) & ~_flagged("END_BEFORE_START")))


@check
def identity_resolved_across_partitions(x):
    g = x.subjects.groupBy("subject_id").agg(F.count("*").alias("n")).where("n > 1").select("n")
    return _none(g.union(x.subjects.groupBy("person_source_id").agg(F.count("*").alias("n")).where("n > 1").select("n")))


# star


@check
def omop_every_row_has_lineage(x):
    return _none(x.star.join(x.lineage, ["table_name", "row_id"], "left_anti"))


@check
def omop_concepts_exist_and_fit_their_domain(x):
    j = x.star.where("concept_id <> 0").join(x.concepts.select("concept_id", F.col("domain_id").alias("own")), "concept_id", "left")
    return _none(j.where(F.col("own").isNull() | (F.col("own") != F.col("domain_id"))))


@check
def terminology_coverage_plausible(x):
    codes = x.star.groupBy("event_code").agg(F.max("concept_id").alias("c"))
    return _share(codes, F.col("c") > 0, least=MIN_MAPPED, enough=100)


@check
def omop_referential_integrity(x):
    a = x.star.join(x.persons, "person_id", "left_anti").select("row_id")
    b = x.star.where("visit_id IS NOT NULL").join(x.visits.select("visit_id"), "visit_id", "left_anti").select("row_id")
    return _none(a.union(b))


@check
def omop_primary_keys_unique(x):
    return _none(x.star.groupBy("table_name", "row_id").agg(F.count("*").alias("n")).where("n > 1"))


@check
def omop_birth_year_is_reproducible(x):
    return _none(x.persons.where("birth_year IS NOT NULL AND NOT birth_year <=> source_year"))


@check
def omop_birth_policy_enforced(x):
    return _none(x.persons.where("birth_year IS NULL") if x.strict_birth else x.persons.where("false"))


@check
def omop_no_fabricated_measurement_dates(x):
    dated = x.star.where("start_date IS NOT NULL")
    return _none(dated.join(x.events.where("event_time IS NULL"), "event_id", "left_semi"))


@check
def death_published(x):
    days = x.deaths.groupBy("subject_id").agg(F.countDistinct("death_date").alias("n"))
    return _none(days.where("n = 1").join(x.published_deaths, "subject_id", "left_anti").select("subject_id").union(x.published_deaths.join(days.where("n > 1"), "subject_id", "left_semi").select("subject_id")))


# stream


@check
def meds_schema_valid(x):
    have = {f.name: f.dataType.simpleString() for f in x.stream.schema.fields}
    odd = [n for n, kind in x.stream_types.items() if have.get(n) != kind]
    return _fact(x, not odd, len(odd))


@check
def meds_shards_contiguous_and_sorted(x):
    return _none(out_of_order(x.stream, "shard", "place", "subject_id", "time").where("backwards > 0 OR split_subjects > 0"))


@check
def meds_lineage_complete(x):
    return _none(x.stream.where("source_row_ids IS NULL OR size(source_row_ids) = 0"))


@check
def meds_no_label_leakage(x):
    named = [c for c in x.stream.columns if c.lower() in x.labels]
    return _none(x.stream.where(F.lower("code").isin(*x.labels) | F.lit(bool(named))))


@check
def meds_codes_metadata_complete(x):
    return _none(difference_both_ways(x.stream.select("code").distinct(), x.codes.select("code")))


@check
def meds_concepts_are_omops(x):
    star = x.star.where("concept_id > 0").select("event_id", "concept_id").distinct().withColumn("in_star", F.lit(1))
    mapped = x.stream.where("concept_id > 0").select("event_id", "concept_id")
    return _none(mapped.join(star.select("event_id").distinct(), "event_id", "left_semi").join(star, ["event_id", "concept_id"], "left_anti"))


@check
def meds_splits_disjoint_and_complete(x):
    several = x.splits.groupBy("subject_id").agg(F.countDistinct("split").alias("n")).where("n > 1").select("subject_id")
    return _none(several.union(x.stream.select("subject_id").distinct().join(x.splits, "subject_id", "left_anti")))


@check
def meds_availability_prevents_leakage(x):
    return _none(x.stream.where("time IS NOT NULL AND (available_time IS NULL OR available_time < time)"))


@check
def undecided_proposals_never_published(x):
    return _none(x.star.where("concept_id > 0").join(x.queue.where("status = 'open'").select(F.col("term").alias("event_code")), "event_code", "left_semi"))


# sources, units, notes


@check
def duplicates_agree(x):
    merged = x.links.join(x.source.select("source_row_id", "content"), "source_row_id").groupBy("event_id").agg(F.min("content").alias("a"), F.max("content").alias("b"))
    ruled = x.events.where(F.exists("quality_flags", lambda f: f.startswith("MERGE")) | _flagged("VALUES_DIFFER")).select("event_id")
    return _none(merged.where("a <> b").join(ruled, "event_id", "left_anti"))


@check
def source_yields_events(x):
    return _none(x.source.select("source_id").distinct().join(x.events, "source_id", "left_anti"))


@check
def quarantine_share_declared(x):
    bad = x.quarantine.groupBy("source_id").agg(F.count("*").alias("q"))
    g = x.source.groupBy("source_id").agg(F.count("*").alias("n")).join(bad, "source_id", "left")
    return _none(g.where(F.coalesce("q", F.lit(0)) / F.col("n") > MAX_QUARANTINE))


@check
def unit_concept_coverage(x):
    known = x.units.select(F.col("spelling").alias("unit")).distinct().withColumn("k", F.lit(True))
    return _share(x.events.where("unit IS NOT NULL").join(known, "unit", "left"), F.col("k"), least=MIN_UNITS)


@check
def unit_known(x):
    odd = x.events.where("unit IS NOT NULL").join(x.units.select(F.col("spelling").alias("unit")), "unit", "left_anti")
    return _none(odd.where(~_flagged("UNIT_UNKNOWN")))


@check
def unit_value_plausible(x):
    j = x.events.join(x.ranges, "code")
    return _none(j.where(((F.col("value_number") < F.col("low")) | (F.col("value_number") > F.col("high"))) & ~_flagged("IMPLAUSIBLE")))


@check
def unit_homogeneous_per_code(x):
    """The second commonest unit family of a code has at most one in a hundred of its rows."""
    g = x.events.where("unit IS NOT NULL").groupBy("code", "unit").agg(F.count("*").alias("n"))
    g = g.groupBy("code", family(F.col("unit")).alias("family")).agg(F.sum("n").alias("n"))
    counts = g.groupBy("code").agg(F.sum("n").alias("all"), F.sort_array(F.collect_list("n"), asc=False).alias("falling"))  # one number a family
    return _none(counts.where(F.coalesce(F.get("falling", F.lit(1)), F.lit(0)) / F.col("all") > MAX_SECOND_FAMILY))


@check
def dose_unit_carried(x):
    said = x.events.where("kind IN ('drug_admin', 'drug_order') AND unit IS NOT NULL").select("event_id", "unit")
    return _none(x.star.where("table_name = 'drug_exposure'").join(said, "event_id").where("NOT dose_unit <=> unit"))


@check
def visit_concept_coverage(x):
    return _share(x.visits, F.col("visit_concept_id") > 0, least=MIN_UNITS)


@check
def note_text_unique(x):
    g = x.events.where("kind = 'note'").groupBy("source_id", "subject_id", F.col("event_time").cast("date").alias("d"), F.sha2("value_text", 256).alias("h")).agg(F.count("*").alias("n"))
    return _none(g.where("n > 1"))


@check
def encounter_resolves(x):
    known = x.visits.select(F.col("person_id").alias("subject_id"), "encounter_id").distinct().withColumn("k", F.lit(True))
    return _share(x.events.where("encounter_id IS NOT NULL").join(known, ["subject_id", "encounter_id"], "left"), F.col("k"), least=MIN_LINKS)


@check
def code_description_is_representative(x):
    best = representative(x.stream.select("event_id", "code").join(x.events.select("event_id", "name"), "event_id"), ["code"], "name").select("code", F.col("name").alias("best"))
    return _none(x.codes.join(best, "code", "left").where("NOT description <=> best"))


@check
def raw_coverage_declared(x):
    return _none(x.raw.where("NOT declared"))


@check
def excluded_status_not_published(x):
    held = x.events.where(F.lower("status").isin(*x.excluded_status))
    return _none(x.star.join(held, "event_id", "left_semi"))
