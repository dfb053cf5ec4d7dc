"""Publication of events as a relational star and as an ordered event stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.hashing import split_name
from sparkloom.functions.text import normalize_term
from sparkloom.functions.values import parse_value
from sparkloom.operators.relational import representative, surrogate_keys

#: Kinds of the star's fact tables and the vocabulary domain that each of them holds.
ROUTES = {
    "condition_occurrence": (("condition",), "Condition"),
    "drug_exposure": (("drug_order", "drug_admin"), "Drug"),
    "procedure_occurrence": (("procedure",), "Procedure"),
    "measurement": (("measurement",), "Measurement"),
    "observation": (("observation",), "Observation"),
}


def routes_here(kind: Column, domain: Column, table: str) -> Column:
    """Whether an event goes to a table: its concept's domain says so; without a routable domain, its kind does."""
    kinds, own = ROUTES[table]
    routable = domain.isin(*[d for _, d in ROUTES.values()])
    by_domain = F.coalesce(routable & (domain == own), F.lit(False))
    by_kind = kind.isin(*kinds) & ~F.coalesce(routable, F.lit(False))
    return by_domain | by_kind


def publishable(events: DataFrame, persons: DataFrame, excluded_flags: Sequence[str] = ("NOT_ADMINISTERED", "EXCLUDED_STATUS")) -> DataFrame:
    """Events of published persons without a flag that keeps them back."""
    held = F.arrays_overlap("quality_flags", F.array(*[F.lit(x) for x in excluded_flags]))
    return events.where(~F.coalesce(held, F.lit(False))).join(persons.select("subject_id"), "subject_id", "left_semi")


def fact_rows(events: DataFrame, terms: DataFrame, table: str) -> DataFrame:
    """Rows of one fact table; several concepts of one term give several rows."""
    joined = events.join(terms.select("code_system", "code", "concept_id", "domain_id"), ["code_system", "code"], "left")
    return joined.where(routes_here(F.col("kind"), F.col("domain_id"), table)).withColumn("concept_id", F.coalesce("concept_id", F.lit(0)))


def lineage(rows: DataFrame, links: DataFrame, table: str) -> DataFrame:
    return rows.select("event_id").distinct().join(links, "event_id").select(F.lit(table).alias("table_name"), "event_id", "source_row_id", "relation")


def value_text(text: Column, low: Column, high: Column, number: Column) -> Column:
    ends = F.when(low.isNotNull() & high.isNotNull(), F.concat_ws("-", low.cast("string"), high.cast("string")))
    return F.coalesce(text, ends, number.cast("string"))


def note_rows(events: DataFrame, persons: DataFrame, lookup: DataFrame, types: dict[str, int], zone: str | None = None) -> DataFrame:
    """Notes of published persons with their text as it stands; date and time by the clock of `zone`.

    `persons`: subject_id, person_id; `lookup`: person_id, encounter_id, visit_id. A null text is empty. Notes are
    named by their event; dense numbers come from `relational.surrogate_keys`, where they are wanted.
    """
    local = F.col("event_time") if zone is None else F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("event_time").cast("timestamp_ntz"))
    notes = events.where("kind = 'note'").join(persons.select("subject_id", "person_id"), "subject_id")
    notes = notes.join(lookup.select("person_id", "encounter_id", "visit_id"), ["person_id", "encounter_id"], "left")
    return notes.select(
        "event_id", "person_id", local.cast("date").alias("note_date"), local.alias("note_datetime"),
        F.lit(types.get("note", 0)).alias("note_type_concept_id"), F.lit(types.get("note_class", 0)).alias("note_class_concept_id"),
        F.substring("name", 1, 250).alias("note_title"), F.coalesce("value_text", F.lit("")).alias("note_text"),
        F.col("visit_id").alias("visit_occurrence_id"), F.substring("code", 1, 50).alias("note_source_value"),
    )


def dose_map(doses: DataFrame, column: str, known_units: Sequence[str] | None = None, limit: float = 1e15) -> DataFrame:
    """(dose, quantity, dose_unit) of the distinct doses: what `parse_value` reads. A number too large for the target
    column is no quantity, and neither is one whose words are no known unit; the text is kept whole by the caller."""
    p = parse_value(F.col("dose"), known_units=known_units)
    out = doses.select(F.col(column).alias("dose")).where("dose IS NOT NULL").distinct().withColumn("p", p)
    return out.select("dose", F.when(F.abs("p.number") < limit, F.col("p.number")).alias("quantity"), F.col("p.unit").alias("dose_unit"))


def approved_map(values: DataFrame, system: str, column: str, registry: DataFrame, concepts: DataFrame) -> DataFrame:
    """(value, concept_id) of the distinct values: the approved mapping of (system, normalised value), if the
    vocabulary has that concept, else 0. `registry`: code_system, term_key, concept_id."""
    distinct = values.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    known = registry.where(F.col("code_system") == system).join(concepts.select("concept_id"), "concept_id", "left_semi")
    hit = distinct.withColumn("term_key", normalize_term(F.col("value"))).join(known.select("term_key", "concept_id"), "term_key", "left")
    return hit.select("value", F.coalesce("concept_id", F.lit(0)).cast("bigint").alias("concept_id"))


def attribute_map(values: DataFrame, registry: DataFrame, concepts: DataFrame, domains: dict[str, str]) -> DataFrame:
    """(attribute, value, concept_id) of the distinct values of demographic attributes: the approved mapping, else the
    valid standard concept of the attribute's domain with exactly that name, in any case, else 0; the lowest id on ties.

    `values`: attribute, value; `domains`: attribute -> domain, in upper case.
    """
    distinct = values.select(F.upper("attribute").alias("attribute"), "value").where("value IS NOT NULL").distinct()
    distinct = distinct.withColumn("domain_id", _of(F.col("attribute"), domains)).where("domain_id IS NOT NULL").withColumn("term_key", normalize_term(F.col("value")))
    approved = registry.select(F.col("code_system").alias("attribute"), "term_key", F.col("concept_id").alias("approved"))
    named = concepts.where("standard_concept = 'S' AND valid").groupBy("domain_id", F.lower("concept_name").alias("folded")).agg(F.min("concept_id").alias("named"))
    out = distinct.join(approved, ["attribute", "term_key"], "left").withColumn("folded", F.lower("value")).join(named, ["domain_id", "folded"], "left")
    return out.select("attribute", "value", F.coalesce("approved", "named", F.lit(0)).cast("bigint").alias("concept_id"))


def _of(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


#: Keys under which the registry has the type concepts of the star's tables (fixed values).
TYPE_KEYS = (
    "visit", "condition_problem_list", "drug_order", "drug_admin", "procedure", "measurement", "note", "note_class",
    "death", "observation", "observation_period", "visit_detail",
)


def type_concepts(spark, registry: DataFrame) -> DataFrame:
    """(key, concept_id) of the type concepts; 0 where the registry has none."""
    keys = spark.createDataFrame([(k,) for k in TYPE_KEYS], "key string").withColumn("term_key", normalize_term(F.col("key")))
    found = registry.where("code_system = 'TYPE_CONCEPT'").select("term_key", "concept_id")
    return keys.join(found, "term_key", "left").select("key", F.coalesce("concept_id", F.lit(0)).cast("bigint").alias("concept_id"))


def bounded_quantity(number: Column, limit: float = 1e15) -> Column:
    return F.when(F.abs(number) < limit, number).cast("decimal(18,3)")


def person_rows(attributes: DataFrame, codes: Sequence[str], year_code: str) -> tuple[DataFrame, DataFrame]:
    """(one row per subject with a column per attribute, subjects with several birth years). One aggregation."""
    year = F.when(F.col("code") == year_code, F.col("value_text"))
    g = attributes.groupBy("subject_id").agg(*[F.min(F.when(F.col("code") == c, F.col("value_text"))).alias(c) for c in codes], F.min(year).alias("__a"), F.max(year).alias("__b"))
    agreed = F.coalesce(F.col("__a") == F.col("__b"), F.lit(True))
    return g.where(agreed).drop("__a", "__b"), g.where(~agreed).select("subject_id")


def observation_period(events: DataFrame, excluded: str = "AFTER_DEATH") -> DataFrame:
    """First and last day of each subject over events without the excluded flag, by UTC date."""
    kept = events.where(F.col("event_time").isNotNull() & ~F.coalesce(F.array_contains("quality_flags", excluded), F.lit(False)))
    return kept.groupBy("subject_id").agg(F.min("event_time").cast("date").alias("start_date"), F.max(F.greatest("event_time", F.coalesce("end_time", "event_time"))).cast("date").alias("end_date"))


def visit_lookup(visits: DataFrame) -> DataFrame:
    return visits.groupBy("subject_id", "encounter_id").agg(F.min("visit_id").alias("visit_id"))


def visit_parents(details: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(detail, visit) by encounter, else by containment; (details without parent, which are withheld)."""
    from sparkloom.operators.relational import containment_match

    by_encounter = details.join(visit_lookup(visits), ["subject_id", "encounter_id"]).select("detail_id", "visit_id", F.lit("encounter").alias("rule"))
    rest = details.join(by_encounter, "detail_id", "left_anti")
    inside = containment_match(rest, visits, "subject_id", "start_time", "start_time", "end_time", "visit_id", "detail_id").select("detail_id", "visit_id", F.lit("containment").alias("rule"))
    found = by_encounter.union(inside)
    return found, details.join(found, "detail_id", "left_anti").select("detail_id", F.lit("NO_PARENT_VISIT").alias("issue"))


def event_code(kind: Column, concept: Column, system: Column, code: Column, death: str = "MEDS_DEATH") -> Column:
    own = F.concat_ws("/", F.lit("SOURCE"), system, code)
    return F.when(kind == "death", death).when(F.coalesce(concept, F.lit(0)) > 0, F.concat(F.lit("OMOP/"), concept.cast("string"))).otherwise(own)


def stream_rows(events: DataFrame, terms: DataFrame, links: DataFrame) -> DataFrame:
    """The event stream: coded rows with their sorted source rows. Links collapse before they meet the events."""
    rows = links.groupBy("event_id").agg(F.array_sort(F.collect_set("source_row_id")).alias("source_row_ids"))
    best = terms.groupBy("code_system", "code").agg(F.min("concept_id").alias("concept_id"))
    out = events.join(best, ["code_system", "code"], "left").join(rows, "event_id", "left")
    late = F.when(F.col("concept_id").isNull() & (F.col("kind") != "death"), F.array(F.lit("UNMAPPED"))).otherwise(F.array().cast("array<string>"))
    flags = F.array_sort(F.array_distinct(F.concat(F.coalesce("quality_flags", F.array().cast("array<string>")), late)))
    return out.select("subject_id", F.col("event_time").alias("time"), event_code(F.col("kind"), F.col("concept_id"), F.col("code_system"), F.col("code")).alias("code"), F.col("value_number").cast("float").alias("numeric_value"), "available_time", "event_id", flags.alias("quality_flags"), "source_row_ids")


#: Columns of the whole stream beside the coded ones: name, column of the events, type; what the events lack is null.
STREAM = (
    ("text_value", "value_text", "string"), ("event_id", "event_id", "string"), ("encounter_id", "encounter_id", "string"), ("end_time", "end_time", "timestamp_ntz"), ("source_table", "source_id", "string"),
    ("source_code", "code", "string"), ("unit", "unit", "string"), ("event_kind", "kind", "string"), ("dose", "dose", "string"), ("route", "route", "string"), ("status", "status", "string"),
    ("caused_by_event_id", "cause_id", "string"), ("value_number_normalized", "value_normalized", "double"), ("unit_normalized", "unit_normalized", "string"), ("rate_source", "rate_source", "string"), ("rate", "rate", "double"),
    ("rate_unit", "rate_unit", "string"), ("action", "action", "string"), ("discharged_to", "discharged_to", "string"),
)


def whole_stream(events: DataFrame, terms: DataFrame, links: DataFrame, death: str = "MEDS_DEATH") -> DataFrame:
    """The event stream with all its 27 columns; `write_stream` puts it in order.

    A fact has one code: the reserved one of a death, the mapped concept, else the source's term under its name. An
    event without a known availability was available when it happened, which a flag says. `terms` has one row per term.
    """
    rows = links.groupBy("event_id").agg(F.array_sort(F.collect_list("source_row_id")).alias("source_row_ids"))
    e = events.join(terms.select("code_system", "code", "concept_id"), ["code_system", "code"], "left").join(rows, "event_id", "left")
    own = F.concat_ws("/", F.lit("SOURCE"), F.coalesce("source_id", F.lit("unknown")), F.coalesce(F.nullif(normalize_term(F.col("code")), F.lit("")), F.lit("unspecified")))
    code = F.when(F.col("kind") == "death", death).when(F.col("concept_id").isNotNull(), F.concat(F.lit("OMOP/"), F.col("concept_id").cast("string"))).otherwise(own)
    none = F.array().cast("array<string>")
    assumed = F.when(F.col("available_time").isNull() & F.col("event_time").isNotNull(), F.array(F.lit("AVAILABILITY_ASSUMED"))).otherwise(none)
    others = [(F.col(c) if c in events.columns else F.lit(None)).cast(kind).alias(name) for name, c, kind in STREAM]
    return e.select(
        "subject_id", F.col("event_time").alias("time"), code.alias("code"), F.col("value_number").cast("float").alias("numeric_value"), F.coalesce("available_time", "event_time").alias("available_time"),
        F.coalesce("source_row_ids", none).alias("source_row_ids"), F.col("concept_id").cast("bigint").alias("omop_concept_id"), F.array_sort(F.array_union(F.coalesce("quality_flags", none), assumed)).alias("quality_flags"), *others,
    )


def code_metadata(stream: DataFrame, names: DataFrame) -> DataFrame:
    """Per code in use: rows, and its commonest source name. `names`: event_id, name."""
    used = stream.groupBy("code").agg(F.count("*").alias("n_events"))
    described = representative(stream.select("event_id", "code").join(names, "event_id"), ["code"], "name").select("code", F.col("name").alias("description"))
    return used.join(described, "code", "left")


def subject_splits(subjects: DataFrame, weights: Sequence[tuple[str, float]] = (("train", 0.8), ("tuning", 0.1), ("held_out", 0.1)), salt: str = "") -> DataFrame:
    return subjects.select("subject_id", split_name(F.col("subject_id"), weights, salt).alias("split"))


def subject_shards(splits: DataFrame, per_shard: int) -> DataFrame:
    """Shard number of each subject: so many whole subjects per shard and split, in the order of their numbers.

    Subjects are numbered over all splits by ranges; a split's first number, of which there are as many as splits,
    gives the number within it.
    """
    numbered = surrogate_keys(splits, ["split", "subject_id"], "nth")
    first = numbered.groupBy("split").agg(F.min("nth").alias("first"))
    shard = F.floor((F.col("nth") - F.col("first")) / per_shard).cast("int")
    return numbered.join(F.broadcast(first), "split").select(*splits.columns, shard.alias("shard"))


def write_stream(stream: DataFrame, shards: DataFrame, path: str) -> None:
    """One folder per split and shard; a subject's rows stay together, in order of time (unknown first) and code."""
    rows = stream.join(shards, "subject_id")
    order = ["subject_id", F.asc_nulls_first("time"), "code", "event_id"]
    rows.repartition("split", "shard").sortWithinPartitions("split", "shard", *order).write.mode("overwrite").partitionBy("split", "shard").option("compression", "zstd").parquet(path)


def refuse_unmapped_build(star_vocabulary: str | None, stream_vocabulary: str | None) -> None:
    """A stream without vocabulary must not stand beside a star that was mapped with one."""
    if star_vocabulary and not stream_vocabulary:
        raise ValueError(f"the star was built with vocabulary {star_vocabulary}; the stream has none")


def unit_concepts(units: DataFrame, mapping: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concept of each unit: an approved mapping, else the concept with the unit's code; only of domain Unit."""
    known = concepts.where("domain_id = 'Unit'").select("concept_id", "concept_code")
    approved = mapping.join(known.select("concept_id"), "concept_id", "left_semi").select("unit", F.col("concept_id").alias("__m"))
    by_code = known.groupBy(F.col("concept_code").alias("ucum")).agg(F.min("concept_id").alias("__c"))
    return units.select("unit", "ucum").distinct().join(approved, "unit", "left").join(by_code, "ucum", "left").select("unit", F.coalesce("__m", "__c", F.lit(0)).alias("concept_id"))


def audit(records: DataFrame, persons: DataFrame) -> DataFrame:
    """Audit rows with the person they became, null where the subject was withheld."""
    return records.join(persons.select("subject_id", "person_id"), "subject_id", "left")


def source_description(spark, name: str, release: str, built) -> DataFrame:
    """The one row that says what was converted and when."""
    return spark.createDataFrame([(name, release, built)], "source_name string, source_release string, built_on date")
