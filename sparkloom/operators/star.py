"""Rows of the star's tables with all their columns: one joined frame, and one list of expressions for each table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.publish import ROUTES, bounded_quantity, publishable, routes_here
from sparkloom.operators.relational import surrogate_keys

#: Column = expression over the joined frame, by table; a name alone stands for itself. Names are those of the data model.
TABLES = {
    "visit_occurrence": """
        person_id; visit_concept_id = concept_id; visit_start_date = date(start_at); visit_start_datetime = start_at; visit_end_date = date(end_at); visit_end_datetime = end_at;
        visit_type_concept_id = type_id; provider_id = int(NULL); care_site_id = int(NULL); visit_source_value = left(encounter_id, 50); visit_source_concept_id = source_concept_id;
        admitted_from_concept_id = 0; admitted_from_source_value = string(NULL); discharged_to_concept_id = discharged_concept_id; discharged_to_source_value = left(discharged_to, 50);
        preceding_visit_occurrence_id = int(NULL)""",
    "condition_occurrence": """
        person_id; condition_concept_id = concept_id; condition_start_date = date(start_at); condition_start_datetime = start_at; condition_end_date = date(closed_at); condition_end_datetime = closed_at;
        condition_type_concept_id = type_id; condition_status_concept_id = 0; stop_reason = string(NULL); provider_id = int(NULL); visit_occurrence_id = visit_id; visit_detail_id = int(NULL);
        condition_source_value = left(code, 50); condition_source_concept_id = source_concept_id; condition_status_source_value = left(status, 50)""",
    "drug_exposure": """
        person_id; drug_concept_id = concept_id; drug_exposure_start_date = date(start_at); drug_exposure_start_datetime = start_at; drug_exposure_end_date = date(end_at); drug_exposure_end_datetime = end_at;
        verbatim_end_date = date(NULL); drug_type_concept_id = type_id; stop_reason = string(NULL); refills = int(NULL); quantity; days_supply = int(NULL); sig; route_concept_id = 0; lot_number = string(NULL);
        provider_id = int(NULL); visit_occurrence_id = visit_id; visit_detail_id = int(NULL); drug_source_value = left(code, 50); drug_source_concept_id = source_concept_id;
        route_source_value = left(route, 50); dose_unit_source_value = left(coalesce(dose_unit, unit), 50)""",
    "procedure_occurrence": """
        person_id; procedure_concept_id = concept_id; procedure_date = date(start_at); procedure_datetime = start_at; procedure_end_date = date(NULL); procedure_end_datetime = CAST(NULL AS TIMESTAMP_NTZ);
        procedure_type_concept_id = type_id; modifier_concept_id = 0; quantity = int(NULL); provider_id = int(NULL); visit_occurrence_id = visit_id; visit_detail_id = int(NULL);
        procedure_source_value = left(code, 50); procedure_source_concept_id = source_concept_id; modifier_source_value = string(NULL)""",
    "measurement": """
        person_id; measurement_concept_id = concept_id; measurement_date = date(start_at); measurement_datetime = start_at; measurement_time = string(NULL); measurement_type_concept_id = type_id;
        operator_concept_id = 0; value_as_number = value_number; value_as_concept_id = 0; unit_concept_id; range_low; range_high; provider_id = int(NULL); visit_occurrence_id = visit_id;
        visit_detail_id = int(NULL); measurement_source_value = left(code, 50); measurement_source_concept_id = source_concept_id; unit_source_value = left(unit, 50); unit_source_concept_id = 0;
        value_source_value = left(coalesce(value_text, string(value_low) || '-' || string(value_high), string(value_number)), 50); measurement_event_id = bigint(NULL); meas_event_field_concept_id = int(NULL)""",
    "observation": """
        person_id; observation_concept_id = concept_id; observation_date = date(start_at); observation_datetime = start_at; observation_type_concept_id = type_id; value_as_number = value_number;
        value_as_string = left(value_text, 60); value_as_concept_id = 0; qualifier_concept_id = 0; unit_concept_id; provider_id = int(NULL); visit_occurrence_id = visit_id; visit_detail_id = int(NULL);
        observation_source_value = left(code, 50); observation_source_concept_id = source_concept_id; unit_source_value = left(unit, 50); qualifier_source_value = string(NULL);
        value_source_value = left(coalesce(value_text, string(value_number)), 50); observation_event_id = bigint(NULL); obs_event_field_concept_id = int(NULL)""",
}
#: Columns of events that a source may lack, and their types.
OPTIONAL = {
    "encounter_id": "string", "end_time": "timestamp_ntz", "value_number": "double", "value_text": "string", "value_low": "double", "value_high": "double", "unit": "string", "dose": "string", "rate": "double",
    "rate_source": "string", "rate_unit": "string", "route": "string", "status": "string", "discharged_to": "string", "range_low": "double", "range_high": "double",
}
TYPES = {"visit": "visit", "condition": "condition_problem_list"}  # kinds whose type concept has another key


def joined(events: DataFrame, terms: DataFrame, persons: DataFrame, lookup: DataFrame, types: DataFrame, *, zone: str | None = None, units: DataFrame | None = None, doses: DataFrame | None = None, discharge: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """Events of published persons with what the star's tables take from elsewhere; the small tables' joins broadcast by size.

    `terms`: code_system, code, concept_id, domain_id, source_concept_id; `persons`: subject_id, person_id; `lookup`:
    person_id, encounter_id, visit_id; `types`: key, concept_id; `units`: unit, concept_id; `doses`: dose, quantity, dose_unit;
    `discharge`: value, concept_id; `ranges`: code, low, high, for codes whose rows state no range of their own.
    """
    spark = events.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)
    e = publishable(events, persons).withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in events.columns})
    e = e.join(persons.select("subject_id", "person_id"), "subject_id")
    e = e.join(terms.select("code_system", "code", "concept_id", "domain_id", "source_concept_id"), ["code_system", "code"], "left")
    e = e.join(lookup.select("person_id", "encounter_id", "visit_id"), ["person_id", "encounter_id"], "left")
    key = F.col("kind")
    for kind, name in TYPES.items():
        key = F.when(F.col("kind") == kind, name).otherwise(key)
    e = e.withColumn("key", key).join(types.select("key", F.col("concept_id").alias("type_id")), "key", "left")
    e = e.join((units or none("unit string, concept_id bigint")).select("unit", F.col("concept_id").alias("unit_concept_id")), "unit", "left")
    e = e.join((doses or none("dose string, quantity double, dose_unit string")).select("dose", "quantity", "dose_unit"), "dose", "left")
    e = e.join((discharge or none("value string, concept_id bigint")).select(F.col("value").alias("discharged_to"), F.col("concept_id").alias("discharged_concept_id")), "discharged_to", "left")
    e = e.join((ranges or none("code string, low double, high double")).select("code", F.col("low").alias("usual_low"), F.col("high").alias("usual_high")), "code", "left")
    local = lambda c: c if zone is None else F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz"))
    whole = {c: F.coalesce(c, F.lit(0)).cast("int") for c in ("concept_id", "source_concept_id", "type_id", "unit_concept_id", "discharged_concept_id")}
    rate = F.concat(F.lit("rate "), F.concat_ws(" ", F.coalesce("rate_source", F.col("rate").cast("string")), "rate_unit"))
    rated = F.col("rate").isNotNull() | F.col("rate_source").isNotNull()
    return e.withColumns(whole).withColumns({
        "start_at": local(F.col("event_time")), "end_at": local(F.coalesce("end_time", "event_time")), "closed_at": local(F.col("end_time")), "quantity": bounded_quantity(F.col("quantity")).cast("double"),
        "sig": F.left(F.when(rated, F.concat_ws("; ", "dose", rate)).when(F.col("quantity").isNull(), F.col("dose")), F.lit(250)),
        "range_low": F.coalesce("range_low", "usual_low"), "range_high": F.coalesce("range_high", "usual_high"),
    })


def star_rows(frame: DataFrame, table: str) -> DataFrame:
    """Rows of one table from `joined`, with event_id, by which the lineage is told; several concepts give several rows."""
    here = F.col("kind") == "visit" if table == "visit_occurrence" else routes_here(F.col("kind"), F.col("domain_id"), table)
    if table == "observation":
        here = here & F.col("event_time").isNotNull()
    pairs = [(p.split("=", 1) if "=" in p else (p, p)) for p in TABLES[table].split(";")]
    return frame.where(here).selectExpr(*[f"{value.strip()} AS {name.strip()}" for name, value in pairs], "event_id")


def numbered(rows: DataFrame, table: str) -> DataFrame:
    """Adds the table's own id, dense from 1 in the order of event and concept."""
    concept = next(c for c in rows.columns if c.endswith("_concept_id"))
    return surrogate_keys(rows, ["event_id", concept], f"{table}_id")


def death_rows(events: DataFrame, persons: DataFrame, type_id: int = 0, zone: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per person whose sources agree on the day by the clock of `zone`, conflicting subjects).

    Of the events of the agreed day the most precise counts: one with a time of day before one at midnight, then the
    earliest, then the lowest id. One aggregation with `min_by`; nobody's deaths are collected.
    """
    local = F.col("event_time") if zone is None else F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("event_time").cast("timestamp_ntz"))
    told = events.where("kind = 'death' AND event_time IS NOT NULL").withColumn("at", local)
    rank = F.struct((F.date_trunc("day", "at") == F.col("at")).alias("midnight"), F.col("event_time"), F.col("event_id"))
    g = told.groupBy("subject_id").agg(F.min(F.to_date("at")).alias("low"), F.max(F.to_date("at")).alias("high"), F.min_by(F.struct("at", "event_id"), rank).alias("best"))
    agreed = g.where("low = high").join(persons.select("subject_id", "person_id"), "subject_id")
    rows = agreed.select("person_id", F.col("low").alias("death_date"), F.col("best.at").alias("death_datetime"), F.lit(type_id).alias("death_type_concept_id"), F.lit(0).alias("cause_concept_id"), F.lit(None).cast("string").alias("cause_source_value"), F.lit(0).alias("cause_source_concept_id"), F.col("best.event_id").alias("event_id"))
    return rows, g.where("low <> high").select("subject_id", F.lit("DEATH_DATE_CONFLICT").alias("issue"), F.col("best.event_id").alias("event_id"))


def star(frame: DataFrame) -> dict[str, DataFrame]:
    """All tables of `TABLES`, numbered."""
    return {t: numbered(star_rows(frame, t), t) for t in ("visit_occurrence", *ROUTES)}
