"""Queries over the star's tables with all their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import publish, star
from sparkloom.plans.domain import VISITS_SQL, visits
from sparkloom.plans.registry import query

# order lines as events: kinds in turn, each with the columns that its table reads
_EV_SQL = f"""WITH {VISITS_SQL}, lk AS (SELECT subject_id, encounter_id, min(visit_id) AS visit_id FROM visits GROUP BY 1, 2),
ev AS (SELECT l_orderkey || '/' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS event_id, o_custkey AS person_id, l_shipdate - INTERVAL 5 HOUR AS moment,
  CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate + INTERVAL 1 DAY - INTERVAL 5 HOUR END AS till, l_linenumber AS n, l_partkey % 7 AS k, 'p' || l_partkey AS code, l_returnflag AS status, l_linestatus AS unit, l_quantity AS q, l_discount AS d, 'e' || (l_orderkey // 2) AS encounter_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 10 <> 0),
routed AS (SELECT ev.*, lk.visit_id, CASE WHEN k = 1 THEN 4000 + n::INT WHEN k = 2 AND n % 2 = 0 THEN 5001 WHEN k = 4 THEN 5002 ELSE 0 END::INT AS concept_id, CASE WHEN k = 1 THEN 'Condition' WHEN k = 2 AND n % 2 = 0 THEN 'Observation' WHEN k = 4 THEN 'Device' END AS domain_id,
  CASE k WHEN 0 THEN 'visit' WHEN 1 THEN 'condition' WHEN 2 THEN 'procedure' WHEN 3 THEN 'drug_order' WHEN 4 THEN 'measurement' WHEN 5 THEN 'drug_admin' ELSE 'observation' END AS kind
  FROM ev LEFT JOIN lk ON lk.subject_id = person_id AND lk.encounter_id = ev.encounter_id)
"""


def _events(t):
    k = F.col("l_partkey") % 7
    kind = F.element_at(F.array(*[F.lit(x) for x in ("visit", "condition", "procedure", "drug_order", "measurement", "drug_admin", "observation")]), k.cast("int") + 1)
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    day = F.make_dt_interval(F.lit(1))
    lines = t.lineitem.withColumn("nth", nth).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return lines.select(
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("nth").cast("string")).alias("event_id"), F.col("o_custkey").alias("subject_id"), kind.alias("kind"), F.lit("P").alias("code_system"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("code"),
        F.col("l_shipdate").alias("event_time"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate") + day).alias("end_time"), F.concat(F.lit("e"), (F.col("l_orderkey") / 2).cast("bigint").cast("string")).alias("encounter_id"),
        F.col("l_quantity").alias("value_number"), F.when(F.col("l_linenumber") == 3, F.lit("as told")).alias("value_text"), F.col("l_linestatus").alias("unit"), F.col("l_returnflag").alias("status"), F.array().cast("array<string>").alias("quality_flags"),
        F.when(F.col("l_linenumber") % 3 == 0, "odd dose").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" mg"))).alias("dose"), F.when(F.col("l_linenumber") == 1, F.col("l_discount")).alias("rate"), F.when(F.col("l_linenumber") == 1, "mL/h").alias("rate_unit"),
        F.col("l_returnflag").alias("discharged_to"), F.col("l_linenumber").alias("n"),
    )


def _frame(t):
    events = _events(t)
    persons = t.customer.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("subject_id"), F.col("c_custkey").alias("person_id"))
    s = t.spark
    k = F.regexp_extract("code", r"(\d+)", 1).cast("bigint") % 7
    concept = F.when(k == 1, 4000 + F.col("n")).when((k == 2) & (F.col("n") % 2 == 0), 5001).when(k == 4, 5002)
    domain = F.when(k == 1, "Condition").when((k == 2) & (F.col("n") % 2 == 0), "Observation").when(k == 4, "Device")
    events = events.withColumn("code_system", F.concat(F.lit("P"), F.col("n").cast("string")))
    terms = events.select("code_system", "code", "n").distinct().select("code_system", "code", concept.alias("concept_id"), domain.alias("domain_id"), F.lit(None).cast("bigint").alias("source_concept_id")).where("concept_id IS NOT NULL")
    lookup = publish.visit_lookup(visits(t)).withColumnRenamed("subject_id", "person_id")
    types = s.createDataFrame([("visit", 11), ("condition_problem_list", 12), ("drug_order", 13), ("drug_admin", 14), ("measurement", 15)], "key string, concept_id long")
    units, doses = s.createDataFrame([("O", 21)], "unit string, concept_id long"), publish.dose_map(events, "dose", ["mg"])
    discharge, ranges = s.createDataFrame([("R", 31)], "value string, concept_id long"), s.createDataFrame([("p4", 1.0, 9.0)], "code string, low double, high double")
    return star.joined(events, terms, persons, lookup, types, zone="Etc/GMT+5", units=units, doses=doses, discharge=discharge, ranges=ranges)


def _rows(t, table: str):
    return star.star_rows(_frame(t), table)


@query(_EV_SQL + """SELECT person_id, concept_id AS visit_concept_id, moment::DATE AS visit_start_date, moment AS visit_start_datetime, coalesce(till, moment)::DATE AS visit_end_date, coalesce(till, moment) AS visit_end_datetime, 11::INT AS visit_type_concept_id, NULL::INT AS provider_id, NULL::INT AS care_site_id,
encounter_id AS visit_source_value, 0::INT AS visit_source_concept_id, 0::INT AS admitted_from_concept_id, NULL::VARCHAR AS admitted_from_source_value, CASE status WHEN 'R' THEN 31 ELSE 0 END::INT AS discharged_to_concept_id, status AS discharged_to_source_value, NULL::INT AS preceding_visit_occurrence_id, event_id
FROM routed WHERE kind = 'visit'""")
def star_visit_occurrence(t):
    return _rows(t, "visit_occurrence")


@query(_EV_SQL + """SELECT person_id, concept_id AS condition_concept_id, moment::DATE AS condition_start_date, moment AS condition_start_datetime, till::DATE AS condition_end_date, till AS condition_end_datetime, 12::INT AS condition_type_concept_id, 0::INT AS condition_status_concept_id, NULL::VARCHAR AS stop_reason,
NULL::INT AS provider_id, visit_id AS visit_occurrence_id, NULL::INT AS visit_detail_id, code AS condition_source_value, 0::INT AS condition_source_concept_id, status AS condition_status_source_value, event_id FROM routed WHERE kind = 'condition'""")
def star_condition_occurrence(t):
    return _rows(t, "condition_occurrence")


@query(_EV_SQL + """SELECT person_id, concept_id AS drug_concept_id, moment::DATE AS drug_exposure_start_date, moment AS drug_exposure_start_datetime, coalesce(till, moment)::DATE AS drug_exposure_end_date, coalesce(till, moment) AS drug_exposure_end_datetime, NULL::DATE AS verbatim_end_date,
CASE kind WHEN 'drug_order' THEN 13 ELSE 14 END::INT AS drug_type_concept_id, NULL::VARCHAR AS stop_reason, NULL::INT AS refills, CASE WHEN n % 3 <> 0 THEN floor(q)::DOUBLE END AS quantity, NULL::INT AS days_supply,
CASE WHEN n = 1 THEN floor(q)::INT || ' mg; rate ' || d || ' mL/h' WHEN n % 3 = 0 THEN 'odd dose' END AS sig, 0::INT AS route_concept_id, NULL::VARCHAR AS lot_number, NULL::INT AS provider_id, visit_id AS visit_occurrence_id, NULL::INT AS visit_detail_id,
code AS drug_source_value, 0::INT AS drug_source_concept_id, NULL::VARCHAR AS route_source_value, CASE WHEN n % 3 <> 0 THEN 'mg' ELSE unit END AS dose_unit_source_value, event_id FROM routed WHERE kind IN ('drug_order', 'drug_admin')""")
def star_drug_exposure(t):
    return _rows(t, "drug_exposure")


@query(_EV_SQL + """SELECT person_id, concept_id AS procedure_concept_id, moment::DATE AS procedure_date, moment AS procedure_datetime, NULL::DATE AS procedure_end_date, NULL::TIMESTAMP AS procedure_end_datetime, 0::INT AS procedure_type_concept_id, 0::INT AS modifier_concept_id, NULL::INT AS quantity,
NULL::INT AS provider_id, visit_id AS visit_occurrence_id, NULL::INT AS visit_detail_id, code AS procedure_source_value, 0::INT AS procedure_source_concept_id, NULL::VARCHAR AS modifier_source_value, event_id FROM routed WHERE kind = 'procedure' AND domain_id IS NULL""")
def star_procedure_occurrence(t):
    return _rows(t, "procedure_occurrence")


@query(_EV_SQL + """SELECT person_id, concept_id AS measurement_concept_id, moment::DATE AS measurement_date, moment AS measurement_datetime, NULL::VARCHAR AS measurement_time, 15::INT AS measurement_type_concept_id, 0::INT AS operator_concept_id, q AS value_as_number, 0::INT AS value_as_concept_id,
CASE unit WHEN 'O' THEN 21 ELSE 0 END::INT AS unit_concept_id, CASE WHEN code = 'p4' THEN 1.0::DOUBLE END AS range_low, CASE WHEN code = 'p4' THEN 9.0::DOUBLE END AS range_high, NULL::INT AS provider_id, visit_id AS visit_occurrence_id, NULL::INT AS visit_detail_id, code AS measurement_source_value,
0::INT AS measurement_source_concept_id, unit AS unit_source_value, 0::INT AS unit_source_concept_id, CASE WHEN n = 3 THEN 'as told' ELSE q::VARCHAR END AS value_source_value, NULL::BIGINT AS measurement_event_id, NULL::INT AS meas_event_field_concept_id, event_id FROM routed WHERE kind = 'measurement'""")
def star_measurement(t):
    return _rows(t, "measurement")


@query(_EV_SQL + """SELECT person_id, concept_id AS observation_concept_id, moment::DATE AS observation_date, moment AS observation_datetime, 0::INT AS observation_type_concept_id, q AS value_as_number, CASE WHEN n = 3 THEN 'as told' END AS value_as_string, 0::INT AS value_as_concept_id, 0::INT AS qualifier_concept_id,
CASE unit WHEN 'O' THEN 21 ELSE 0 END::INT AS unit_concept_id, NULL::INT AS provider_id, visit_id AS visit_occurrence_id, NULL::INT AS visit_detail_id, code AS observation_source_value, 0::INT AS observation_source_concept_id, unit AS unit_source_value, NULL::VARCHAR AS qualifier_source_value,
CASE WHEN n = 3 THEN 'as told' ELSE q::VARCHAR END AS value_source_value, NULL::BIGINT AS observation_event_id, NULL::INT AS obs_event_field_concept_id, event_id FROM routed WHERE kind = 'observation' OR (kind = 'procedure' AND domain_id = 'Observation')""")
def star_observation(t):
    return _rows(t, "observation")


@query(_EV_SQL + """SELECT 'condition_occurrence' AS table_name, count(*) AS n, count(*) AS ids, max(x) AS highest FROM (SELECT row_number() OVER () AS x FROM routed WHERE kind = 'condition')""")
def star_row_ids(t):
    rows = star.numbered(_rows(t, "condition_occurrence"), "condition_occurrence")
    return rows.agg(F.lit("condition_occurrence").alias("table_name"), F.count("*").alias("n"), F.countDistinct("condition_occurrence_id").alias("ids"), F.max("condition_occurrence_id").alias("highest"))


@query("""WITH d AS (SELECT user_id AS subject_id, event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) + INTERVAL 5 HOUR ELSE ts END AS t FROM events WHERE event_type = 'error' AND value > 130),
l AS (SELECT *, t - INTERVAL 5 HOUR AS moment FROM d), g AS (SELECT subject_id, count(DISTINCT moment::DATE) AS days FROM l GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY moment = date_trunc('day', moment), t, event_id) AS n FROM l)
SELECT CASE days WHEN 1 THEN 'published' ELSE 'conflict' END AS outcome, subject_id, CASE days WHEN 1 THEN moment::DATE END AS death_date, CASE days WHEN 1 THEN moment END AS death_datetime, event_id FROM g JOIN r USING (subject_id) WHERE n = 1 AND (days > 1 OR subject_id % 10 <> 0)""")
def star_death(t):
    at = F.when(F.col("event_id") % 3 == 0, F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(5))).otherwise(F.col("ts"))
    e = t.events.where("event_type = 'error' AND value > 130").select(F.col("user_id").alias("subject_id"), "event_id", F.lit("death").alias("kind"), at.cast("timestamp_ntz").alias("event_time"))
    persons = e.select("subject_id", F.col("subject_id").alias("person_id")).distinct().where("subject_id % 10 <> 0")
    rows, conflicts = star.death_rows(e, persons, 9, zone="Etc/GMT+5")
    published = rows.select(F.lit("published").alias("outcome"), F.col("person_id").alias("subject_id"), "death_date", "death_datetime", "event_id")
    return published.unionByName(conflicts.select(F.lit("conflict").alias("outcome"), "subject_id", "event_id"), allowMissingColumns=True)


@query(_EV_SQL + """SELECT person_id AS subject_id, moment + INTERVAL 5 HOUR AS time, CASE WHEN concept_id > 0 THEN 'OMOP/' || concept_id ELSE 'SOURCE/' || kind || '/' || code END AS code, q::FLOAT AS numeric_value, moment + INTERVAL 5 HOUR + CASE WHEN n = 2 THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END AS available_time,
'r' || event_id AS source_row_ids, CASE WHEN concept_id > 0 THEN concept_id END::BIGINT AS omop_concept_id, CASE WHEN n = 2 THEN 'AVAILABILITY_ASSUMED' ELSE '' END AS quality_flags, CASE WHEN n = 3 THEN 'as told' END AS text_value, event_id, encounter_id, till + INTERVAL 5 HOUR AS end_time, kind AS source_table, code AS source_code, unit,
kind AS event_kind, CASE WHEN n % 3 = 0 THEN 'odd dose' ELSE floor(q)::INT || ' mg' END AS dose, NULL::VARCHAR AS route, status, NULL::VARCHAR AS caused_by_event_id, NULL::DOUBLE AS value_number_normalized, NULL::VARCHAR AS unit_normalized, NULL::VARCHAR AS rate_source, CASE WHEN n = 1 THEN d END AS rate,
CASE WHEN n = 1 THEN 'mL/h' END AS rate_unit, NULL::VARCHAR AS action, status AS discharged_to FROM routed""")
def event_stream_whole(t):
    k = F.regexp_extract("code", r"(\d+)", 1).cast("bigint") % 7
    concept = F.when(k == 1, 4000 + F.col("n")).when((k == 2) & (F.col("n") % 2 == 0), 5001).when(k == 4, 5002)
    e = _events(t).where("subject_id % 10 <> 0").withColumns({"code_system": F.concat(F.lit("P"), F.col("n").cast("string")), "source_id": F.col("kind")})
    e = e.withColumn("available_time", F.when(F.col("n") != 2, F.col("event_time") + F.make_dt_interval(F.lit(0), F.lit(1))))
    terms = e.select("code_system", "code", "n").distinct().select("code_system", "code", concept.alias("concept_id")).where("concept_id IS NOT NULL")
    links = e.select("event_id", F.concat(F.lit("r"), "event_id").alias("source_row_id"))
    out = publish.whole_stream(e, terms, links)
    return out.withColumns({"source_row_ids": F.array_join("source_row_ids", ","), "quality_flags": F.array_join("quality_flags", ",")})
