"""A clean build made of the customers, the checks that pass on it, and the faults that each turn their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sparkloom.functions.storage import cut
from sparkloom.operators import checks, faults
from sparkloom.plans.registry import Tables, query

KINDS = ("condition", "drug_admin", "note", "measurement")


def clean_layers(t: Tables) -> checks.Layers:
    """One event for each customer, twelve for each subject, in four kinds; every layer agrees with the others."""
    spark, k = t.spark, F.col("c_custkey")
    turn = (k % 4).cast("int")
    name = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    base = t.customer.select(
        name("e", F.lpad(k.cast("string"), 9, "0")).alias("event_id"), name("r", F.lpad(k.cast("string"), 9, "0")).alias("source_row_id"), name("s", turn).alias("source_id"), F.floor(k / 12).cast("int").alias("subject_id"),
        F.element_at(F.array(*[F.lit(x) for x in KINDS]), turn + 1).alias("kind"), F.lit("EV").alias("code_system"), name("c", turn).alias("code"), name("name ", turn).alias("name"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, c_custkey)").alias("event_time"), (k % 48).cast("double").alias("value_number"), k.alias("k"), turn.alias("turn"),
    )
    base = cut(base)
    note = F.col("kind") == "note"
    events = base.select(
        "event_id", "source_id", "subject_id", "kind", "code_system", "code", "name", "event_time", F.col("event_time").alias("available_time"), F.lit(None).cast("timestamp_ntz").alias("end_time"), "value_number",
        F.when(note, name("text ", F.col("k"))).alias("value_text"), F.when(~note, "mg").alias("unit"), name("v", F.col("subject_id")).alias("encounter_id"), F.array().cast("array<string>").alias("quality_flags"), F.lit("done").alias("status"),
    )
    concept = (F.col("turn") + 1).alias("concept_id")
    star = base.select(F.when(F.col("kind") == "drug_admin", "drug_exposure").otherwise(F.col("kind")).alias("table_name"), F.col("event_id").alias("row_id"), "event_id", F.col("subject_id").alias("person_id"), concept, F.col("kind").alias("domain_id"), F.col("code").alias("event_code"), F.col("subject_id").alias("visit_id"), F.col("event_time").cast("date").alias("start_date"), F.when(F.col("kind") == "drug_admin", "mg").alias("dose_unit"))
    subjects = base.select("subject_id").distinct()
    s = F.col("subject_id")
    year = (1950 + s % 50).cast("int")
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    died = F.lit("2025-01-01").cast("date")
    frames = {
        "inputs": f([("s0", "a" * 64, 5, 4, 1)], "source_id string, file_sha256 string, read int, parsed int, quarantined int"),
        "source": base.select("source_row_id", "source_id", F.lit("same").alias("content")),
        "quarantine": f([("q1", "other", "ingest", "MISSING_PERSON_KEY")], "source_row_id string, source_id string, stage string, reason string"),
        "subjects": subjects.select(name("k", s).alias("person_source_id"), "subject_id"),
        "events": events,
        "links": base.select("event_id", "source_row_id", F.lit("p0").alias("partition_id"), F.lit("derived_from").alias("relation")),
        "anchors": subjects.select("subject_id", F.lit("ANCHOR").alias("anchor_code"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' - make_dt_interval(subject_id + 1)").alias("anchor_time")),
        "membership": f([(0, "label0", "p0")], "subject_id int, label string, partition_id string"),
        "persons": subjects.select(s.alias("person_id"), year.alias("birth_year"), year.alias("source_year")),
        "star": star,
        "lineage": star.select("table_name", "row_id", "event_id"),
        "visits": subjects.select(s.alias("visit_id"), s.alias("person_id"), name("v", s).alias("encounter_id"), F.lit(9201).alias("visit_concept_id")),
        "concepts": f([(i + 1, kind) for i, kind in enumerate(KINDS)], "concept_id int, domain_id string"),
        "deaths": subjects.where(s % 4 == 3).select("subject_id", died.alias("death_date")),
        "published_deaths": subjects.where(s % 4 == 3),
        "stream": base.select("subject_id", F.col("event_time").alias("time"), F.col("event_time").alias("available_time"), "code", "event_id", F.array("source_row_id").alias("source_row_ids"), (s % 2).alias("shard"), F.col("k").alias("place"), concept),
        "codes": f([(f"c{i}", f"name {i}") for i in range(4)], "code string, description string"),
        "splits": subjects.select("subject_id", F.lit("train").alias("split")),
        "queue": f([("other", "open")], "term string, status string"),
        "units": f([("mg",)], "spelling string"),
        "ranges": f([("c0", 0.0, 100.0)], "code string, low double, high double"),
        "coverage": f([(f"s{i}", "present") for i in range(4)], "source_id string, state string"),
        "raw": f([("a", True)], "column string, declared boolean"),
        "kinds": f([(f"s{i}", kind) for i, kind in enumerate(KINDS)], "source_id string, kind string"),
    }
    return checks.Layers(frames, labels=("label0",), anchor_aliases=("closest",), time_aliases=("at",), event_columns=tuple(events.columns), stream_types={"subject_id": "int", "time": "timestamp_ntz"}, untimed_codes=("gender",), text_sources=("s2",), excluded_status=("cancelled",))


_SKIPPED = "TERMINOLOGY_COVERAGE_PLAUSIBLE"  # too few terms to judge


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', {'false' if c == _SKIPPED else 'true'}, {'true' if c == _SKIPPED else 'false'})" for c in checks.CHECKS) + ") v(check_id, passed, skipped)")
def clean_build_passes(t):
    return checks.run(clean_layers(t)).select("check_id", "passed", "skipped")


def _fault_query(names: list[str]):
    def run(t):
        layers, out = clean_layers(t), []
        for name in names:
            inject, expect = faults.FAULTS[name]
            out.append(checks.run(inject(layers), list(expect)).select(F.lit(name).alias("fault"), "check_id", "passed"))
        return reduce(lambda a, b: a.union(b), out)

    return run


def _register() -> None:
    """Seven faults a query, so that no plan grows large: the checks that each fault names must all fail."""
    names = list(faults.FAULTS)
    for k in range(0, len(names), 7):
        part = names[k : k + 7]
        run = _fault_query(part)
        run.__name__ = f"faults_detected_{k // 7 + 1}"
        query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}', false)" for n in part for c in faults.FAULTS[n][1]) + ") v(fault, check_id, passed)")(run)


_register()
