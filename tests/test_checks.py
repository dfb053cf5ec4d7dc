"""Every fault turns its checks from passed to failed on a clean small build."""

import datetime as dt

import pytest

from sparkloom.operators import checks, faults

DAY = dt.datetime(2024, 1, 1)


def clean(spark) -> checks.Layers:
    kinds = ["condition", "drug_admin", "note", "measurement"]
    events, source, links, star, stream = [], [], [], [], []
    for k in range(48):
        kind, s, e = kinds[k % 4], k // 12, f"e{k:02d}"
        at = DAY + dt.timedelta(hours=k)
        events.append((e, f"s{k % 4}", s, kind, "EV", f"c{k % 4}", f"name {k % 4}", at, at, None, float(k), f"text {k}" if kind == "note" else None, "mg" if kind != "note" else None, f"v{s}", [], "done"))
        source.append((f"r{k:02d}", f"s{k % 4}", "same"))
        links.append((e, f"r{k:02d}", "p0", "derived_from"))
        star.append(({"drug_admin": "drug_exposure"}.get(kind, kind), e, e, s, k % 4 + 1, kind, f"c{k % 4}", s, at.date(), "mg" if kind == "drug_admin" else None))
        stream.append((s, at, at, f"c{k % 4}", e, [f"r{k:02d}"], s % 2, k, k % 4 + 1))
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    frames = {
        "inputs": f([("s0", "a" * 64, 5, 4, 1)], "source_id string, file_sha256 string, read int, parsed int, quarantined int"),
        "source": f(source, "source_row_id string, source_id string, content string"),
        "quarantine": f([("q1", "other", "ingest", "MISSING_PERSON_KEY")], "source_row_id string, source_id string, stage string, reason string"),
        "subjects": f([(f"k{s}", s) for s in range(4)], "person_source_id string, subject_id int"),
        "events": f(events, "event_id string, source_id string, subject_id int, kind string, code_system string, code string, name string, event_time timestamp_ntz, available_time timestamp_ntz, end_time timestamp_ntz, value_number double, value_text string, unit string, encounter_id string, quality_flags array<string>, status string"),
        "links": f(links, "event_id string, source_row_id string, partition_id string, relation string"),
        "anchors": f([(s, "ANCHOR", DAY - dt.timedelta(days=s)) for s in range(4)], "subject_id int, anchor_code string, anchor_time timestamp_ntz"),
        "membership": f([(0, "label0", "p0")], "subject_id int, label string, partition_id string"),
        "persons": f([(s, 1950 + s, 1950 + s) for s in range(4)], "person_id int, birth_year int, source_year int"),
        "star": f(star, "table_name string, row_id string, event_id string, person_id int, concept_id int, domain_id string, event_code string, visit_id int, start_date date, dose_unit string"),
        "lineage": f([(r[0], r[1], r[2]) for r in star], "table_name string, row_id string, event_id string"),
        "visits": f([(s, s, f"v{s}", 9201) for s in range(4)], "visit_id int, person_id int, encounter_id string, visit_concept_id int"),
        "concepts": f([(i + 1, k) for i, k in enumerate(kinds)], "concept_id int, domain_id string"),
        "deaths": f([(3, dt.date(2024, 2, 1))], "subject_id int, death_date date"),
        "published_deaths": f([(3,)], "subject_id int"),
        "stream": f(stream, "subject_id int, time timestamp_ntz, available_time timestamp_ntz, code string, event_id string, source_row_ids array<string>, shard int, place int, concept_id int"),
        "codes": f([(f"c{k}", f"name {k}") for k in range(4)], "code string, description string"),
        "splits": f([(s, "train") for s in range(4)], "subject_id int, split string"),
        "queue": f([("other", "open")], "term string, status string"),
        "units": f([("mg",)], "spelling string"),
        "ranges": f([("c0", 0.0, 100.0)], "code string, low double, high double"),
        "coverage": f([(f"s{k}", "present") for k in range(4)], "source_id string, state string"),
        "raw": f([("a", True)], "column string, declared boolean"),
        "kinds": f([(f"s{k}", kinds[k]) for k in range(4)], "source_id string, kind string"),
    }
    return checks.Layers(frames, labels=("label0",), anchor_aliases=("closest",), time_aliases=("at",), event_columns=tuple(frames["events"].columns), stream_types={"subject_id": "int", "time": "timestamp_ntz"}, untimed_codes=("gender",), text_sources=("s2",), excluded_status=("cancelled",))


@pytest.fixture(scope="module")
def layers(spark):
    x = clean(spark)
    for f in x.frames.values():
        f.cache()
    return x


def test_a_clean_build_passes(layers):
    rows = {r.check_id: r for r in checks.run(layers).collect()}
    assert len(rows) == 55
    assert [c for c, r in rows.items() if not r.passed and not r.skipped] == []
    assert [c for c, r in rows.items() if r.skipped] == ["TERMINOLOGY_COVERAGE_PLAUSIBLE"]


def test_missing_layers_skip(layers):
    only = checks.Layers({"events": layers.events})
    r = checks.run(only, ["EVENT_LINEAGE_COMPLETE"]).first()
    assert r.skipped and not r.passed


def test_faults(layers):
    assert len(faults.FAULTS) == 28
    failed = {}
    for name, (inject, expect) in faults.FAULTS.items():
        got = {r.check_id: r.passed for r in checks.run(inject(layers), list(expect)).collect()}
        missed = [c for c in expect if got[c]]
        if missed:
            failed[name] = missed
    assert failed == {}
