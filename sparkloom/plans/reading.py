"""Queries over files that are written from the test tables into the session's shared folder, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.storage import ensure_checkpoint_dir
from sparkloom.plans.registry import Tables, query
from sparkloom.sources import files


def _folder(t: Tables, name: str) -> str:
    """A folder of its own for each call: frames read it later, when another call may have written."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/files/{name}-{uuid.uuid4().hex[:12]}"


def _one_file(t: Tables, lines: DataFrame, header: str, name: str) -> str:
    """Writes lines (at, line) in order, after a header, as one text file; the folder."""
    path = _folder(t, name)
    head = t.spark.createDataFrame([(-1, header)], "at long, line string")
    head.unionByName(lines.select(F.col("at").cast("long").alias("at"), "line")).coalesce(1).sortWithinPartitions("at").select("line").write.mode("overwrite").text(path)
    return path


def _customers(t: Tables) -> tuple[DataFrame, list[str]]:
    """Customers as a delimited file: some rows have a field too many, some no key, some a line break in a cell."""
    k = F.col("c_custkey")
    key = F.when(k % 50 == 9, "  ").otherwise(k.cast("string"))
    name = F.when(k % 50 == 11, F.concat(F.lit('"'), "c_name", F.lit('\n""x"", y"'))).otherwise(F.col("c_name"))
    line = F.concat_ws(",", key, name, "c_mktsegment", F.when(k % 50 == 7, "too many"))
    path = _one_file(t, t.customer.select(k.alias("at"), line.alias("line")), "﻿cust, name ,", "customers")
    rows = files.delimited(t.spark, path)
    return rows, rows.first()["columns"]


def _ingested(t: Tables):
    rows, names = _customers(t)
    return files.ingest(rows, names, person_columns=["cust"], dataset="demo", partition="p0", source="customers", file_hash="0" * 64)


_STATUS = "CASE WHEN c_custkey % 50 = 7 THEN 'FIELD_COUNT_MISMATCH' WHEN c_custkey % 50 = 9 THEN 'MISSING_PERSON_KEY' ELSE 'parsed' END"
_NAME = "CASE WHEN c_custkey % 50 = 11 THEN c_name || chr(10) || '\"x\", y' ELSE c_name END"


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n, {_STATUS} AS status, {_NAME} AS name FROM customer)
SELECT n AS row_number, status, CASE WHEN status = 'parsed' THEN c_custkey::VARCHAR END AS person_source_id, CASE WHEN status = 'parsed' THEN name END AS name, CASE WHEN status = 'parsed' THEN c_mktsegment END AS last_cell,
  sha256('demo|p0|customers|' || repeat('0', 64) || '|' || n) AS source_row_id, CASE WHEN status = 'parsed' THEN sha256(c_custkey || chr(31) || name || chr(31) || c_mktsegment) END AS source_row_sha256 FROM r""")
def ingest_delimited(t):
    good, bad = _ingested(t)
    last = next(c for c in good.columns if c.startswith("col____unnamed"))
    kept = good.select("row_number", F.col("parse_status").alias("status"), "person_source_id", F.col("col__name").alias("name"), F.col(last).alias("last_cell"), "source_row_id", "source_row_sha256")
    return kept.unionByName(bad.select("row_number", F.col("reason").alias("status"), "source_row_id"), allowMissingColumns=True)


@query(f"SELECT 'p0' AS partition_id, 'customers' AS source_id, count(*) FILTER (WHERE {_STATUS} = 'parsed') AS parsed, count(*) FILTER (WHERE {_STATUS} <> 'parsed') AS quarantined, count(*) AS read FROM customer")
def ingest_manifest(t):
    return files.manifest(*_ingested(t))


@query("""WITH b AS (SELECT chr(65279) || 'cust, name ,' || chr(10) || string_agg(line, chr(10) ORDER BY c_custkey) || chr(10) AS text FROM (SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 50 = 9 THEN '  ' ELSE c_custkey::VARCHAR END,
  CASE WHEN c_custkey % 50 = 11 THEN '"' || c_name || chr(10) || '""x"", y"' ELSE c_name END, c_mktsegment, CASE WHEN c_custkey % 50 = 7 THEN 'too many' END) AS line FROM customer))
SELECT sha256(text) AS file_sha256, octet_length(encode(text))::BIGINT AS length, true AS bom, 'lf' AS line_ending FROM b""")
def file_facts(t):
    path = _one_file(t, t.customer.select(F.col("c_custkey").alias("at"), F.concat_ws(",", F.when(F.col("c_custkey") % 50 == 9, "  ").otherwise(F.col("c_custkey").cast("string")), F.when(F.col("c_custkey") % 50 == 11, F.concat(F.lit('"'), "c_name", F.lit('\n""x"", y"'))).otherwise(F.col("c_name")), "c_mktsegment", F.when(F.col("c_custkey") % 50 == 7, "too many")).alias("line")), "﻿cust, name ,", "facts")
    found = files.sniff(t.spark, f"{path}/*.txt")
    hashes = files.file_hashes(t.spark, path, "*.txt")
    return hashes.select("file_sha256", "length", F.lit(found["bom"]).alias("bom"), F.lit(found["line_ending"]).alias("line_ending"))


@query("""SELECT code_system, term_key, min(concept_id) AS concept_id FROM (SELECT p_brand AS code_system, lower(p_name) AS term_key, 7::BIGINT AS concept_id FROM part) GROUP BY 1, 2""")
def registry_load(t):
    line = F.concat_ws(",", F.concat(F.lit('"'), F.upper("p_name"), F.lit('"')), "p_brand", F.lit("7"), F.lit("x"), F.lit("D"))
    path = _one_file(t, t.part.select(F.col("p_partkey").alias("at"), line.alias("line")), "source_string,code_system,concept_id,concept_name,domain_id", "registry")
    return files.registry(t.spark, path).select("code_system", "term_key", "concept_id")


@query("""SELECT 'units' AS "table", 'mg' AS key, 'mg' AS value UNION ALL SELECT 'units', 'none', NULL UNION ALL SELECT 'conversions', '[degF]', 'Cel 5/9 -160/9' UNION ALL SELECT 'ranges', 'bp', '1.0 9.0' UNION ALL SELECT 'ranges', 'hr', '1.0'""")
def reference_tables(t):
    write = lambda name, header, *lines: _one_file(t, t.spark.createDataFrame(list(enumerate(lines)), "at long, line string"), header, name)
    u = files.reference_units(t.spark, write("units", "source_unit,ucum,basis", "MG,mg,b", "mg,mg,b", "none,,b"))
    c = files.reference_conversions(t.spark, write("conversions", "from_ucum,to_ucum,factor,offset,basis", "[degF],Cel,5/9,-160/9,b"))
    r = files.reference_ranges(t.spark, write("ranges", "code_system,source_code,ucum,low,high,basis", "s,bp,mm[Hg],1,9,b", "s,hr,,1,,b"))
    rows = u.select(F.lit("units").alias("table"), F.col("spelling").alias("key"), F.col("ucum").alias("value"))
    rows = rows.unionByName(c.select(F.lit("conversions").alias("table"), F.col("from_ucum").alias("key"), F.concat_ws(" ", "to_ucum", "factor", "offset").alias("value")))
    return rows.unionByName(r.select(F.lit("ranges").alias("table"), F.col("code").alias("key"), F.concat_ws(" ", F.col("low").cast("string"), F.col("high").cast("string")).alias("value")))


@query("""SELECT * FROM (VALUES ('person', 'person_id', 'int'), ('person', 'born', 'timestamp_ntz'), ('person', 'amount', 'decimal(18,3)'), ('note', 'note_id', 'bigint'), ('note', 'note_text', 'string')) v(table_name, column_name, kind)""")
def ddl_tables(t):
    ddl = "CREATE TABLE cdm.person (person_id integer NOT NULL, born TIMESTAMP NULL, amount NUMERIC(18, 3)); CREATE TABLE note (note_id bigint, note_text TEXT);"
    folder = _folder(t, "tables")
    names = files.create_tables(t.spark, ddl, folder)
    rows = [(n, f.name, f.dataType.simpleString()) for n in names for f in t.spark.read.parquet(f"{folder}/{n}").schema.fields]
    return t.spark.createDataFrame(rows, "table_name string, column_name string, kind string")


@query("SELECT user_id AS subject_id, count(*) AS n_rows, count(*) - 1 AS steps, min(ts) AS first_time FROM events GROUP BY 1")
def subject_tables(t):
    folder = _folder(t, "events")
    files.write_table(t.events.select(F.col("user_id").alias("subject_id"), F.col("ts").alias("time")), folder)

    def of_subject(pdf):
        ordered = (pdf["time"].diff().dropna().dt.total_seconds() >= 0).sum()
        return pdf.head(1).assign(n_rows=len(pdf), steps=int(ordered), first_time=pdf["time"].iloc[0])[["subject_id", "n_rows", "steps", "first_time"]]

    return files.subject_tables(t.spark, folder, of_subject, "subject_id long, n_rows long, steps long, first_time timestamp_ntz")
