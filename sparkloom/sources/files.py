"""Readers that keep every row, and sinks that write whole tables."""

from __future__ import annotations

import csv
import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.hashing import canonical_cell, row_hash, source_row_id
from sparkloom.functions.text import first_filled


def normalize_header(names: list[str]) -> list[str]:
    """Names without byte order mark and white space; blanks become __unnamed_i."""
    clean = [n.lstrip("﻿").strip() for n in names]
    return [n or f"__unnamed_{i}" for i, n in enumerate(clean)]


def sniff(spark: SparkSession, path: str, head: int = 1 << 16) -> dict[str, object]:
    """Line ending and byte order mark of a file, from its first bytes."""
    first = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, head).alias("b")).first()
    data = bytes(first["b"]) if first else b""
    ending = "crlf" if b"\r\n" in data else "lf" if b"\n" in data else "cr" if b"\r" in data else "none"
    return {"bom": data.startswith(b"\xef\xbb\xbf"), "line_ending": ending}


def _cells(line: Column, delimiter: str, quoted: bool) -> Column:
    if not quoted:
        return F.split(line, f"\\Q{delimiter}\\E", -1)
    pattern = rf'(?s)\Q{delimiter}\E("(?:[^"]|"")*"|(?:(?!\Q{delimiter}\E).)*)'  # each cell after a delimiter: no match is empty
    return F.transform(F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(pattern), F.lit(1)), lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))


def delimited(spark: SparkSession, path: str, *, delimiter: str = ",", quoted: bool = True, header: int = 1, encoding: str = "UTF-8") -> DataFrame:
    """Data rows of one file as (row_number from 1, cells, raw, columns), whatever their width.

    Rows are kept as text so that those of the wrong width survive for quarantine. The numbering needs the order
    within the file: a range-partitioned sort by position, no single task. Where quotes are left open at the end of a
    line, the lines up to the one that closes them are one row: a row begins where the quotes so far are even.
    """
    from sparkloom.operators.relational import running_sum, surrogate_keys

    lines = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.regexp_replace(F.regexp_replace("value", "\r$", ""), "^\ufeff", "").alias("line"))
    odd = F.regexp_count("line", F.lit('"')) % 2
    if quoted and lines.where(odd == 1).take(1):
        open_after = running_sum(lines.withColumn("odd", odd), ["b", "i"], F.col("odd"), "quotes")
        starts = ((F.col("quotes") - F.col("odd")) % 2 == 0).cast("bigint")
        rows = running_sum(open_after, ["b", "i"], starts, "n").groupBy("n")
        numbered = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "i", "line"))), lambda x: x["line"]), "\n").alias("line"))
    else:
        numbered = surrogate_keys(lines, ["b", "i"], "n")
    head = numbered.where(F.col("n") <= header).orderBy("n").collect()
    names = normalize_header(next(csv.reader([head[-1]["line"]], delimiter=delimiter)) if head else [])
    data = numbered.where(F.col("n") > header).where("line <> ''")
    columns = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return data.select((F.col("n") - header).alias("row_number"), _cells(F.col("line"), delimiter, quoted).alias("cells"), F.col("line").alias("raw"), columns.alias("columns"))


def ingest(rows: DataFrame, names: list[str], *, person_columns: list[str], dataset: str, partition: str, source: str, file_hash: str) -> tuple[DataFrame, DataFrame]:
    """(source layer, quarantine) of rows (row_number, cells, raw): width and person key are checked in one select."""
    n = len(names)
    cells = {c: F.get("cells", F.lit(i)) for i, c in enumerate(names)}
    key = first_filled(*[cells[c] for c in person_columns])
    status = F.when(F.size("cells") != n, "FIELD_COUNT_MISMATCH").when(key.isNull(), "MISSING_PERSON_KEY").otherwise("parsed")
    lit = F.lit
    out = rows.select("row_number", status.alias("parse_status"), key.alias("person_source_id"), source_row_id(lit(dataset), lit(partition), lit(source), lit(file_hash), F.col("row_number")).alias("source_row_id"), row_hash([canonical_cell(c) for c in cells.values()]).alias("source_row_sha256"), lit(partition).alias("partition_id"), lit(source).alias("source_id"), F.substring("raw", 1, 200).alias("preview"), *[v.alias(f"col__{k}") for k, v in cells.items()])
    good = out.where("parse_status = 'parsed'").drop("preview")
    bad = out.where("parse_status <> 'parsed'").select("source_row_id", "partition_id", "source_id", "row_number", F.lit("ingest").alias("stage"), F.col("parse_status").alias("reason"), "preview")
    return good, bad


def manifest(source: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Rows read, parsed and quarantined per partition and source."""
    a = source.groupBy("partition_id", "source_id").agg(F.count("*").alias("parsed"))
    b = quarantine.groupBy("partition_id", "source_id").agg(F.count("*").alias("quarantined"))
    j = a.join(b, ["partition_id", "source_id"], "full_outer").na.fill(0, ["parsed", "quarantined"])
    return j.withColumn("read", F.col("parsed") + F.col("quarantined"))


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.sha2("content", 256).alias("file_sha256"), "length")


def any_of(spark: SparkSession, variants: list[str]) -> str | None:
    """First path pattern that finds files; none: the source was not extracted."""
    fs = spark._jvm.org.apache.hadoop.fs
    for v in variants:
        p = fs.Path(v)
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        if found is not None and len(found):
            return v
    return None


def declared_out_of_scope(names: list[str], patterns: list[str]) -> dict[str, bool]:
    """Whether a file is named by a pattern, over its base name or the end of its path."""
    return {n: any(fnmatch.fnmatch(n.rsplit("/", 1)[-1], p) or fnmatch.fnmatch(n, f"*/{p}") or fnmatch.fnmatch(n, p) for p in patterns) for n in names}


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated table without quoting, every column text."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def unique_reference(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """A reference table; two values under one key raise when the plan runs."""
    g = df.groupBy(*key).agg(F.min(value).alias(value), F.max(value).alias("__b"))
    return g.where(F.assert_true(F.col(value).eqNullSafe(F.col("__b")), F.lit("contradicting reference rows")).isNull()).drop("__b")


def workbook(spark: SparkSession, path: str, sheet_aliases: list[str]) -> DataFrame:
    """A sheet of a workbook as text columns; needs openpyxl, which is asked for only here."""
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    import io

    content = spark.read.format("binaryFile").load(path).first()["content"]
    book = openpyxl.load_workbook(io.BytesIO(bytes(content)), read_only=True, data_only=True)
    by_name = {s.lower(): s for s in book.sheetnames}
    sheet = next((by_name[a.lower()] for a in sheet_aliases if a.lower() in by_name), None)
    if sheet is None:
        raise ValueError(f"no sheet of {sheet_aliases} in {book.sheetnames}")
    rows = [[None if c is None else str(c) for c in r] for r in book[sheet].iter_rows(values_only=True)]
    return sheet_rows(spark, rows)


def sheet_rows(spark: SparkSession, rows: list[list[str | None]]) -> DataFrame:
    """Header and cells of a sheet without leading unnamed columns and empty rows."""
    names = normalize_header([c or "" for c in rows[0]]) if rows else []
    skip = next((i for i, n in enumerate(names) if not n.startswith("__unnamed_")), len(names))
    body = [r[skip:] for r in rows[1:] if any(c not in (None, "") for c in r[skip:])]
    return spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names[skip:]) or "empty string")


def write_table(df: DataFrame, path: str, *, bucket: str | None = None) -> None:
    """Replaces a table; the committer shows it whole or not at all."""
    writer = (df.repartition(bucket) if bucket else df).write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(bucket) if bucket else writer).parquet(path)


def read_tables(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of one source whose columns may differ; missing ones are null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def registry(spark: SparkSession, *paths: str) -> DataFrame:
    """(code_system, term_key, concept_id, concept_name, domain_id) of mapping files, keyed by system and normalised
    string; two concepts under one key raise when the plan runs. An empty concept id is no mapping."""
    from sparkloom.functions.text import normalize_term

    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(list(paths))
    rows = rows.select("code_system", normalize_term(F.col("source_string")).alias("term_key"), F.col("concept_id").try_cast("bigint").alias("concept_id"), "concept_name", "domain_id").where("concept_id IS NOT NULL")
    g = rows.groupBy("code_system", "term_key").agg(F.min("concept_id").alias("concept_id"), F.max("concept_id").alias("other"), F.min("concept_name").alias("concept_name"), F.min("domain_id").alias("domain_id"))
    return g.where(F.assert_true(F.col("concept_id") == F.col("other"), F.lit("one term has two approved concepts")).isNull()).drop("other")


def reference_units(spark: SparkSession, *paths: str) -> DataFrame:
    """(spelling, ucum) of unit tables: source_unit, ucum; spellings are folded, a contradiction raises when the plan runs."""
    from sparkloom.functions.units import unit_key

    rows = spark.read.option("header", True).csv(list(paths)).select(unit_key(F.col("source_unit")).alias("spelling"), F.nullif(F.trim("ucum"), F.lit("")).alias("ucum"))
    return unique_reference(rows, ["spelling"], "ucum")


def reference_conversions(spark: SparkSession, *paths: str) -> DataFrame:
    """(from_ucum, to_ucum, factor, offset); a unit that is converted twice, or a factor that is no number, raises."""
    rows = spark.read.option("header", True).csv(list(paths)).select("from_ucum", "to_ucum", "factor", F.coalesce("offset", F.lit("0")).alias("offset"))
    number = r"^[+-]?(\d+\.?\d*|\.\d+)(/\d+)?$"
    rows = rows.where(F.assert_true(F.col("factor").rlike(number) & F.col("offset").rlike(number), F.lit("a factor or offset is no number")).isNull())
    n = rows.groupBy("from_ucum").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("to_ucum", "factor", "offset")])
    return n.where(F.assert_true(F.col("n") == 1, F.lit("a unit is converted twice")).isNull()).drop("n")


def reference_ranges(spark: SparkSession, *paths: str) -> DataFrame:
    """(code_system, code, ucum, low, high); open ends are null; a low end above the high one raises."""
    rows = spark.read.option("header", True).csv(list(paths))
    rows = rows.select("code_system", F.col("source_code").alias("code"), F.nullif(F.trim("ucum"), F.lit("")).alias("ucum"), F.col("low").try_cast("double").alias("low"), F.col("high").try_cast("double").alias("high"))
    ordered = F.coalesce(F.col("low") <= F.col("high"), F.lit(True))
    return rows.where(F.assert_true(ordered, F.lit("a range ends before it starts")).isNull())


def wide_view(spark: SparkSession, path: str, subject: str | None = None, one_in: int = 1, columns: list[str] | None = None) -> DataFrame:
    """A (compressed) delimited file as a view, every column text; optionally the columns that are wanted, and the rows
    of one subject in so many, by a hash of its id."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    rows = rows if subject is None or one_in <= 1 else rows.where(F.pmod(F.xxhash64(subject), F.lit(one_in)) == 0)
    return rows.select(*columns) if columns else rows


#: Column types of table definitions and what they are here (fixed values).
TYPES = {"integer": "int", "int": "int", "bigint": "bigint", "smallint": "smallint", "float": "double", "double": "double", "real": "float", "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "text": "string", "varchar": "string", "char": "string", "boolean": "boolean"}


def schemas_of_ddl(text: str) -> dict[str, str]:
    """Table -> schema of the CREATE TABLE statements of a script; NUMERIC(p, s) stays a decimal, without p it is (38, 9)."""
    found = {}
    for name, body in re.findall(r"(?is)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.@\"]+)\s*\((.*?)\)\s*;", re.sub(r"--[^\n]*", "", text)):
        columns = []
        for line in re.split(r",(?![^(]*\))", body):
            if m := re.match(r"(?is)\s*\"?(\w+)\"?\s+(\w+)\s*(\([\d\s,]+\))?", line):
                column, kind, size = m.groups()
                if column.lower() in ("primary", "foreign", "constraint", "unique", "check"):
                    continue
                kind = kind.lower()
                columns.append(f"`{column.lower()}` " + (f"decimal{re.sub(r'\s', '', size or '(38,9)')}" if kind in ("numeric", "decimal") else TYPES[kind]))
        found[name.split(".")[-1].strip('"').lower()] = ", ".join(columns)
    return found


def create_tables(spark: SparkSession, ddl: str, folder: str) -> list[str]:
    """Writes an empty table in `folder` for each definition of the script; the names."""
    schemas = schemas_of_ddl(ddl)
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
    return list(schemas)


def insert_rows(spark: SparkSession, folder: str, table: str, rows: list[tuple]) -> None:
    """Appends rows from the driver to a table in one write, with its own schema. For small lists (maps, metadata)."""
    path = f"{folder.rstrip('/')}/{table}"
    spark.createDataFrame(rows, spark.read.parquet(path).schema).write.mode("append").parquet(path)


def subject_tables(spark: SparkSession, folder: str, function, schema: str, subject: str = "subject_id", order: tuple[str, ...] = ("time",)) -> DataFrame:
    """`function(frame of one subject, in order)` over every subject of a table: what an iterator over subject-contiguous
    files gives, spread over the executors. A subject's rows are in one task at a time."""
    rows = spark.read.parquet(folder)
    return rows.groupBy(subject).applyInPandas(lambda pdf: function(pdf.sort_values(list(order), ignore_index=True, na_position="first")), schema)
