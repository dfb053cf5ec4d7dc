"""Queries over filters, projections, scalar functions and identities."""

from pyspark.sql import functions as F

from sparkloom.functions import hashing, text, times, units, values
from sparkloom.operators import events, relational
from sparkloom.plans.domain import DOMAIN_SQL, source_rows
from sparkloom.plans.registry import query


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_returnflag = 'R'")
def scan_filter_project(t):
    return t.lineitem.where("l_shipdate < TIMESTAMP_NTZ'1996-01-01' AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE lower(trim(coalesce(o_orderpriority, ''))) IN ('1-urgent', '2-high') AND lower(trim(coalesce(o_orderstatus, ''))) NOT IN ('p')")
def row_filter_keep_drop(t):
    kept = relational.keep_or_drop(t.orders, "o_orderpriority", keep=["1-Urgent ", "2-HIGH"])
    return relational.keep_or_drop(kept, "o_orderstatus", drop=["P"]).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '  ' WHEN c_custkey % 3 = 1 THEN 'MACHINERY' END AS a, c_mktsegment AS b, c_name AS d FROM customer)
SELECT c_custkey, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(d), '')) AS first_filled,
       CASE WHEN nullif(trim(a), '') IS NOT NULL THEN 0 WHEN nullif(trim(b), '') IS NOT NULL THEN 1 ELSE 2 END AS alias,
       CASE WHEN nullif(trim(a), '') IS NOT NULL AND trim(a) <> 'MACHINERY' THEN a WHEN trim(b) <> 'MACHINERY' THEN b ELSE coalesce(nullif(trim(a), ''), nullif(trim(b), '')) END AS unmasked
FROM c""")
def alias_fallback_masked(t):
    c = t.customer.withColumn("a", F.when(F.col("c_custkey") % 3 == 0, "  ").when(F.col("c_custkey") % 3 == 1, "MACHINERY"))
    a, b, d = F.col("a"), F.col("c_mktsegment"), F.col("c_name")
    return c.select("c_custkey", text.first_filled(a, b, d).alias("first_filled"), text.first_filled_index(a, b, d).alias("alias"), text.unmasked_first([a, b], ["MACHINERY"]).alias("unmasked"))


@query("""SELECT CASE event_type WHEN 'purchase' THEN 'drug_admin' WHEN 'error' THEN 'condition' WHEN 'signup' THEN 'visit' ELSE 'observation' END AS kind, count(*) AS n
FROM events GROUP BY 1""")
def kind_switch_counts(t):
    kind = relational.switch(F.upper("event_type"), {"Purchase": "drug_admin", "ERROR": "condition", "signup": "visit"}, "observation")
    return t.events.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ', ', ') || CASE WHEN p_partkey % 2 = 0 THEN ', ' || p_type ELSE '' END, ','), lambda x: trim(x)), lambda x: x <> '') AS codes,
                  CASE WHEN p_partkey % 4 = 0 THEN ['a', 'b'] ELSE ['a'] END AS labels FROM part),
n AS (SELECT *, greatest(CASE WHEN len(codes) > 1 THEN len(codes) ELSE 1 END, CASE WHEN len(labels) > 1 THEN len(labels) ELSE 1 END) AS w FROM p),
x AS (SELECT p_partkey, codes, labels, unnest(range(1, w + 1)) AS piece FROM n)
SELECT p_partkey, piece::INT AS piece, codes[least(piece, len(codes))] AS code, labels[least(piece, len(labels))] AS label FROM x""")
def code_split_explode(t):
    code = F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(", "), "p_type")).otherwise(""))
    rows = t.part.select("p_partkey", code.alias("code"), F.when(F.col("p_partkey") % 4 == 0, "a,b").otherwise("a").alias("label"))
    return relational.split_codes(rows, ["code", "label"])


@query("""SELECT event_id, CASE WHEN value > 100 AND event_type = 'error' THEN 'HIGH,IS_ERROR' WHEN value > 100 THEN 'HIGH' WHEN event_type = 'error' THEN 'IS_ERROR' ELSE '' END AS flags,
event_type = 'error' AS truthy FROM events""")
def flag_when_union(t):
    marker = F.when(F.col("event_type") == "error", " Yes").otherwise("0")
    flags = relational.add_flag(relational.add_flag(F.array().cast("array<string>"), text.truthy(marker), "IS_ERROR"), F.col("value") > 100, "HIGH")
    return t.events.select("event_id", F.array_join(flags, ",").alias("flags"), text.truthy(marker).alias("truthy"))


@query(f"WITH {DOMAIN_SQL} SELECT event_id, subject_id, available_time FROM src WHERE available_time <= TIMESTAMP '2024-01-10' AND subject_id = 7")
def as_of_view(t):
    return relational.as_of(source_rows(t), F.lit("2024-01-10").cast("timestamp_ntz"), F.lit(7)).select("event_id", "subject_id", "available_time")


@query("""SELECT d.doc_id, lower(d.lang) IN ('toxic', 'quality') OR lower(d.source) IN ('toxic', 'quality') AS in_code, contains(lower(d.text), 'quality') AS in_text
FROM documents d WHERE lower(d.source) IN ('toxic', 'quality') OR contains(lower(d.text), 'quality') OR contains(lower(d.text), 'toxic')""")
def leakage_scan(t):
    labels = ["toxic", "quality"]
    low = F.lower("text")
    found = F.lower("source").isin(*labels) | low.contains("quality") | low.contains("toxic")
    return t.documents.where(found).select("doc_id", (F.lower("lang").isin(*labels) | F.lower("source").isin(*labels)).alias("in_code"), low.contains("quality").alias("in_text"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 16 = 0")
def subject_sample(t):
    return t.customer.where("c_custkey % 16 = 0").select("c_custkey", "c_name")


_ID = "(('0x' || substr(sha256('salt' || chr(31) || 'demo' || chr(31) || c_name), 1, 16))::UBIGINT % 9223372036854775808)::BIGINT"


@query(f"SELECT c_custkey, {_ID} AS subject_id FROM customer")
def subject_id_hash(t):
    return t.customer.select("c_custkey", hashing.subject_id(F.lit("demo"), F.col("c_name"), "salt").alias("subject_id"))


@query(f"""WITH s AS (SELECT {_ID} AS subject_id FROM customer)
SELECT (('0x' || substr(sha256(subject_id::VARCHAR), 1, 16))::UBIGINT % 16)::INT AS bucket, count(*) AS n FROM s GROUP BY 1""")
def bucket_counts(t):
    return t.customer.groupBy(hashing.bucket(hashing.subject_id(F.lit("demo"), F.col("c_name"), "salt"), 16).alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT c_custkey, ('0x' || substr(sha256('' || chr(31) || 'split' || chr(31) || c_custkey), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS p FROM customer)
SELECT c_custkey, CASE WHEN p < 0.8 THEN 'train' WHEN p < 0.9 THEN 'tuning' ELSE 'held_out' END AS split FROM s""")
def split_assign(t):
    return t.customer.select("c_custkey", hashing.split_name(F.col("c_custkey"), [("train", 0.8), ("tuning", 0.1), ("held_out", 0.1)]).alias("split"))


_ROW = "sha256(concat_ws(chr(31), coalesce(user_id::VARCHAR, ''), coalesce(event_type, ''), strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S')))"


@query(f"SELECT h AS row_sha256, min(event_id) AS event_id, count(*) AS copies FROM (SELECT *, {_ROW} AS h FROM events) GROUP BY 1")
def row_sha_dedup(t):
    e = t.events
    cells = [hashing.canonical_cell(F.col("user_id"), e.schema["user_id"].dataType), hashing.canonical_cell(F.concat(F.lit(" "), "event_type")), hashing.canonical_cell(F.date_format("ts", "yyyy-MM-dd"))]
    return e.groupBy(hashing.row_hash(cells).alias("row_sha256")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("copies"))


@query("SELECT o_orderkey, md5(concat_ws(chr(31), o_orderkey::VARCHAR, CASE WHEN o_orderkey % 2 = 0 THEN '\x00' ELSE o_orderpriority END)) AS record_key FROM orders".replace("\x00", "' || chr(0) || '"))
def md5_record_key(t):
    return t.orders.select("o_orderkey", text.record_key([F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderpriority"))]).alias("record_key"))


@query("""WITH c AS (SELECT p_partkey, p_size, CASE p_partkey % 9 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || ' MG' WHEN 2 THEN p_size || '-' || (p_size + 5) WHEN 3 THEN '<' || p_size
  WHEN 4 THEN 'Signed by Dr ' || p_name WHEN 5 THEN ' Pending ' WHEN 6 THEN p_size || ' SINUS' WHEN 7 THEN p_name ELSE 'NULL' END AS cell FROM part)
SELECT p_partkey,
  CASE p_partkey % 9 WHEN 0 THEN 'number' WHEN 1 THEN 'number_unit' WHEN 2 THEN 'range' WHEN 3 THEN 'comparator' WHEN 4 THEN 'signature' WHEN 5 THEN 'sentinel' WHEN 8 THEN 'absent' ELSE 'text' END AS form,
  CASE WHEN p_partkey % 9 IN (0, 1) THEN p_size::DOUBLE END AS number, CASE WHEN p_partkey % 9 = 2 THEN p_size::DOUBLE END AS low, CASE WHEN p_partkey % 9 = 2 THEN p_size + 5.0::DOUBLE END AS high,
  CASE WHEN p_partkey % 9 = 1 THEN 'MG' END AS unit, CASE WHEN p_partkey % 9 IN (2, 3, 4, 5, 6, 7) THEN trim(cell) END AS text,
  CASE p_partkey % 9 WHEN 2 THEN 'RANGE_VALUE' WHEN 3 THEN 'COMPARATOR_VALUE' WHEN 4 THEN 'SIGNATURE_LINE' WHEN 5 THEN 'NON_NUMERIC_RESULT' WHEN 6 THEN 'NON_NUMERIC_RESULT' END AS flag
FROM c""")
def parse_value_forms(t):
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 9
    cell = (
        F.when(k == 0, s).when(k == 1, F.concat(s, F.lit(" MG"))).when(k == 2, F.concat(s, F.lit("-"), (F.col("p_size") + 5).cast("string"))).when(k == 3, F.concat(F.lit("<"), s))
        .when(k == 4, F.concat(F.lit("Signed by Dr "), "p_name")).when(k == 5, " Pending ").when(k == 6, F.concat(s, F.lit(" SINUS"))).when(k == 7, F.col("p_name")).otherwise("NULL")
    )
    return t.part.select("p_partkey", values.parse_value(cell, known_units=["mg", "ml"]).alias("v")).select("p_partkey", "v.form", "v.number", "v.low", "v.high", "v.unit", "v.text", "v.flag")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate END AS at, o_orderkey % 4 = 2 AS date_only, o_orderkey % 4 = 3 AS refused FROM orders""")
def parse_time_formats(t):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    cell = F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.concat(F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.lit(".0000000"))).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "MM~dd~yyyy"))
    formats = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd"]
    return t.orders.select("o_orderkey", times.parse_naive(cell, formats).alias("at"), times.looks_date_only(cell).alias("date_only"), times.unparseable(cell, formats).alias("refused"))


@query("""SELECT (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE AS local_day, count(*) AS n, max(hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York'))::INT AS last_hour FROM events GROUP BY 1""")
def local_date_rollup(t):
    zone = "America/New_York"
    return t.events.groupBy(times.local_date(F.col("ts"), zone).alias("local_day")).agg(F.count("*").alias("n"), F.max(F.hour(times.to_local(F.col("ts"), zone))).alias("last_hour"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate + to_microseconds((l_discount * 10 * 86400000000)::BIGINT) AS end_time, 'DERIVED_END_TIME' AS flags FROM lineitem""")
def interval_end_derived(t):
    rows = t.lineitem.withColumn("stay", F.round(F.col("l_discount") * 10, 6)).withColumn("key", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    v = events.visits(rows, subject="l_orderkey", encounter="key", start="l_shipdate", stay_days="stay")
    k = F.split("encounter_id", "/")
    return v.select(F.col("subject_id").alias("l_orderkey"), k[1].cast("int").alias("l_linenumber"), k[2].cast("bigint").alias("l_partkey"), k[3].cast("bigint").alias("l_suppkey"), "end_time", F.array_join("quality_flags", ",").alias("flags"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def days_between_ship(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_shipdate", times.days_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("days"))


@query("""WITH r AS (SELECT event_id, ts AS event_time, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS e, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN ts - INTERVAL 1 HOUR ELSE ts + INTERVAL 1 HOUR END AS a FROM events)
SELECT event_id, coalesce(e, a) AS event_time, CASE WHEN coalesce(e, a) IS NULL THEN NULL ELSE greatest(coalesce(a, e), coalesce(e, a)) END AS available_time,
  concat_ws(',', CASE WHEN a IS NULL AND e IS NOT NULL THEN 'AVAILABILITY_ASSUMED' END, CASE WHEN a < e THEN 'AVAILABILITY_BEFORE_EVENT' END, CASE WHEN e IS NULL AND a IS NOT NULL THEN 'TIME_FALLBACK' END) AS flags
FROM r""")
def resolve_times(t):
    ts, i = F.col("ts"), F.col("event_id")
    a = F.when(i % 3 == 1, ts - F.make_dt_interval(F.lit(0), F.lit(1))).when(i % 3 == 2, ts + F.make_dt_interval(F.lit(0), F.lit(1)))
    none = F.lit(None).cast("timestamp_ntz")
    return t.events.select("event_id", times.resolve_times(F.when(i % 5 != 0, ts), F.lit(0), a, none).alias("r")).select("event_id", "r.event_time", "r.available_time", F.array_join("r.flags", ",").alias("flags"))


@query(r"""SELECT trim(regexp_replace(regexp_replace(lower('(' || p_type || '), ' || p_name), '[,;:()\[\]"'']', ' ', 'g'), '\s+', ' ', 'g')) AS term_key, count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY 1""")
def normalize_term_groups(t):
    key = text.normalize_term(F.concat(F.lit("("), "p_type", F.lit("), "), "p_name"))
    return t.part.groupBy(key.alias("term_key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query("""WITH k AS (SELECT p_brand, upper(replace(replace(p_name, ' ', ''), '-', '')) AS key, p_partkey, p_name FROM part)
SELECT p_brand AS vocabulary_id, key, min(p_partkey) AS concept_id FROM k GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) = 1""")
def unpunctuated_codes(t):
    from sparkloom.operators.terminology import unambiguous_unpunctuated

    return unambiguous_unpunctuated(t.part.select(F.col("p_brand").alias("vocabulary_id"), F.col("p_name").alias("concept_code"), F.col("p_partkey").alias("concept_id")))


@query("""WITH v AS (SELECT event_id, event_type AS code, value, CASE event_id % 4 WHEN 0 THEN 'degF' WHEN 1 THEN 'Cel' WHEN 2 THEN NULL ELSE 'furlong' END AS unit FROM events),
r AS (SELECT *, coalesce(unit, CASE code WHEN 'view' THEN 'Cel' END) AS u FROM v),
c AS (SELECT *, CASE WHEN lower(u) IN ('degf', 'cel') THEN 'Cel' END AS n,
       CASE WHEN lower(u) = 'degf' THEN (value::DECIMAL(18,2) * 5 / 9.0 - 17.777777778)::DOUBLE WHEN u IS NULL OR lower(u) = 'cel' THEN value END AS x FROM r)
SELECT event_id, n AS unit_normalized, CASE WHEN NOT (coalesce(code = 'error' AND n = 'Cel' AND (x < 0 OR x > 50), false)) THEN round(x, 4) + 0.0 END AS value_normalized,
  concat_ws(',', CASE WHEN coalesce(code = 'error' AND n = 'Cel' AND (x < 0 OR x > 50), false) THEN 'IMPLAUSIBLE' END,
            CASE WHEN unit IS NULL AND u IS NOT NULL THEN 'UNIT_DECLARED' END, CASE WHEN u = 'furlong' THEN 'UNIT_UNKNOWN' END) AS flags
FROM c""")
def unit_convert_range(t):
    s = t.spark
    k = F.col("event_id") % 4
    rows = t.events.select("event_id", F.lit("EV").alias("code_system"), F.col("event_type").alias("code"), F.col("value"), F.when(k == 0, "degF").when(k == 1, "Cel").when(k == 3, "furlong").alias("unit"))
    out = units.normalize_units(
        rows,
        s.createDataFrame([("DEGF", "[degF]"), ("cel", "Cel"), ("none", None)], "spelling string, ucum string"),
        s.createDataFrame([("[degF]", "Cel", "5/9", "-17.777777778")], "from_ucum string, to_ucum string, factor string, offset string"),
        s.createDataFrame([("EV", "error", "Cel", 0.0, 50.0)], "code_system string, code string, ucum string, low double, high double"),
        declared=s.createDataFrame([("view", "Cel")], "code string, unit string"),
    )
    return out.select("event_id", "unit_normalized", (F.round("value_normalized", 4) + 0.0).alias("value_normalized"), F.array_join("unit_flags", ",").alias("flags"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, substr(concat_ws('; ', l_quantity::INT || ' MG', 'rate ' || l_returnflag), 1, 12) AS sig,
CASE WHEN l_extendedprice < 50000 THEN l_extendedprice::DECIMAL(18,3)::DOUBLE END AS quantity FROM lineitem""")
def sig_text_build(t):
    from sparkloom.operators.publish import bounded_quantity

    dose = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" MG"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.sig_text(dose, F.col("l_returnflag"), 12).alias("sig"), bounded_quantity(F.col("l_extendedprice"), 50000.0).cast("double").alias("quantity"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q || ' mg' AS dose, CASE WHEN l_linenumber % 2 = 0 THEN q::DOUBLE END AS rate, CASE WHEN l_linenumber % 2 = 0 THEN 'mL/h' END AS rate_unit,
CASE WHEN l_linenumber % 2 = 1 THEN 'RATE_UNPARSED' END AS rate_flag, CASE WHEN l_linenumber % 3 = 0 THEN q::DOUBLE END AS bound, CASE WHEN l_linenumber % 3 = 0 THEN q END AS whole FROM c""")
def dose_rate_bounds(t):
    q, i = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    dose = values.dose_identity(F.when(i % 2 == 0, F.concat(q, F.lit(".0 MG"))).otherwise(F.concat(F.lit(" "), q, F.lit(" mg"))))
    rate = values.parse_rate(F.when(i % 2 == 0, F.concat(q, F.lit(" mL/h"))).otherwise("slow"), F.lit(None).cast("string"))
    cell = F.when(i % 3 == 0, F.concat(q, F.lit(".9"))).otherwise(F.concat(F.lit("< "), q))
    bound = F.floor(values.reference_bound(cell)).cast("double")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dose.alias("dose"), rate.alias("r"), bound.alias("bound"), text.as_int(cell).alias("whole")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "dose", F.col("r.number").alias("rate"), F.col("r.unit").alias("rate_unit"), F.col("r.flag").alias("rate_flag"), "bound", "whole")


@query("""SELECT p_partkey, substr(sha256(concat_ws('|', 'term', p_brand, p_name)), 1, 16) AS item_id,
CASE WHEN len(regexp_split_to_array(p_name || ' ' || p_type, '\\s+')) <= 2 AND length(p_name || ' ' || p_type) <= 20 THEN p_name || ' ' || p_type
     ELSE 'text#' || substr(sha256(p_name || ' ' || p_type), 1, 12) || '(' || length(p_name || ' ' || p_type) || ' chars)' END AS spelling FROM part""".replace("\\\\", "\\"))
def review_spellings(t):
    both = F.concat_ws(" ", "p_name", "p_type")
    return t.part.select("p_partkey", text.item_id(F.lit("term"), F.col("p_brand"), F.col("p_name")).alias("item_id"), text.reportable(both).alias("spelling"))


@query("""SELECT source, regexp_replace(regexp_replace(url, '[0-9]', '9', 'g'), '[A-Za-z]', 'a', 'g') AS shape, count(*) AS n FROM (SELECT 'pages' AS source, url FROM pages) GROUP BY 1, 2""")
def masked_shapes(t):
    return t.pages.groupBy(F.lit("pages").alias("source"), text.mask_shape(F.col("url")).alias("shape")).agg(F.count("*").alias("n"))
