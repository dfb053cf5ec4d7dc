"""Queries over samples, profiles, statements of death, coverage, units and comparisons."""

import datetime as dt

from pyspark.sql import functions as F

from sparkloom.functions import times
from sparkloom.operators import events, publish, relational
from sparkloom.plans.domain import DOMAIN_SQL, facts, source_rows
from sparkloom.plans.registry import query


@query("SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) WHERE n % 25 = 0")
def every_nth_person(t):
    return relational.every_nth(t.customer, ["c_custkey"], 25).select("c_custkey", "c_name")


@query("""WITH top AS (SELECT l_partkey, count(*) AS code_rows FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)
SELECT l_partkey, l_returnflag AS unit, count(*) AS n, min(code_rows) AS code_rows FROM lineitem JOIN top USING (l_partkey) GROUP BY 1, 2""")
def top_code_spellings(t):
    g = relational.of_top_codes(t.lineitem, "l_partkey", 50).groupBy("l_partkey", F.col("l_returnflag").alias("unit"))
    return g.agg(F.count("*").alias("n"), F.min("code_rows").alias("code_rows"))


@query("""WITH v AS (SELECT 'c_mktsegment' AS name, c_mktsegment AS v FROM customer UNION ALL SELECT 'c_name', CASE WHEN c_custkey % 3 <> 0 THEN c_name END FROM customer),
s AS (SELECT DISTINCT name, v FROM v WHERE regexp_matches(v, '^[A-Za-z0-9#_ .\\-/]{1,20}$')), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY v) AS i FROM s)
SELECT v.name, count(v.v) AS filled, count(DISTINCT v.v) AS kinds, (SELECT string_agg(k.v, '|' ORDER BY k.v) FROM k WHERE k.name = v.name AND i <= 3) AS samples FROM v GROUP BY 1""".replace("\\\\", "\\"))
def column_profile(t):
    c = t.customer.withColumn("c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")))
    return relational.column_profile(c, ["c_mktsegment", "c_name"])


@query("""SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AS linked FROM orders""")
def linked_marker(t):
    key = F.col("l_orderkey").alias("o_orderkey")
    known = [t.lineitem.where("l_returnflag = 'R'").select(key), t.lineitem.where("l_quantity > 49").select(key)]
    return relational.mark_linked(t.orders, known, ["o_orderkey"]).select("o_orderkey", "linked")


@query("""SELECT event_id, date_diff('hour', TIMESTAMP '2024-01-01 12:34:56', ts) AS hours, date_diff('day', TIMESTAMP '2024-01-01 12:34:56', ts) AS days FROM events""")
def boundary_differences(t):
    start = F.lit("2024-01-01 12:34:56").cast("timestamp_ntz")
    return t.events.select("event_id", times.boundaries_between(F.col("ts"), start, "hour").alias("hours"), times.boundaries_between(F.col("ts"), start, "day").alias("days"))


@query("""SELECT DISTINCT user_id AS subject_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150) THEN 'redundant' ELSE 'DEATH_WITHOUT_TIME' END AS outcome
FROM events WHERE event_type = 'purchase' AND value > 120""")
def vital_status_gate(t):
    e = t.events.withColumn("status", F.when((F.col("event_type") == "purchase") & (F.col("value") > 120), " Deceased").otherwise("alive"))
    deaths = events.death_events(t.events.where("event_type = 'error' AND value > 150"), "user_id", "ts")
    known, refused = events.vital_status(e, "user_id", "status", ["deceased", "dead"], deaths)
    return known.withColumn("outcome", F.lit("redundant")).unionByName(refused.withColumnRenamed("reason", "outcome"))


@query("""SELECT c_custkey AS subject_id, count(DISTINCT d) AS dates, 1 AS ids FROM (SELECT c_custkey, DATE '1950-01-01' + c_nationkey AS d FROM customer UNION ALL SELECT c_custkey, DATE '1950-01-01' + (c_nationkey + c_custkey % 2)::INT FROM customer) GROUP BY 1""")
def birth_disagreements(t):
    born = lambda days: F.date_add(F.lit("1950-01-01").cast("date"), days.cast("int")).alias("born")
    rows = t.customer.select("c_custkey", born(F.col("c_nationkey"))).union(t.customer.select("c_custkey", born(F.col("c_nationkey") + F.col("c_custkey") % 2)))
    return events.birth_events(rows, "c_custkey", "born").groupBy("subject_id").agg(F.countDistinct("value_text").alias("dates"), F.countDistinct("event_id").cast("int").alias("ids"))


@query("""WITH d AS (SELECT p, s FROM (VALUES ('p0'), ('p1'), ('p9')) a(p), (VALUES ('view'), ('error'), ('fax')) b(s)), m AS (SELECT 'p' || (event_id % 3) AS p, event_type AS s, count(*) FILTER (WHERE event_type <> 'error') AS n FROM events GROUP BY 1, 2)
SELECT d.p AS partition_id, d.s AS source_id, CASE WHEN n IS NULL THEN 'not_extracted' WHEN n = 0 THEN 'empty' ELSE 'present' END AS state FROM d LEFT JOIN m ON d.p = m.p AND d.s = m.s""")
def source_coverage(t):
    declared = t.spark.createDataFrame([(p, s) for p in ("p0", "p1", "p9") for s in ("view", "error", "fax")], "partition_id string, source_id string")
    manifest = source_rows(t).groupBy("partition_id", "source_id").agg(F.count_if(F.col("source_id") != "error").alias("read"))
    return events.coverage(declared, manifest)


@query("""SELECT unit, CASE unit WHEN 'a' THEN 7 WHEN 'mg' THEN 3 WHEN 'ml' THEN 4 ELSE 0 END AS concept_id FROM (VALUES ('a'), ('b'), ('mg'), ('ml'), ('zz')) v(unit)""")
def unit_map(t):
    s = t.spark
    units = s.createDataFrame([("a", None), ("b", None), ("mg", "mg"), ("ml", "mL"), ("zz", "zz")], "unit string, ucum string")
    concepts = s.createDataFrame([(3, "mg", "Unit"), (5, "mg", "Unit"), (4, "mL", "Unit"), (7, "x", "Unit"), (9, "zz", "Drug")], "concept_id int, concept_code string, domain_id string")
    return publish.unit_concepts(units, s.createDataFrame([("a", 7), ("b", 9)], "unit string, concept_id int"), concepts)


@query("""SELECT user_id AS subject_id, count(*) AS issues, CASE WHEN user_id % 10 <> 0 THEN user_id + 1 END AS person_id FROM events WHERE value > 150 GROUP BY 1, 3""")
def audit_rows(t):
    persons = t.events.select(F.col("user_id").alias("subject_id"), (F.col("user_id") + 1).alias("person_id")).distinct().where("subject_id % 10 <> 0")
    issues = t.events.where("value > 150").groupBy(F.col("user_id").alias("subject_id")).agg(F.count("*").alias("issues"))
    return publish.audit(issues, persons)


@query("SELECT 'demo' AS source_name, '1' AS source_release, DATE '2024-01-01' AS built_on")
def source_description(t):
    return publish.source_description(t.spark, "demo", "1", dt.date(2024, 1, 1))


@query(f"""WITH {DOMAIN_SQL} SELECT code, count(*) AS rows, count(DISTINCT subject_id) AS subjects, count(*) FILTER (WHERE n_rows > 1) AS merged, count(*) FILTER (WHERE available_time > event_time + INTERVAL 1 HOUR) AS late FROM facts GROUP BY 1""")
def converter_comparison(t):
    late = F.col("available_time") > F.col("event_time") + F.make_dt_interval(F.lit(0), F.lit(1))
    return facts(t).groupBy("code").agg(F.count("*").alias("rows"), F.countDistinct("subject_id").alias("subjects"), F.count_if(F.col("n_rows") > 1).alias("merged"), F.count_if(late).alias("late"))


@query("""SELECT event_id, (props->>'$.k')::INT AS k, '{"k":' || (props->>'$.k') || ',"type":"' || event_type || '"}' AS json FROM events""")
def json_cells(t):
    e = t.events.withColumn("p", F.from_json("props", "k int"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("type"))).alias("json"))


@query("""SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem""")
def distinct_rows(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("""SELECT event_id, ts::DATE IN (DATE '2024-01-03', DATE '2024-01-04') AS odd_day FROM events""")
def utc_days_excluded(t):
    changes = times.offset_change_days("America/New_York", 2024, 2024)  # none in January: two further days stand in
    days = [d for d in changes if d.month == 1] + [dt.date(2024, 1, 3), dt.date(2024, 1, 4)]
    return t.events.select("event_id", F.col("ts").cast("date").isin(*days).alias("odd_day"))
