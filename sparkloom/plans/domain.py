"""The test tables in the roles of the domain, in Spark and as SQL views of the same rows.

events.user_id is the subject, a row of `events` a source row, (subject, type, day) one fact, event_id % 3 the
partition, orders are stays, lineitem their orders and administrations, part the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import merge
from sparkloom.plans.registry import Tables

DOMAIN_SQL = """
src AS (
  SELECT event_id, 'r' || lpad(event_id::VARCHAR, 9, '0') AS source_row_id, 'p' || (event_id % 3) AS partition_id, event_type AS source_id,
         user_id AS subject_id, ts AS event_time, ts + to_minutes((props->>'$.k')::INT) AS available_time, value, event_type AS code,
         user_id || '/' || event_type || '/' || strftime(ts, '%Y-%m-%d') AS eid
  FROM events),
links AS (
  SELECT eid AS event_id, source_row_id, partition_id,
         CASE WHEN source_row_id = min(source_row_id) OVER (PARTITION BY eid) THEN 'derived_from' ELSE 'duplicate_of' END AS relation
  FROM src),
facts AS (
  SELECT eid AS event_id, min(source_row_id) AS source_row_id, min(subject_id) AS subject_id, min(code) AS code, min(event_time) AS event_time,
         min(available_time) AS available_time, arg_min(value, source_row_id) AS value_number, count(*) AS n_rows,
         CASE WHEN count(DISTINCT partition_id) > 1 THEN 1 ELSE 0 END AS spread
  FROM src GROUP BY eid),
concepts AS (
  SELECT p_partkey AS concept_id, p_name AS concept_name, p_brand AS vocabulary_id, p_type AS domain_id, 'C.' || p_partkey AS concept_code,
         CASE WHEN p_size % 2 = 0 THEN 'S' END AS standard_concept, p_size <> 13 AS valid
  FROM part)
"""


def source_rows(t: Tables) -> DataFrame:
    minutes = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        "event_id",
        F.concat(F.lit("r"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("source_row_id"),
        F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("partition_id"),
        F.col("event_type").alias("source_id"),
        F.col("user_id").alias("subject_id"),
        F.col("ts").alias("event_time"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("available_time"),
        "value",
        F.col("event_type").alias("code"),
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("eid"),
    )


def links(t: Tables) -> DataFrame:
    return merge.merge_links(source_rows(t).select(F.col("eid").alias("event_id"), "source_row_id", "partition_id"))


def facts(t: Tables) -> DataFrame:
    rows = source_rows(t).select(F.col("eid").alias("event_id"), "source_row_id", "subject_id", "code", "event_time", "available_time", F.col("value").alias("value_number"))
    rules = {"event_time": merge.Rule("earliest", "TIME_MERGED"), "value_number": merge.Rule("keep_all_flag", "VALUES_DIFFER")}
    return merge.merge_events(rows, ["subject_id", "code", "event_time", "available_time", "value_number"], rules)


def concepts(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("concept_id"),
        F.col("p_name").alias("concept_name"),
        F.col("p_brand").alias("vocabulary_id"),
        F.col("p_type").alias("domain_id"),
        F.concat(F.lit("C."), F.col("p_partkey").cast("string")).alias("concept_code"),
        F.when(F.col("p_size") % 2 == 0, "S").alias("standard_concept"),
        (F.col("p_size") != 13).alias("valid"),
    )


def relations(t: Tables) -> DataFrame:
    """Each concept maps to the next even-sized neighbour two numbers on, and every tenth to a second one."""
    p = F.col("p_partkey")
    hop = t.part.select(p.alias("concept_id_1"), F.explode(F.when(p % 10 == 0, F.array(p + 2, p + 4)).otherwise(F.array(p + 2))).alias("concept_id_2"))
    return hop.withColumn("relationship_id", F.lit("Maps to"))


RELATIONS_SQL = """
relations AS (
  SELECT p_partkey AS concept_id_1, p_partkey + 2 AS concept_id_2 FROM part
  UNION ALL SELECT p_partkey, p_partkey + 4 FROM part WHERE p_partkey % 10 = 0)
"""


def visits(t: Tables) -> DataFrame:
    """Stays: an order from its date to its last shipment."""
    last = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("end_time"))
    o = t.orders.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("visit_id"), F.concat(F.lit("e"), (F.col("o_orderkey") / 2).cast("bigint").cast("string")).alias("encounter_id"), F.col("o_orderdate").alias("start_time"), "end_time")


VISITS_SQL = """
visits AS (
  SELECT o_custkey AS subject_id, o_orderkey AS visit_id, 'e' || (o_orderkey // 2) AS encounter_id, o_orderdate AS start_time, m AS end_time
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
"""
