"""Queries over shapes, merge rules, links, anchors and deaths."""

from pyspark.sql import functions as F

from sparkloom.operators import events, merge, relational
from sparkloom.plans.domain import DOMAIN_SQL, facts, links, source_rows
from sparkloom.plans.registry import query


@query(f"WITH {DOMAIN_SQL} SELECT event_id, source_row_id, partition_id, relation FROM links")
def link_relations(t):
    return links(t).select("event_id", "source_row_id", "partition_id", "relation")


@query(f"""WITH {DOMAIN_SQL} SELECT event_id, source_row_id, subject_id, event_time, available_time, value_number, n_rows FROM facts""")
def merge_survivor(t):
    return facts(t).select("event_id", "source_row_id", "subject_id", "event_time", "available_time", "value_number", "n_rows")


@query(f"""WITH {DOMAIN_SQL} SELECT eid AS event_id, min(event_time) AS event_time, max(available_time) AS available_time,
concat_ws(',', CASE WHEN min(event_time) <> max(event_time) THEN 'FIRST' END, CASE WHEN min(available_time) <> max(available_time) THEN 'LAST' END) AS flags FROM src GROUP BY 1""")
def merge_earliest(t):
    rows = source_rows(t).select(F.col("eid").alias("event_id"), "source_row_id", "event_time", "available_time")
    out = merge.merge_events(rows, ["event_time", "available_time"], {"event_time": merge.Rule("earliest", "FIRST"), "available_time": merge.Rule("latest", "LAST")})
    return out.select("event_id", "event_time", "available_time", F.array_join("quality_flags", ",").alias("flags"))


@query(f"""WITH {DOMAIN_SQL}, g AS (SELECT eid, min(partition_id) AS a, max(partition_id) AS b, bool_or(partition_id = 'p2') AS two, bool_or(partition_id = 'p1') AS one, arg_min(partition_id, source_row_id) AS own FROM src GROUP BY 1)
SELECT eid AS event_id, CASE WHEN a = b THEN own WHEN two THEN 'p2' WHEN one THEN 'p1' ELSE own END AS partition_id,
concat_ws(',', CASE WHEN a <> b AND one AND two THEN 'BOTH' END, CASE WHEN a <> b AND NOT one AND NOT two THEN 'MERGE_CONFLICT' END) AS flags FROM g""")
def merge_priority(t):
    rows = source_rows(t).select(F.col("eid").alias("event_id"), "source_row_id", "partition_id")
    out = merge.merge_events(rows, ["partition_id"], {"partition_id": merge.Rule("priority", "BOTH", order=("P2", "p1"), conflict_when=(("p1", "p2"),))})
    return out.select("event_id", "partition_id", F.array_join("quality_flags", ",").alias("flags"))


@query(f"""WITH {DOMAIN_SQL}, g AS (SELECT eid, min(value) AS a, max(value) AS b FROM src GROUP BY 1)
SELECT eid AS event_id, CASE WHEN a = b THEN a END AS value, CASE WHEN a <> b THEN 'VALUES_REFUSED' ELSE '' END AS flags,
  (SELECT count(*) FROM src s WHERE s.eid = g.eid AND g.a <> g.b)::BIGINT AS refused FROM g""")
def merge_null_and_flag(t):
    rows = source_rows(t).select(F.col("eid").alias("event_id"), "source_row_id", "value")
    out = merge.merge_events(rows, ["value"], {"value": merge.Rule("null_and_flag", "VALUES_REFUSED")})
    refused = merge.conflicting_values(rows, "value").groupBy("event_id").agg(F.count("*").alias("refused"))
    return out.join(refused, "event_id", "left").select("event_id", "value", F.array_join("quality_flags", ",").alias("flags"), F.coalesce("refused", F.lit(0)).alias("refused"))


@query(f"""WITH {DOMAIN_SQL}, g AS (SELECT eid, min(partition_id) AS a, max(partition_id) AS b, min(CASE WHEN value > 60 THEN partition_id END) AS la, max(CASE WHEN value > 60 THEN partition_id END) AS lb FROM src GROUP BY 1)
SELECT eid AS event_id, CASE WHEN a = b THEN a WHEN la = lb THEN la END AS encounter, CASE WHEN a = b THEN '' WHEN coalesce(la = lb, false) THEN 'ENCOUNTER_FROM_LINKED_ROW' ELSE 'NO_LINK' END AS flags FROM g""")
def merge_prefer_linked(t):
    rows = source_rows(t).select(F.col("eid").alias("event_id"), "source_row_id", F.col("partition_id").alias("encounter"), F.when(F.col("value") > 60, "Y").otherwise("N").alias("linked"))
    out = merge.merge_events(rows, ["encounter"], {"encounter": merge.Rule("prefer_linked", "NO_LINK", linked_by="linked")})
    return out.select("event_id", "encounter", F.array_join("quality_flags", ",").alias("flags"))


@query(f"""WITH {DOMAIN_SQL} SELECT eid AS event_id, arg_min(value, source_row_id) AS value, min(available_time) AS available_time,
concat_ws(',', CASE WHEN min(available_time) <> max(available_time) THEN 'AVAILABILITY_MERGED' END, CASE WHEN min(value) <> max(value) THEN 'MERGE_CONFLICT' END) AS flags,
CASE WHEN min(value) <> max(value) THEN 'value' ELSE '' END AS conflicts FROM src GROUP BY 1""")
def merge_default_rules(t):
    rows = source_rows(t).select(F.col("eid").alias("event_id"), "source_row_id", "value", "available_time")
    out = merge.merge_events(rows, ["value", "available_time"])
    return out.select("event_id", "value", "available_time", F.array_join("quality_flags", ",").alias("flags"), F.array_join("conflicts", ",").alias("conflicts"))


@query(f"WITH {DOMAIN_SQL} SELECT event_id, CASE WHEN spread = 1 THEN 'DUPLICATE_ACROSS_PARTITIONS' ELSE '' END AS flags FROM facts")
def cross_partition_flag(t):
    e = facts(t).select("event_id", F.array().cast("array<string>").alias("quality_flags"))
    return merge.cross_partition(e, links(t)).select("event_id", F.array_join("quality_flags", ",").alias("flags"))


@query(f"""WITH {DOMAIN_SQL}, a AS (SELECT subject_id, event_time::DATE AS anchor_date, partition_id, event_time, event_id % 2 = 0 AS known, source_row_id FROM src)
SELECT subject_id, anchor_date, partition_id, arg_min(event_time, row(NOT known, source_row_id)) AS event_time, bool_or(known) AS known FROM a GROUP BY 1, 2, 3""")
def anchor_upgrade(t):
    a = source_rows(t).select("subject_id", F.col("event_time").cast("date").alias("anchor_date"), "partition_id", "event_time", (F.col("event_id") % 2 == 0).alias("known"), "source_row_id")
    return merge.merge_anchors(a, ["subject_id", "anchor_date", "partition_id"], "known", "source_row_id").drop("source_row_id")


@query("""WITH e AS (SELECT user_id, event_type, max(length(props)) AS x FROM events GROUP BY 1, 2)
SELECT user_id, min(event_type) AS event_type FROM e GROUP BY 1""")
def record_dedup(t):
    return merge.dedup_records(t.events.select("user_id", "event_type"), ["user_id"])


_DEATH = """deaths AS (SELECT user_id AS subject_id, event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) ELSE ts END AS event_time FROM events WHERE event_type = 'error' AND value > 95)"""


def _deaths(t):
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    return t.events.where("event_type = 'error' AND value > 95").select(F.col("user_id").alias("subject_id"), "event_id", F.when(F.col("event_id") % 2 == 0, day).otherwise(F.col("ts")).alias("event_time"))


@query(f"""WITH {_DEATH}, g AS (SELECT subject_id, min(event_time::DATE) AS a, max(event_time::DATE) AS b,
  arg_min(event_id, row(date_trunc('day', event_time) = event_time, event_time, event_id)) AS event_id FROM deaths GROUP BY 1)
SELECT subject_id, a = b AS published, CASE WHEN a = b THEN event_id END AS event_id, a AS first_date, b AS last_date FROM g""")
def one_death_per_day(t):
    best, conflict = merge.one_death(_deaths(t), F.col("event_time").cast("date"))
    a = best.select("subject_id", F.lit(True).alias("published"), "event_id", F.col("death_date").alias("first_date"), F.col("death_date").alias("last_date"))
    return a.unionByName(conflict.select("subject_id", F.lit(False).alias("published"), F.lit(None).cast("bigint").alias("event_id"), "first_date", "last_date"))


@query(f"""WITH {_DEATH}, f AS (SELECT subject_id, min(event_time) AS d FROM deaths GROUP BY 1)
SELECT event_id, coalesce(ts > d + INTERVAL 1 DAY, false) AS after_death FROM events LEFT JOIN f ON user_id = subject_id""")
def post_death_flag(t):
    e = t.events.select("event_id", F.col("user_id").alias("subject_id"), F.col("ts").alias("event_time"))
    return merge.flag_after_death(e, _deaths(t)).select("event_id", "after_death")


@query(f"""WITH {DOMAIN_SQL} SELECT DISTINCT CASE WHEN code = 'view' THEN subject_id || '/view' ELSE event_id END AS event_id, source_row_id, partition_id
FROM links JOIN facts USING (event_id, source_row_id) """.replace("links JOIN facts USING (event_id, source_row_id)", "(SELECT l.event_id, l.source_row_id, l.partition_id, f.subject_id, f.code FROM links l JOIN facts f ON l.event_id = f.event_id)"))
def link_rewrite(t):
    moved = facts(t).where("code = 'view'").select("event_id", F.concat(F.col("subject_id").cast("string"), F.lit("/view")).alias("kept_id"))
    return merge.rewrite_links(links(t).drop("relation"), moved).select("event_id", "source_row_id", "partition_id")


_CAUSE = "x AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS declares, CASE WHEN event_id % 3 = 0 THEN user_id % 40 END AS caused_by FROM events)"


def _causes(t):
    i, u = F.col("event_id"), F.col("user_id")
    return t.events.select("event_id", F.when(i % 2 == 0, u).alias("declares"), F.when(i % 3 == 0, u % 40).alias("caused_by"))


@query(f"WITH {_CAUSE}, f AS (SELECT declares, min(event_id) AS c FROM x WHERE declares IS NOT NULL GROUP BY 1) SELECT x.event_id, CASE WHEN f.c <> x.event_id THEN f.c END AS cause_id FROM x LEFT JOIN f ON x.caused_by = f.declares")
def caused_by_resolution(t):
    return relational.resolve_causes(_causes(t), "declares", "caused_by").select("event_id", "cause_id")


@query(f"WITH {_CAUSE} SELECT event_id, 'declares' AS role, declares AS key FROM x WHERE declares IS NOT NULL UNION ALL SELECT event_id, 'caused_by', caused_by FROM x WHERE caused_by IS NOT NULL")
def action_keys(t):
    return events.action_keys(_causes(t), F.col("declares"), F.col("caused_by"))


@query("""SELECT user_id AS subject_id, kind, event_type AS code, ts AS event_time, value AS value_number, count(*) AS n FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'condition' ELSE 'measurement' END AS kind FROM events) GROUP BY ALL""")
def point_events(t):
    kind = relational.switch(F.col("event_type"), {"error": "condition"}, "measurement")
    e = events.point_event(t.events, subject="user_id", kind=kind, code="event_type", time="ts", value="value")
    return e.groupBy("event_id", "subject_id", "kind", "code", "event_time", "value_number").agg(F.count("*").alias("n")).drop("event_id")


@query("""SELECT c_custkey AS subject_id, unnest(['c_mktsegment', 'c_name']) AS code, unnest([c_mktsegment, c_name]) AS value_text FROM customer""")
def unpivot_attributes(t):
    return events.person_attributes(t.customer, "c_custkey", ["c_mktsegment", "c_name"])


@query("""SELECT o_orderkey, name, value FROM (SELECT o_orderkey, unnest(['systolic', 'diastolic']) AS name, unnest([o_custkey::DOUBLE, (o_orderkey % 90)::DOUBLE]) AS value FROM orders WHERE o_orderkey % 5 <> 0)""")
def split_cell_two_rows(t):
    cell = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.concat_ws(" / ", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 90).cast("string")))
    return relational.split_pair(t.orders.select("o_orderkey", cell.alias("cell")), "cell", ("systolic", "diastolic"))


@query("""SELECT conv_id, nullif(string_agg(text, chr(10) ORDER BY turn, text), '') AS text, count(*)::INT AS n_lines FROM (SELECT DISTINCT conv_id, turn, coalesce(text, '') AS text FROM conversations) GROUP BY 1""")
def narrative_document(t):
    return relational.narrative(t.conversations, ["conv_id"], "turn", "text")


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber::VARCHAR AS component, l_quantity AS value FROM lineitem)
SELECT l_orderkey, 'study' AS kind, NULL AS component, count(*)::DOUBLE AS value, 0 AS has_parent FROM lineitem GROUP BY 1
UNION ALL SELECT l_orderkey, 'component', component, value, 1 FROM p""")
def component_parent(t):
    e = events.component_measurements(t.lineitem.withColumn("line", F.col("l_linenumber").cast("string")), group=["l_orderkey"], component="line", value="l_quantity")
    parents = e.where("parent_event_id IS NULL").select(F.col("event_id").alias("parent_event_id"), F.lit(1).alias("found"))
    return e.join(parents, "parent_event_id", "left").select("l_orderkey", "kind", "component", "value", F.coalesce("found", F.lit(0)).alias("has_parent"))


@query(f"""WITH {DOMAIN_SQL} SELECT subject_id::VARCHAR AS person_source_id, (('0x' || substr(sha256('' || chr(31) || 'demo' || chr(31) || subject_id), 1, 16))::UBIGINT % 9223372036854775808)::BIGINT AS subject_id,
string_agg(DISTINCT partition_id, ',' ORDER BY partition_id) AS partitions FROM src GROUP BY subject_id""")
def identity_map(t):
    m = events.resolve_identity(source_rows(t), "subject_id", "partition_id", "demo")
    return m.select("person_source_id", "subject_id", F.array_join("partitions", ",").alias("partitions"))


@query(f"WITH {DOMAIN_SQL} SELECT partition_id, count(DISTINCT subject_id) AS subjects FROM src GROUP BY 1")
def partition_overlap(t):
    return events.partition_overlap(events.resolve_identity(source_rows(t), "subject_id", "partition_id", "demo"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 AND event_type <> 'signup' THEN 'MISSING_EVENT_TIME' ELSE 'kept' END AS reason FROM events""")
def untimed_quarantine(t):
    e = t.events.select("event_id", F.col("event_type").alias("kind"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("event_time"))
    kept, refused = events.quarantine_untimed(e, ["signup"])
    return kept.select("event_id", F.lit("kept").alias("reason")).unionByName(refused.select("event_id", "reason"))


@query(f"""WITH {DOMAIN_SQL} SELECT f.event_id, f.code, l.source_row_id, l.relation FROM facts f LEFT JOIN links l ON f.event_id = l.event_id WHERE f.subject_id = 11""")
def patient_trace(t):
    one = facts(t).select("subject_id").where("subject_id = 11").distinct()
    return events.trace(one, facts(t), links(t).withColumnRenamed("source_row_id", "row_id")).select("event_id", "code", F.col("row_id").alias("source_row_id"), "relation")
