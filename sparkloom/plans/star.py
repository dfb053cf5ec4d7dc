"""Queries over notes, maps of distinct values, single lookups, proposals and numeric columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import units, values
from sparkloom.operators import publish, terminology
from sparkloom.plans.domain import DOMAIN_SQL, RELATIONS_SQL, VISITS_SQL, concepts, relations, visits
from sparkloom.plans.registry import query


@query(f"""WITH {VISITS_SQL}, k AS (SELECT subject_id AS person_id, encounter_id, min(visit_id) AS visit_id FROM visits GROUP BY 1, 2)
SELECT o_orderkey AS event_id, o_custkey AS person_id, (o_orderdate - INTERVAL 5 HOUR)::DATE AS note_date, o_orderdate - INTERVAL 5 HOUR AS note_datetime, 44::INT AS note_type_concept_id, 0::INT AS note_class_concept_id,
  o_orderpriority AS note_title, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS note_text, k.visit_id AS visit_occurrence_id, o_orderstatus AS note_source_value
FROM orders LEFT JOIN k ON k.person_id = o_custkey AND k.encounter_id = 'e' || (o_orderkey // 2) WHERE o_custkey % 10 <> 0""")
def note_rows(t):
    notes = t.orders.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("subject_id"), F.lit("note").alias("kind"), F.col("o_orderdate").alias("event_time"), F.col("o_orderpriority").alias("name"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("value_text"), F.concat(F.lit("e"), (F.col("o_orderkey") / 2).cast("bigint").cast("string")).alias("encounter_id"), F.col("o_orderstatus").alias("code"),
    )
    persons = t.customer.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("subject_id"), F.col("c_custkey").alias("person_id"))
    lookup = publish.visit_lookup(visits(t)).withColumnRenamed("subject_id", "person_id")
    return publish.note_rows(notes, persons, lookup, {"note": 44}, zone="Etc/GMT+5")


@query("""WITH d AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN p_size || ' MG' WHEN 1 THEN p_size || '.5 furlong' WHEN 2 THEN p_size::VARCHAR WHEN 3 THEN p_size || '-' || (p_size + 1) WHEN 4 THEN '50011036050561' || (1000 + p_size) ELSE 'as told' END AS dose, p_partkey % 6 AS k, p_size FROM part)
SELECT dose, CASE k WHEN 0 THEN p_size::DOUBLE WHEN 2 THEN p_size::DOUBLE END AS quantity, CASE k WHEN 0 THEN 'MG' END AS dose_unit FROM d GROUP BY ALL""")
def dose_map(t):
    k, s = F.col("p_partkey") % 6, F.col("p_size")
    dose = (
        F.when(k == 0, F.concat(s, F.lit(" MG"))).when(k == 1, F.concat(s, F.lit(".5 furlong"))).when(k == 2, s.cast("string"))
        .when(k == 3, F.concat(s, F.lit("-"), s + 1)).when(k == 4, F.concat(F.lit("50011036050561"), s + 1000)).otherwise("as told")
    )
    return publish.dose_map(t.part.select(dose.alias("d")), "d", ["mg"])


_REGISTERED = [("DISCHARGE", "automobile", 2), ("DISCHARGE", "building", 999999999), ("GENDER", "machinery", 4), ("TYPE_CONCEPT", "note", 44), ("TYPE_CONCEPT", "drug order", 7)]
_REGISTRY_SQL = "registry AS (SELECT * FROM (VALUES ('DISCHARGE', 'automobile', 2), ('DISCHARGE', 'building', 999999999), ('GENDER', 'machinery', 4), ('TYPE_CONCEPT', 'note', 44), ('TYPE_CONCEPT', 'drug order', 7)) r(code_system, term_key, concept_id))"


def _registry(t):
    return t.spark.createDataFrame(_REGISTERED, "code_system string, term_key string, concept_id long")


@query(f"""WITH {_REGISTRY_SQL} SELECT DISTINCT c_mktsegment AS value, coalesce(concept_id, 0)::BIGINT AS concept_id FROM customer
LEFT JOIN registry ON code_system = 'DISCHARGE' AND term_key = lower(c_mktsegment) AND concept_id IN (SELECT p_partkey FROM part)""")
def discharge_map(t):
    return publish.approved_map(t.customer, "DISCHARGE", "c_mktsegment", _registry(t), concepts(t))


@query(f"""WITH {DOMAIN_SQL}, {_REGISTRY_SQL}, v AS (SELECT DISTINCT 'GENDER' AS attribute, c_mktsegment AS value FROM customer UNION SELECT 'RACE', upper(p_name) FROM part),
n AS (SELECT domain_id, lower(concept_name) AS f, min(concept_id) AS c FROM concepts WHERE standard_concept = 'S' AND valid GROUP BY 1, 2)
SELECT v.attribute, v.value, coalesce(r.concept_id, n.c, 0)::BIGINT AS concept_id FROM v LEFT JOIN registry r ON r.code_system = v.attribute AND r.term_key = lower(v.value)
LEFT JOIN n ON n.domain_id = CASE v.attribute WHEN 'GENDER' THEN 'SMALL' ELSE 'ECONOMY' END AND n.f = lower(v.value)""")
def attribute_map(t):
    v = t.customer.select(F.lit("gender").alias("attribute"), F.col("c_mktsegment").alias("value")).union(t.part.select(F.lit("Race"), F.upper("p_name")))
    return publish.attribute_map(v, _registry(t), concepts(t), {"GENDER": "SMALL", "RACE": "ECONOMY"})


@query("""SELECT key, CASE key WHEN 'note' THEN 44 ELSE 0 END::BIGINT AS concept_id FROM (VALUES ('visit'), ('condition_problem_list'), ('drug_order'), ('drug_admin'), ('procedure'), ('measurement'), ('note'), ('note_class'), ('death'), ('observation'), ('observation_period'), ('visit_detail')) k(key)""")
def type_concepts(t):
    return publish.type_concepts(t.spark, _registry(t))


@query(f"""WITH {DOMAIN_SQL}, {RELATIONS_SQL},
s AS (SELECT * FROM concepts WHERE vocabulary_id = (SELECT p_brand FROM part WHERE p_partkey = 7) AND concept_code = 'C.7'),
d AS (SELECT concept_id, domain_id, NULL::BIGINT AS source_concept_id, 'standard' AS path FROM s WHERE standard_concept = 'S' AND valid),
m AS (SELECT c.concept_id, c.domain_id, s.concept_id AS source_concept_id, CASE WHEN s.valid THEN 'mapped_relationship' ELSE 'mapped_relationship_retired' END AS path
      FROM s JOIN relations r ON r.concept_id_1 = s.concept_id JOIN concepts c ON c.concept_id = r.concept_id_2 AND c.standard_concept = 'S' WHERE NOT coalesce(s.standard_concept = 'S' AND s.valid, false) ORDER BY c.concept_id LIMIT 1),
n AS (SELECT concept_id, domain_id FROM concepts WHERE lower(concept_name) = (SELECT lower(p_name) FROM part WHERE p_partkey = 12) AND domain_id = (SELECT p_type FROM part WHERE p_partkey = 12) AND standard_concept = 'S' AND valid ORDER BY concept_id LIMIT 1)
SELECT 'code' AS lookup, concept_id, domain_id, source_concept_id, path FROM (SELECT * FROM d UNION ALL SELECT * FROM m)
UNION ALL SELECT 'name', concept_id, domain_id, NULL, NULL FROM n
UNION ALL SELECT 'exists', 12, (SELECT p_type FROM part WHERE p_partkey = 12), NULL, 'true'
UNION ALL SELECT 'exists', 999999999, NULL, NULL, 'false'""")
def single_lookups(t):
    c, r = concepts(t), relations(t)
    of = {x["p_partkey"]: x for x in t.part.where("p_partkey IN (7, 12)").collect()}
    code = terminology.by_code(c, r, of[7]["p_brand"], "C.7").select(F.lit("code").alias("lookup"), "concept_id", "domain_id", "source_concept_id", "path")
    name = terminology.by_name(c, of[12]["p_type"], of[12]["p_name"].upper()).select(F.lit("name").alias("lookup"), "concept_id", "domain_id")
    known = [("exists", i, terminology.domain_of(c, i), str(terminology.concept_exists(c, i)).lower()) for i in (12, 999999999)]
    exists = t.spark.createDataFrame(known, "lookup string, concept_id long, domain_id string, path string")
    return code.unionByName(name, allowMissingColumns=True).unionByName(exists, allowMissingColumns=True)


@query(f"""WITH {DOMAIN_SQL}, {RELATIONS_SQL}, w(code) AS (VALUES ('C.24'), ('c7'), ('C.999999999')), k AS (SELECT (SELECT p_brand FROM part WHERE p_partkey = CASE code WHEN 'C.24' THEN 24 ELSE 7 END) AS code_system, code FROM w),
x AS (SELECT k.code, s.concept_id FROM k JOIN concepts c ON c.vocabulary_id = k.code_system AND (c.concept_code = k.code OR (k.code = 'c7' AND c.concept_code = 'C.7')) JOIN relations r ON r.concept_id_1 = c.concept_id JOIN concepts s ON s.concept_id = r.concept_id_2 AND s.standard_concept = 'S' AND s.valid)
SELECT k.code_system, k.code, min(x.concept_id) AS concept_id, CASE WHEN count(x.concept_id) = 0 THEN NULL ELSE CASE WHEN k.code = 'c7' THEN 'unpunctuated' ELSE 'exact' END || CASE WHEN count(DISTINCT x.concept_id) > 1 THEN '_ambiguous' ELSE '' END END AS path
FROM k LEFT JOIN x ON x.code = k.code GROUP BY 1, 2""")
def resolve_one_term(t):
    of = {x["p_partkey"]: x["p_brand"] for x in t.part.where("p_partkey IN (7, 24)").collect()}
    empty = _registry(t).where("code_system = 'none'")
    out = None
    for code, part in (("C.24", 24), ("c7", 7), ("C.999999999", 7)):
        one = terminology.resolve_one(of[part], code, empty, concepts(t), relations(t)).select("code_system", "code", "concept_id", "path")
        out = one if out is None else out.unionByName(one)
    return out


_QUEUE_SQL = "q AS (SELECT 't' || p_partkey AS item_id, p_name AS term, p_name AS code, (p_size % 7)::BIGINT AS occurrences, CASE WHEN p_partkey % 3 = 0 THEN 'resolved' ELSE 'open' END AS status FROM part)"


def _queue(t):
    status = F.when(F.col("p_partkey") % 3 == 0, "resolved").otherwise("open")
    return t.part.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("item_id"), F.col("p_name").alias("term"), F.col("p_name").alias("code"), (F.col("p_size") % 7).cast("bigint").alias("occurrences"), status.alias("status"))


@query(f"WITH {_QUEUE_SQL} SELECT place, occurrences, code FROM (SELECT *, row_number() OVER (ORDER BY occurrences DESC, code) AS place FROM q)")
def review_order(t):
    return terminology.review_order(_queue(t)).select("place", "occurrences", "code")


@query(f"""WITH {DOMAIN_SQL}, {_QUEUE_SQL}, top AS (SELECT * FROM q WHERE status = 'open' ORDER BY occurrences DESC, term, item_id LIMIT 20),
w AS (SELECT item_id, unnest(list_distinct(string_split(lower(term), ' '))) AS w FROM top), c AS (SELECT concept_id, concept_name, unnest(list_distinct(string_split(lower(concept_name), ' '))) AS w FROM concepts WHERE standard_concept = 'S' AND valid),
h AS (SELECT item_id, concept_id, concept_name, count(*) AS hits FROM w JOIN c USING (w) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, length(concept_name), concept_id) AS n FROM h)
SELECT top.item_id, term, occurrences, coalesce('[' || (SELECT string_agg('{{"concept_id":' || concept_id || ',"concept_name":"' || concept_name || '","hits":' || hits || '}}', ',' ORDER BY n) FROM r WHERE r.item_id = top.item_id AND n <= 3) || ']', '[]') AS candidates FROM top""")
def terminology_proposals(t):
    return terminology.propose(_queue(t), concepts(t), 20, 3)


@query("""SELECT * FROM (VALUES ('c_name', 'person_name', 0.5::DOUBLE), ('c_acctbal', NULL, NULL), ('c_nationkey', 'nation', 1 / 3.0::DOUBLE), ('ORDER-date', 'order_time', 1.0::DOUBLE)) v(name, role, score) WHERE role IS NOT NULL AND name <> 'c_nationkey'""")
def column_proposals(t):
    profile = t.spark.createDataFrame([("c_name",), ("c_acctbal",), ("c_nationkey",), ("ORDER-date",)], "name string")
    return terminology.propose_columns(profile, {"person_name": ("name", "full name of the person"), "nation": ("nation key",), "order_time": ("order date", "ordered at")})


@query(f"""WITH {DOMAIN_SQL}, c AS (SELECT p_type AS term, concept_id, concept_name FROM (SELECT p_type, p_partkey AS concept_id, p_name AS concept_name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) WHERE n <= 4)
SELECT term, concept_id, concept_name, row_number() OVER (PARTITION BY term ORDER BY length(concept_name), concept_id)::INT AS rank FROM c""")
def model_ranking(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey"))
    c = t.part.select(F.col("p_type").alias("term"), F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_name"), n.alias("rank")).where("rank <= 4")
    return terminology.rank_with_model(c, lambda term, names: sorted(range(len(names)), key=lambda i: len(names[i])))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'refused' ELSE 'kept' END AS outcome, CASE WHEN o_orderkey % 5 IN (1, 2) THEN (o_orderkey % 100)::DOUBLE END AS number, CASE WHEN o_orderkey % 5 = 0 THEN '3 SINUS ' || o_orderpriority END AS preview FROM orders""")
def numeric_expectation(t):
    k = F.col("o_orderkey")
    n = (k % 100).cast("string")
    cell = F.when(k % 5 == 0, F.concat(F.lit(" 3 SINUS "), "o_orderpriority")).when(k % 5 == 1, n).when(k % 5 == 2, F.concat(n, F.lit(" mg"))).when(k % 5 == 3, F.concat(F.lit("<"), n)).otherwise("pending")
    good, bad = values.numeric_or_quarantine(t.orders.select("o_orderkey", cell.alias("cell")), "cell", known_units=["mg"])
    kept = good.select("o_orderkey", F.lit("kept").alias("outcome"), F.col("parsed.number").alias("number"), F.lit(None).cast("string").alias("preview"))
    return kept.unionByName(bad.select("o_orderkey", F.lit("refused").alias("outcome"), F.lit(None).cast("double").alias("number"), "preview"))


@query("""SELECT * FROM (VALUES ('mmol/L', 'mol/l'), ('umol/L', 'mol/l'), ('mg/dL', 'g/l'), ('10*3/uL', '1/l'), ('ng/mL', 'g/l'), ('mEq/L', 'mol/l'), ('kg/m2', 'g/m'), ('h', 'h'), ('[degF]', '[degf]')) v(unit, family)""")
def unit_family_reduction(t):
    u = F.element_at(F.array(*[F.lit(x) for x in ("mmol/L", "umol/L", "mg/dL", "10*3/uL", "ng/mL", "mEq/L", "kg/m2", "h", "[degF]")]), (F.col("p_partkey") % 9 + 1).cast("int"))
    return units.unit_families(t.part.select(u.alias("unit")))


@query("""SELECT * FROM (VALUES ('degF', 'cel'), ('Cel', 'cel'), ('K', 'cel'), ('mg/dL', 'g/l'), ('mmol/L', 'g/l'), ('h', 'h')) v(unit, family)""")
def unit_families_linked(t):
    s = t.spark
    given = s.createDataFrame([(x,) for x in ("degF", "Cel", "K", "mg/dL", "mmol/L", "h")], "unit string")
    conversions = s.createDataFrame([("degF", "Cel"), ("K", "degF"), ("mmol/L", "mg/dL")], "from_ucum string, to_ucum string")
    return units.families_under_conversions(given, conversions)
