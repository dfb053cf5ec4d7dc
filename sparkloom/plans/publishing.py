"""Queries over publication, terminology, drugs and review."""

from pyspark.sql import functions as F

from sparkloom.operators import drugs, publish, relational, terminology
from sparkloom.plans.domain import DOMAIN_SQL, RELATIONS_SQL, VISITS_SQL, concepts, facts, links, relations, visits
from sparkloom.plans.registry import query

_TERMS_SQL = """terms AS (SELECT 'EV' AS code_system, t.code, t.concept_id, t.domain_id FROM (VALUES ('error', 11, 'Condition'), ('error', 12, 'Observation'), ('purchase', 13, 'Drug'), ('view', 14, 'Meas Value')) t(code, concept_id, domain_id))"""
_EVENTS_SQL = """ev AS (SELECT *, 'EV' AS code_system, CASE code WHEN 'error' THEN 'measurement' WHEN 'purchase' THEN 'drug_admin' WHEN 'view' THEN 'observation' WHEN 'signup' THEN 'procedure' ELSE 'condition' END AS kind,
  CASE WHEN n_rows > 3 THEN 'NOT_ADMINISTERED' END AS held FROM facts)"""


def _terms(t):
    rows = [("EV", "error", 11, "Condition"), ("EV", "error", 12, "Observation"), ("EV", "purchase", 13, "Drug"), ("EV", "view", 14, "Meas Value")]
    return t.spark.createDataFrame(rows, "code_system string, code string, concept_id int, domain_id string")


def _events(t):
    kind = relational.switch(F.col("code"), {"error": "measurement", "purchase": "drug_admin", "view": "observation", "signup": "procedure"}, "condition")
    flags = F.when(F.col("n_rows") > 3, F.array(F.lit("NOT_ADMINISTERED"))).otherwise(F.array().cast("array<string>"))
    return facts(t).withColumns({"code_system": F.lit("EV"), "kind": kind, "quality_flags": flags})


@query(f"""WITH {DOMAIN_SQL}, {_EVENTS_SQL}, {_TERMS_SQL}, j AS (
  SELECT ev.*, concept_id, CASE WHEN domain_id IN ('Condition', 'Drug', 'Procedure', 'Measurement', 'Observation') THEN domain_id END AS d FROM ev LEFT JOIN terms USING (code_system, code)
  WHERE held IS NULL AND subject_id % 10 <> 0)
SELECT CASE coalesce(d, kind) WHEN 'Condition' THEN 'condition_occurrence' WHEN 'condition' THEN 'condition_occurrence' WHEN 'Drug' THEN 'drug_exposure' WHEN 'drug_admin' THEN 'drug_exposure'
  WHEN 'procedure' THEN 'procedure_occurrence' WHEN 'measurement' THEN 'measurement' ELSE 'observation' END AS table_name, event_id, coalesce(concept_id, 0) AS concept_id, value_number FROM j""")
def domain_routing(t):
    persons = facts(t).select("subject_id").distinct().where("subject_id % 10 <> 0")
    e, out = publish.publishable(_events(t), persons), None
    for table in publish.ROUTES:
        rows = publish.fact_rows(e, _terms(t), table).select(F.lit(table).alias("table_name"), "event_id", "concept_id", "value_number")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {DOMAIN_SQL}, {_EVENTS_SQL}, {_TERMS_SQL}
SELECT 'condition_occurrence' AS table_name, l.event_id, l.source_row_id, l.relation FROM links l JOIN ev USING (event_id) WHERE (code = 'error') OR (code = 'click')""")
def star_lineage(t):
    rows = publish.fact_rows(_events(t), _terms(t), "condition_occurrence")
    return publish.lineage(rows, links(t), "condition_occurrence")


@query(f"""WITH {DOMAIN_SQL}, {_EVENTS_SQL}, {_TERMS_SQL}, b AS (SELECT code_system, code, min(concept_id) AS concept_id FROM terms GROUP BY ALL)
SELECT event_id, subject_id, event_time AS time, CASE WHEN concept_id IS NULL THEN 'SOURCE/EV/' || code ELSE 'OMOP/' || concept_id END AS code, available_time,
  concat_ws(',', held, CASE WHEN concept_id IS NULL THEN 'UNMAPPED' END) AS flags, (SELECT string_agg(source_row_id, ',' ORDER BY source_row_id) FROM links l WHERE l.event_id = ev.event_id) AS rows
FROM ev LEFT JOIN b USING (code_system, code)""")
def event_stream(t):
    s = publish.stream_rows(_events(t), _terms(t), links(t))
    return s.select("event_id", "subject_id", "time", "code", "available_time", F.array_join("quality_flags", ",").alias("flags"), F.array_join("source_row_ids", ",").alias("rows"))


@query(f"""WITH {DOMAIN_SQL}, s AS (SELECT event_id, CASE code WHEN 'error' THEN 'OMOP/11' WHEN 'purchase' THEN 'OMOP/13' WHEN 'view' THEN 'OMOP/14' ELSE 'SOURCE/EV/' || code END AS code, 'name ' || (subject_id % 3) AS name FROM facts),
c AS (SELECT code, name, count(*) AS n FROM s GROUP BY ALL)
SELECT code, sum(n)::BIGINT AS n_events, arg_min(name, row(-n, name)) AS description FROM c GROUP BY 1""")
def code_metadata(t):
    s = publish.stream_rows(_events(t), _terms(t), links(t))
    names = facts(t).select("event_id", F.concat(F.lit("name "), (F.col("subject_id") % 3).cast("string")).alias("name"))
    return publish.code_metadata(s, names)


@query("""WITH s AS (SELECT DISTINCT user_id AS subject_id, ('0x' || substr(sha256('' || chr(31) || 'split' || chr(31) || user_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS p FROM events),
x AS (SELECT subject_id, CASE WHEN p < 0.8 THEN 'train' WHEN p < 0.9 THEN 'tuning' ELSE 'held_out' END AS split FROM s)
SELECT subject_id, split, ((row_number() OVER (PARTITION BY split ORDER BY subject_id) - 1) // 16)::INT AS shard FROM x""")
def subject_shards(t):
    subjects = t.events.select(F.col("user_id").alias("subject_id")).distinct()
    return publish.subject_shards(publish.subject_splits(subjects), 16)


@query(f"""WITH {DOMAIN_SQL} SELECT subject_id, min(event_time)::DATE AS start_date, max(event_time)::DATE AS end_date FROM facts WHERE n_rows <= 3 GROUP BY 1""")
def observation_period(t):
    e = _events(t).withColumn("end_time", F.lit(None).cast("timestamp_ntz"))
    return publish.observation_period(e, "NOT_ADMINISTERED")


_ATTRIBUTES = "a AS (SELECT o_custkey AS subject_id, 'year' AS code, CASE WHEN o_custkey % 20 = 0 THEN year(o_orderdate)::VARCHAR ELSE '1990' END AS v FROM orders UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer)"


@query(f"""WITH {_ATTRIBUTES} SELECT subject_id, min(CASE WHEN code = 'year' THEN v END) AS year, min(CASE WHEN code = 'segment' THEN v END) AS segment,
coalesce(min(CASE WHEN code = 'year' THEN v END) = max(CASE WHEN code = 'year' THEN v END), true) AS published FROM a GROUP BY 1""")
def person_policy(t):
    year = F.when(F.col("o_custkey") % 20 == 0, F.year("o_orderdate").cast("string")).otherwise("1990")
    a = t.orders.select(F.col("o_custkey").alias("subject_id"), F.lit("year").alias("code"), year.alias("value_text"))
    a = a.unionByName(t.customer.select(F.col("c_custkey").alias("subject_id"), F.lit("segment").alias("code"), F.col("c_mktsegment").alias("value_text")))
    ok, blocked = publish.person_rows(a, ["year", "segment"], "year")
    held = a.join(blocked, "subject_id", "left_semi").groupBy("subject_id").agg(F.min(F.when(F.col("code") == "year", F.col("value_text"))).alias("year"), F.min(F.when(F.col("code") == "segment", F.col("value_text"))).alias("segment"))
    return ok.withColumn("published", F.lit(True)).unionByName(held.withColumn("published", F.lit(False)))


@query(f"WITH {VISITS_SQL} SELECT subject_id, encounter_id, min(visit_id) AS visit_id FROM visits GROUP BY 1, 2")
def visit_lookup(t):
    return publish.visit_lookup(visits(t))


@query(f"""WITH {VISITS_SQL}, d AS (SELECT o_orderkey AS detail_id, o_custkey AS subject_id, CASE WHEN o_orderkey % 3 = 0 THEN 'e' || (o_orderkey // 2) ELSE 'x' END AS encounter_id, o_orderdate + INTERVAL 3 DAY AS start_time FROM orders),
k AS (SELECT subject_id, encounter_id, min(visit_id) AS visit_id FROM visits GROUP BY 1, 2),
e AS (SELECT d.detail_id, k.visit_id, 'encounter' AS rule FROM d JOIN k USING (subject_id, encounter_id)),
c AS (SELECT d.detail_id, v.visit_id, row_number() OVER (PARTITION BY d.detail_id ORDER BY v.start_time DESC, v.end_time NULLS LAST, v.visit_id) AS n FROM d JOIN visits v ON d.subject_id = v.subject_id AND d.start_time >= v.start_time AND (v.end_time IS NULL OR d.start_time <= v.end_time) WHERE d.detail_id NOT IN (SELECT detail_id FROM e)),
f AS (SELECT * FROM e UNION ALL SELECT detail_id, visit_id, 'containment' FROM c WHERE n = 1)
SELECT d.detail_id, f.visit_id, coalesce(f.rule, 'NO_PARENT_VISIT') AS rule FROM d LEFT JOIN f USING (detail_id)""")
def visit_detail_parents(t):
    i = F.col("o_orderkey")
    enc = F.when(i % 3 == 0, F.concat(F.lit("e"), (i / 2).cast("bigint").cast("string"))).otherwise("x")
    d = t.orders.select(i.alias("detail_id"), F.col("o_custkey").alias("subject_id"), enc.alias("encounter_id"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(3))).alias("start_time"))
    found, withheld = publish.visit_parents(d, visits(t))
    return found.unionByName(withheld.select("detail_id", F.lit(None).cast("bigint").alias("visit_id"), F.col("issue").alias("rule")))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_name END, CASE WHEN p_partkey % 3 = 1 THEN p_size || '-' || (p_size + 1) END, p_size::VARCHAR) AS value_text FROM part""")
def value_text(t):
    k, s = F.col("p_partkey") % 3, F.col("p_size")
    return t.part.select("p_partkey", publish.value_text(F.when(k == 0, F.col("p_name")), F.when(k == 1, s), F.when(k == 1, s + 1), s).alias("value_text"))


_CODES_SQL = "codes AS (SELECT DISTINCT p_brand AS code_system, CASE WHEN p_partkey % 2 = 0 THEN 'C.' || p_partkey ELSE 'c' || p_partkey END AS code FROM part WHERE p_partkey % 5 <> 3)"


def _codes(t):
    p = F.col("p_partkey")
    code = F.when(p % 2 == 0, F.concat(F.lit("C."), p.cast("string"))).otherwise(F.concat(F.lit("c"), p.cast("string")))
    return t.part.where(p % 5 != 3).select(F.col("p_brand").alias("code_system"), code.alias("code")).distinct()


@query(f"""WITH {DOMAIN_SQL}, {RELATIONS_SQL}, {_CODES_SQL},
g AS (SELECT DISTINCT p_brand AS code_system, 'c.' || p_partkey AS term_key, p_partkey + 1 AS concept_id FROM part WHERE p_partkey % 4 = 0),
a AS (SELECT k.code_system, k.code, s.concept_id FROM codes k JOIN g ON g.code_system = k.code_system AND g.term_key = lower(k.code) JOIN concepts s ON s.concept_id = g.concept_id AND s.standard_concept = 'S' AND s.valid),
t AS (SELECT * FROM codes WHERE (code_system, code) NOT IN (SELECT (code_system, code) FROM a)),
x AS (SELECT k.code_system, k.code, s.concept_id, s.domain_id, 1 AS pass FROM t k JOIN concepts c ON c.vocabulary_id = k.code_system AND c.concept_code = k.code JOIN relations r ON r.concept_id_1 = c.concept_id JOIN concepts s ON s.concept_id = r.concept_id_2 AND s.standard_concept = 'S' AND s.valid),
y AS (SELECT k.code_system, k.code, s.concept_id, s.domain_id, 2 AS pass FROM t k JOIN concepts c ON c.vocabulary_id = k.code_system AND upper(replace(c.concept_code, '.', '')) = upper(replace(k.code, '.', '')) JOIN relations r ON r.concept_id_1 = c.concept_id JOIN concepts s ON s.concept_id = r.concept_id_2 AND s.standard_concept = 'S' AND s.valid
      WHERE (k.code_system, k.code) NOT IN (SELECT (code_system, code) FROM x)),
b AS (SELECT code_system, code, min(concept_id) AS concept_id, CASE WHEN pass = 1 THEN 'exact' ELSE 'unpunctuated' END || CASE WHEN count(DISTINCT concept_id) > 1 THEN '_ambiguous' ELSE '' END AS path FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY code_system, code, pass UNION ALL SELECT code_system, code, concept_id, 'registry' FROM a)
SELECT k.code_system, k.code, b.concept_id, c.domain_id, b.path FROM codes k LEFT JOIN b USING (code_system, code) LEFT JOIN concepts c ON c.concept_id = b.concept_id""")
def term_resolution(t):
    p = F.col("p_partkey")
    registry = t.part.where(p % 4 == 0).select(F.col("p_brand").alias("code_system"), F.concat(F.lit("c."), p.cast("string")).alias("term_key"), (p + 1).alias("concept_id")).distinct()
    return terminology.resolve_terms(_codes(t), registry, concepts(t), relations(t))


@query(f"""WITH {DOMAIN_SQL}, m AS (SELECT 'S' AS code_system, concept_name AS code, concept_id, domain_id, CASE WHEN length(concept_name) % 2 = 0 THEN 'SMALL' END AS expected FROM concepts)
SELECT code_system, code, arg_min(concept_id, row(coalesce(domain_id <> expected, true)::INT, concept_id)) AS concept_id, count(DISTINCT concept_id) - 1 AS alternates, count(DISTINCT concept_id) > 1 AS ambiguous FROM m GROUP BY 1, 2""")
def primary_target(t):
    m = concepts(t).select(F.lit("S").alias("code_system"), F.col("concept_name").alias("code"), "concept_id", "domain_id", F.when(F.length("concept_name") % 2 == 0, "SMALL").alias("expected"))
    return terminology.primary_targets(m)


@query("""WITH k AS (SELECT p_brand AS code_system, lower(p_name) AS term_key, p_partkey AS concept_id, CASE WHEN p_partkey % 7 <> 0 THEN 'ann' END AS decider, DATE '2024-01-01' + (p_size % 3)::INT AS decided_on FROM part),
g AS (SELECT code_system, term_key, max(CASE WHEN decider IS NOT NULL THEN decided_on END) AS latest, count(*) FILTER (WHERE decider IS NULL) AS incomplete FROM k GROUP BY 1, 2),
l AS (SELECT g.code_system, g.term_key, min(k.concept_id) AS a, max(k.concept_id) AS b FROM g LEFT JOIN k ON k.code_system = g.code_system AND k.term_key = g.term_key AND k.decider IS NOT NULL AND k.decided_on = g.latest GROUP BY 1, 2)
SELECT code_system, term_key, CASE WHEN a IS NULL THEN 'incomplete' WHEN a <> b THEN 'conflict' ELSE 'accepted' END AS outcome, CASE WHEN a = b THEN a END AS concept_id, incomplete FROM g JOIN l USING (code_system, term_key)""")
def decision_compile(t):
    p = t.part.select(F.col("p_brand").alias("code_system"), F.lower("p_name").alias("term_key"), F.col("p_partkey").alias("concept_id"), F.when(F.col("p_partkey") % 7 != 0, "ann").alias("decided_by"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_size") % 3).cast("int")).alias("decided_on"))
    return terminology.compile_decisions(p)


@query("""WITH q AS (SELECT p_partkey AS item_id, p_name AS term, 1::BIGINT AS n FROM part WHERE p_partkey % 2 = 0), f AS (SELECT p_partkey AS item_id, upper(p_name) AS term, p_size::BIGINT AS n FROM part WHERE p_partkey % 3 = 0)
SELECT coalesce(q.item_id, f.item_id)::VARCHAR AS item_id, coalesce(f.term, q.term) AS term, coalesce(f.n, q.n) AS occurrences, CASE WHEN f.item_id IS NOT NULL THEN 'open' ELSE 'resolved' END AS status FROM q FULL JOIN f ON q.item_id = f.item_id""")
def review_upsert(t):
    i = F.col("p_partkey").cast("string").alias("item_id")
    q = t.part.where("p_partkey % 2 = 0").select(i, F.col("p_name").alias("term"), F.lit(1).cast("bigint").alias("occurrences"))
    f = t.part.where("p_partkey % 3 = 0").select(i, F.upper("p_name").alias("term"), F.col("p_size").cast("bigint").alias("occurrences"))
    return terminology.upsert_review(q, f)


@query("""WITH q AS (SELECT DISTINCT p_name AS query_id, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 100 = 0), c AS (SELECT p_partkey AS concept_id, p_name AS concept_name, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part),
h AS (SELECT query_id, concept_id, concept_name, count(DISTINCT q.w) AS hits FROM q JOIN c ON q.w = c.w GROUP BY ALL)
SELECT query_id, concept_id, hits, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, length(concept_name), concept_id)::INT AS n FROM h) WHERE n <= 5""")
def topk_candidates(t):
    q = t.part.where("p_partkey % 100 = 0").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("text")).distinct()
    c = t.part.select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_name"))
    return terminology.lexical_candidates(q, c, 5).select("query_id", "concept_id", "hits", "rank")


@query("""WITH k AS (SELECT p_type AS kind, p_brand AS code_system, lower(p_name) AS term_key, p_name FROM part)
SELECT code_system, term_key, min(p_name) AS term, count(*) AS occurrences, CASE WHEN min(kind) = max(kind) AND min(kind) IN ('SMALL', 'ECONOMY') THEN 'Drug' WHEN min(kind) IN ('SMALL', 'ECONOMY') AND max(kind) IN ('SMALL', 'ECONOMY') THEN 'Drug' END AS expected FROM k GROUP BY 1, 2""")
def term_collection(t):
    g = terminology.collect_terms(t.part, "p_brand", "p_name", "p_name", "p_type")
    return g.select("code_system", "term_key", "term", "occurrences", terminology.expected_domain(F.col("kind_low"), F.col("kind_high"), {"SMALL": "Drug", "ECONOMY": "Drug"}).alias("expected"))


def _drug_names(t):
    s = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 6
    head = F.upper("p_name")
    name = (
        F.when(k == 0, F.concat(head, F.lit(" "), s, F.lit(" MG TABLET"))).when(k == 1, F.concat(head, F.lit(" "), s, F.lit(" MCG/ML INJECTION"))).when(k == 2, F.concat(head, F.lit(" 0."), s, F.lit(" % CREAM")))
        .when(k == 3, F.concat(head, F.lit(" "), s, F.lit(" MG-"), F.lit("X"), F.upper("p_type"), F.lit(" 5 MG CAPSULE"))).when(k == 4, F.concat(head, F.lit(" 1:1,000 PRN"))).otherwise(head)
    )
    return t.part.select(name.alias("name"))


_NAMES_SQL = """n AS (SELECT DISTINCT p_partkey % 6 AS k, upper(p_name) AS head, 'X' || upper(p_type) AS kind_name, p_size FROM part),
names AS (SELECT *, CASE k WHEN 0 THEN head || ' ' || p_size || ' MG TABLET' WHEN 1 THEN head || ' ' || p_size || ' MCG/ML INJECTION' WHEN 2 THEN head || ' 0.' || p_size || ' % CREAM'
  WHEN 3 THEN head || ' ' || p_size || ' MG-' || kind_name || ' 5 MG CAPSULE' WHEN 4 THEN head || ' 1:1,000 PRN' ELSE head END AS name FROM n)"""


@query(f"""WITH {_NAMES_SQL} SELECT DISTINCT name, CASE k WHEN 0 THEN 'TABLET' WHEN 1 THEN 'INJECTION' WHEN 2 THEN 'CREAM' WHEN 3 THEN 'CAPSULE' END AS dose_form, k <> 5 AS had_number,
CASE k WHEN 3 THEN 2 ELSE 1 END::INT AS components, CASE k WHEN 4 THEN head || ' PRN' ELSE head END AS ingredient, CASE WHEN k IN (0, 3) THEN 'amount' WHEN k <> 5 THEN 'ratio' END AS kind,
CASE WHEN k IN (0, 1, 3) THEN p_size::DOUBLE WHEN k = 2 THEN ('0.' || p_size)::DOUBLE WHEN k = 4 THEN 1.0::DOUBLE END AS value, CASE WHEN k IN (0, 3) THEN 'mg' WHEN k = 1 THEN 'ug' WHEN k IN (2, 4) THEN 'g' END AS unit,
CASE k WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 100.0::DOUBLE WHEN 4 THEN 1000.0::DOUBLE END AS below, CASE WHEN k IN (1, 2, 4) THEN 'mL' END AS unit_below FROM names""")
def drug_name_parse(t):
    p = drugs.parse_drug_names(_drug_names(t), "name")
    first = F.element_at("parsed.components", 1)
    return p.select("name", "parsed.dose_form", "parsed.had_number", F.size("parsed.components").alias("components"), first["name"].alias("ingredient"), *[first[c].alias(c) for c in ("kind", "value", "unit", "below", "unit_below")])


def _drug_vocabulary(t):
    """One ingredient per name of `part`, one tablet per sixth part, in the tables of a vocabulary."""
    s, none = t.spark, F.lit(None).cast("string")
    concept = lambda df, i, name, kind, code, std: df.select(i.cast("bigint").alias("concept_id"), name.alias("concept_name"), F.lit("Drug").alias("domain_id"), F.lit("RxNorm").alias("vocabulary_id"), F.lit(kind).alias("concept_class_id"), F.lit(std).alias("standard_concept"), code.alias("concept_code"), none.alias("invalid_reason"))
    named = t.part.groupBy("p_name").agg((F.min("p_partkey") + 1000).alias("ingredient"))
    made = t.part.where("p_partkey % 6 = 0").join(named, "p_name").withColumn("drug", F.col("p_partkey") + 10_000_000)
    label = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" MG Oral Tablet"))
    fixed = s.createDataFrame([(1, "milligram", "Unit", "UCUM", "Unit", "S", "mg", None), (5, "Oral Tablet", "Drug", "RxNorm", "Dose Form", None, "5", None)], "concept_id long, concept_name string, domain_id string, vocabulary_id string, concept_class_id string, standard_concept string, concept_code string, invalid_reason string")
    concepts_ = fixed.unionByName(concept(named, F.col("ingredient"), F.col("p_name"), "Ingredient", none, "S")).unionByName(concept(made, F.col("drug"), label, "Clinical Drug", none, "S"))
    forms = made.select(F.col("drug").alias("concept_id_1"), F.lit(5).cast("bigint").alias("concept_id_2"), F.lit("RxNorm has dose form").alias("relationship_id"), none.alias("invalid_reason"))
    blank = {f"{c}_value": none for c in ("numerator", "denominator")} | {f"{c}_unit_concept_id": F.lit(None).cast("bigint") for c in ("numerator", "denominator")}
    strengths = made.select(F.col("drug").alias("drug_concept_id"), F.col("ingredient").alias("ingredient_concept_id"), F.col("p_size").cast("string").alias("amount_value"), F.lit(1).cast("bigint").alias("amount_unit_concept_id"), none.alias("invalid_reason")).withColumns(blank)
    return concepts_, forms, strengths


@query(f"""WITH {_NAMES_SQL}, d AS (SELECT upper(p_name) AS head, p_size, min(p_partkey) + 10000000 AS drug, count(*) AS n FROM part WHERE p_partkey % 6 = 0 GROUP BY 1, 2), i AS (SELECT upper(p_name) AS head, min(p_partkey) + 1000 AS ingredient FROM part GROUP BY 1)
SELECT DISTINCT name, CASE WHEN k = 0 THEN CASE WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END WHEN k IN (1, 2) THEN 'no_dose_form' WHEN k IN (3, 4) THEN 'no_ingredient' ELSE 'unique' END AS status,
CASE WHEN k = 0 AND n = 1 THEN drug WHEN k = 5 THEN ingredient END AS concept_id, CASE k WHEN 0 THEN 'as_written' WHEN 5 THEN 'ingredient' END AS route, CASE k WHEN 0 THEN n WHEN 5 THEN 1 ELSE 0 END::BIGINT AS candidates
FROM names LEFT JOIN d USING (head, p_size) LEFT JOIN i USING (head)""")
def drug_match(t):
    return drugs.match_drugs(_drug_names(t), drugs.drug_index(*_drug_vocabulary(t)))


@query(f"""WITH {_NAMES_SQL}, d AS (SELECT upper(p_name) AS head, p_size, min(p_partkey) + 10000000 AS drug, count(*) AS n FROM part WHERE p_partkey % 6 = 0 GROUP BY 1, 2), i AS (SELECT upper(p_name) AS head, min(p_partkey) + 1000 AS ingredient FROM part GROUP BY 1)
SELECT DISTINCT 'SOURCE' AS code_system, name AS code, CASE WHEN k = 0 AND n = 1 THEN drug WHEN k = 5 THEN ingredient END AS concept_id, CASE WHEN (k = 0 AND n = 1) OR k = 5 THEN 'Drug' END AS domain_id, CASE WHEN k = 0 AND n = 1 THEN 'structured_drug_as_written' WHEN k = 5 THEN 'structured_drug_ingredient' END AS path
FROM names LEFT JOIN d USING (head, p_size) LEFT JOIN i USING (head)""")
def term_resolution_drugs(t):
    c, r, d = _drug_vocabulary(t)
    names = _drug_names(t).distinct().select(F.lit("SOURCE").alias("code_system"), F.col("name").alias("code"), "name", F.lit("Drug").alias("domain"))
    registry = t.spark.createDataFrame([], "code_system string, term_key string, concept_id long")
    resolved = terminology.resolve_terms(names, registry, c.withColumn("valid", F.lit(True)), r)
    return terminology.resolve_drugs(names, resolved, drugs.drug_index(c, r, d))
