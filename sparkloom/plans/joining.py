"""Queries over joins, aggregations, windows, sorts and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import digest, relational
from sparkloom.plans.domain import DOMAIN_SQL, VISITS_SQL, facts, links, source_rows, visits
from sparkloom.plans.registry import query


@query("SELECT n_name, r_name, count(*) AS customers, sum(c_acctbal) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def inner_join_star(t):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, coalesce(p_partkey, 0) AS concept_id FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_type IN ('SMALL', 'ECONOMY')""")
def left_join_terms(t):
    routable = t.part.where(F.col("p_type").isin("SMALL", "ECONOMY"))
    j = t.lineitem.join(routable, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", F.coalesce("p_partkey", F.lit(0)).alias("concept_id"))


@query("""WITH u AS (SELECT * FROM (VALUES ('error', NULL, 1), ('error', 'mg', 2), (NULL, 'mg', 3), (NULL, NULL, 4)) v(code, unit, unit_id)),
e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' END AS code, CASE WHEN event_id % 2 = 0 THEN 'mg' END AS unit FROM events)
SELECT event_id, unit_id FROM e LEFT JOIN u ON e.code IS NOT DISTINCT FROM u.code AND e.unit IS NOT DISTINCT FROM u.unit""")
def null_safe_unit_join(t):
    u = t.spark.createDataFrame([("error", None, 1), ("error", "mg", 2), (None, "mg", 3), (None, None, 4)], "code string, unit string, unit_id int")
    e = t.events.select("event_id", F.when(F.col("event_type") == "error", "error").alias("code"), F.when(F.col("event_id") % 2 == 0, "mg").alias("unit"))
    return relational.null_safe_join(e, u, ["code", "unit"]).select("event_id", "unit_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def semi_published(t):
    return t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') GROUP BY 1")
def anti_orphans(t):
    known = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(known, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def not_in_blocked(t):
    blocked = t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    return t.customer.join(blocked, "c_nationkey", "left_anti").select("c_custkey", "c_name")


_DETAIL = "details AS (SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS detail_id, o_custkey AS subject_id, l_shipdate AS start_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _details(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select((F.col("l_orderkey") * 100 + F.row_number().over(w)).alias("detail_id"), F.col("o_custkey").alias("subject_id"), F.col("l_shipdate").alias("start_time"))


@query(f"""WITH {VISITS_SQL}, {_DETAIL}
SELECT detail_id, visit_id FROM (SELECT d.detail_id, v.visit_id, row_number() OVER (PARTITION BY d.detail_id ORDER BY v.start_time DESC, v.end_time ASC NULLS LAST, v.visit_id) AS n
FROM details d JOIN visits v ON d.subject_id = v.subject_id AND d.start_time >= v.start_time AND (v.end_time IS NULL OR d.start_time <= v.end_time)) WHERE n = 1""")
def containment_parent(t):
    return relational.containment_match(_details(t), visits(t), "subject_id", "start_time", "start_time", "end_time", "visit_id", "detail_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, p_retailprice FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def lookup_cardinality(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_retailprice")
    return relational.lookup(t.lineitem, p, ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "p_retailprice")


@query("""WITH n AS (SELECT l_orderkey, CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END AS tier, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, arg_min(p_name, row(tier, p_name)) AS name, min(tier) AS tier, count(DISTINCT p_name) AS candidates FROM n GROUP BY 1""")
def best_tier_name(t):
    n = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.when(F.col("p_type") == "ECONOMY", 0).otherwise(1).alias("tier"), F.col("p_name").alias("name"))
    return relational.best_tier(n, "l_orderkey", "tier", "name")


@query(f"""WITH {VISITS_SQL}, e AS (SELECT l_returnflag AS source, o_custkey AS subject_id, CASE WHEN l_linenumber % 4 <> 0 THEN 'e' || ((l_orderkey + l_linenumber % 2 * 5) // 2) END AS enc FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT source, count(*) AS events, count(v.k) AS linked, count(v.k) / count(*)::DOUBLE AS link_rate FROM e LEFT JOIN (SELECT DISTINCT subject_id, encounter_id, 1 AS k FROM visits) v ON e.subject_id = v.subject_id AND e.enc = v.encounter_id WHERE enc IS NOT NULL GROUP BY 1""")
def encounter_link_rate(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    number = ((F.col("l_orderkey") + F.col("l_linenumber") % 2 * 5) / 2).cast("bigint").cast("string")
    e = j.select(F.col("l_returnflag").alias("source"), F.col("o_custkey").alias("subject_id"), F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit("e"), number)).alias("encounter_id"))
    return relational.link_rate(e, visits(t), "source")


@query("""SELECT o_custkey AS subject_id, min(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS f, min(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS o,
count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS f_variants, count(DISTINCT o_orderpriority) AS variants FROM orders GROUP BY 1""")
def person_pivot(t):
    of = lambda s: F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority"))
    return t.orders.groupBy(F.col("o_custkey").alias("subject_id")).agg(F.min(of("F")).alias("f"), F.min(of("O")).alias("o"), F.countDistinct(of("F")).alias("f_variants"), F.countDistinct("o_orderpriority").alias("variants"))


@query(f"WITH {DOMAIN_SQL} SELECT event_id, string_agg(source_row_id, ',' ORDER BY source_row_id) AS rows FROM links GROUP BY 1")
def lineage_list(t):
    return links(t).groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("source_row_id")), ",").alias("rows"))


@query("""SELECT event_type, quantile_cont(value, 0.01) AS p1, median(value) AS p50, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1""")
def quantile_profile(t):
    return t.events.groupBy("event_type").agg(F.percentile("value", F.lit(0.01)).alias("p1"), F.median("value").alias("p50"), F.percentile("value", F.lit(0.99)).alias("p99"))


@query("""WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_brand, arg_min(p_name, row(-n, p_name)) AS p_name, sum(n)::BIGINT AS n FROM c GROUP BY 1""")
def representative_name(t):
    return relational.representative(t.part, ["p_brand"], "p_name")


@query("""WITH g AS (SELECT source, sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, sum(n)::BIGINT AS notes, sum(n - 1)::BIGINT AS surplus, sum(n - 1) / sum(n)::DOUBLE AS share FROM g GROUP BY 1""")
def note_repeat_share(t):
    g = t.documents.groupBy("source", F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return g.groupBy("source").agg(F.sum("n").alias("notes"), F.sum(F.col("n") - 1).alias("surplus"), (F.sum(F.col("n") - 1) / F.sum("n")).alias("share"))


def _digest_sql(table: str, rows: str, **columns: str) -> str:
    """Rows and digest of a table's columns in DuckDB; a column's letter is its kind: whole, real, text or time."""
    form = {"w": "{0}::VARCHAR", "r": "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE {0}::VARCHAR END", "s": "trim({0})", "t": "strftime({0}, '%Y-%m-%dT%H:%M:%S')"}
    cells = " || chr(31) || ".join(f"coalesce({form[kind].format(c)}, '')" for c, kind in sorted(columns.items()))
    return f"SELECT {rows}, sum(('0x' || substr(sha256({cells}), 1, 15))::BIGINT)::VARCHAR AS digest FROM {table}"


@query(_digest_sql("lineitem", "count(*) AS n_rows", l_orderkey="w", l_partkey="w", l_suppkey="w", l_linenumber="w", l_quantity="r", l_extendedprice="r", l_discount="r", l_tax="r", l_returnflag="s", l_linestatus="s", l_shipdate="t"))
def content_digest(t):
    return digest.content_digest(t.lineitem)


@query(_digest_sql("customer", "'customer.parquet' AS file, count(*) AS n_rows", c_custkey="w", c_name="s", c_nationkey="w", c_acctbal="r", c_mktsegment="s"))
def file_digests(t):
    return digest.file_digests(t.customer, t._folder)


@query("""WITH d AS (SELECT unnest(['a', 'b', 'c']) AS name), b AS (SELECT 'a' AS name, '1' AS digest UNION ALL SELECT 'b', '2'), a AS (SELECT 'b' AS name, '3' AS digest UNION ALL SELECT 'c', '4')
SELECT coalesce(b.name, a.name) AS name, b.digest AS was, a.digest AS now FROM b FULL JOIN a ON a.name = b.name WHERE b.digest IS DISTINCT FROM a.digest""")
def artifact_diff(t):
    s = t.spark
    return digest.changed(s.createDataFrame([("a", "1"), ("b", "2")], "name string, digest string"), s.createDataFrame([("b", "3"), ("c", "4")], "name string, digest string"))


@query(r"""WITH v AS (SELECT 'p_name' AS name, p_name AS v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_size', CASE WHEN p_size <> 13 THEN p_size::VARCHAR END FROM part),
s AS (SELECT name, regexp_replace(regexp_replace(v, '[0-9]', '9', 'g'), '[A-Za-z]', 'a', 'g') AS shape, count(*) AS n, count(DISTINCT v) AS k FROM v GROUP BY 1, 2)
SELECT name, sum(n)::BIGINT AS n_rows, coalesce(sum(CASE WHEN shape IS NULL THEN n END), 0)::BIGINT AS n_null, sum(k)::BIGINT AS n_distinct, arg_min(shape, row(-n, shape)) FILTER (WHERE shape IS NOT NULL) AS top_shape FROM s GROUP BY 1""")
def format_fingerprint(t):
    p = t.part.withColumn("p_size", F.when(F.col("p_size") != 13, F.col("p_size")))
    return relational.fingerprint(p, ["p_name", "p_brand", "p_size"], text.mask_shape)


@query("""WITH f AS (SELECT user_id, min(ts) AS first_ts FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT e.user_id, e.event_type, count(*) FILTER (WHERE ts <= first_ts) AS respects, count(*) FILTER (WHERE ts <= first_ts + INTERVAL 1 DAY) AS ignores, count(*) FILTER (WHERE event_type = 'error' OR ts <= first_ts) AS backdated
FROM events e JOIN f ON e.user_id = f.user_id GROUP BY 1, 2""")
def feature_arms(t):
    first = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    e = t.events.join(first, "user_id")
    before = F.col("ts") <= F.col("first_ts")
    day = F.col("ts") <= F.col("first_ts") + F.make_dt_interval(F.lit(1))
    return e.groupBy("user_id", "event_type").agg(F.count_if(before).alias("respects"), F.count_if(day).alias("ignores"), F.count_if((F.col("event_type") == "error") | before).alias("backdated"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS id FROM events")
def surrogate_keys(t):
    return relational.surrogate_keys(t.events, ["ts", "event_id"]).select("event_id", "id")


@query("SELECT p_partkey, n_targets FROM part JOIN (SELECT p_name, count(DISTINCT p_brand) AS n_targets FROM part GROUP BY 1) USING (p_name)")
def competing_targets(t):
    return relational.competing_targets(t.part, "p_name", "p_brand").select("p_partkey", "n_targets")


@query("""WITH s AS (SELECT event_id % 8 AS shard, event_id, user_id, ts, lag(user_id) OVER w AS pu, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY event_id % 8 ORDER BY event_id))
SELECT shard, count(*) FILTER (WHERE pu = user_id AND ts < pt) AS backwards, sum(CASE WHEN pu IS NULL OR pu <> user_id THEN 1 ELSE 0 END)::BIGINT - count(DISTINCT user_id) AS split_subjects FROM s GROUP BY 1""")
def adjacent_order(t):
    return relational.out_of_order(t.events.withColumn("shard", F.col("event_id") % 8), "shard", "event_id", "user_id", "ts")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 9 <> 0 THEN ts END ASC NULLS FIRST, event_type, event_id)::INT AS place FROM events""")
def publication_sort_rank(t):
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_first("at"), "event_type", "event_id")
    return t.events.withColumn("at", F.when(F.col("event_id") % 9 != 0, F.col("ts"))).select("event_id", F.row_number().over(w).alias("place"))


@query("""SELECT q.vec_id AS query_id, e.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine, n AS rank FROM (
SELECT q.vec_id AS a, e.vec_id AS b, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id)::INT AS n
FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0) JOIN embeddings q ON q.vec_id = a JOIN embeddings e ON e.vec_id = b WHERE n <= 5""")
def topk_dense(t):
    v = F.col("embedding").alias("vector")
    q, items = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), v), t.embeddings.select(F.col("vec_id").alias("item_id"), v)
    return relational.topk_dense(q, items, 5).select("query_id", "item_id", F.round("cosine", 6).alias("cosine"), "rank")


@query("""WITH m AS (SELECT o_orderkey, 'status' AS rule FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'priority' FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT rule, count(*) AS n, count(DISTINCT o_orderkey) AS orders, (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')) AS either FROM m GROUP BY 1""")
def union_rules(t):
    a = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("status").alias("rule"))
    b = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("priority").alias("rule"))
    either = a.select("o_orderkey").union(b.select("o_orderkey")).distinct().agg(F.count("*").alias("either"))
    return a.union(b).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("orders")).crossJoin(F.broadcast(either))


@query("""SELECT 'left' AS side, k FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'right', k FROM (SELECT l_orderkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part)""")
def set_difference(t):
    return relational.difference_both_ways(t.part.select(F.col("p_partkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")))


@query("""SELECT user_id, len(list_filter(list_distinct(list(date_trunc('day', ts))), lambda x: x <> TIMESTAMP '2024-01-05'))::INT AS other_days FROM events GROUP BY 1""")
def list_difference(t):
    days = F.collect_set(F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return t.events.groupBy("user_id").agg(F.size(F.array_except(days, F.array(F.lit("2024-01-05").cast("timestamp_ntz")))).alias("other_days"))


@query("""SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS balance, NULL AS region FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal, NULL FROM supplier UNION ALL SELECT 'r', r_regionkey, NULL, r_name FROM region""")
def union_by_name(t):
    c = t.customer.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = t.supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    r = t.region.select(F.lit("r").alias("kind"), F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("region"))
    return c.unionByName(s).unionByName(r, allowMissingColumns=True)


@query("""SELECT source_id, count(*) AS rows, count(*) FILTER (WHERE value > 100) AS high, count(*) FILTER (WHERE value > 100) / count(*)::DOUBLE AS share, count(*) FILTER (WHERE value > 100) / count(*)::DOUBLE <= 0.05 AS within
FROM (SELECT event_type AS source_id, value FROM events) GROUP BY 1""")
def share_threshold(t):
    share = F.count_if(F.col("value") > 100) / F.count("*")
    return source_rows(t).groupBy("source_id").agg(F.count("*").alias("rows"), F.count_if(F.col("value") > 100).alias("high"), share.alias("share"), (share <= 0.05).alias("within"))


@query(f"WITH {DOMAIN_SQL} SELECT n_rows, count(*) AS events FROM facts GROUP BY 1")
def fan_out(t):
    return facts(t).groupBy("n_rows").agg(F.count("*").alias("events"))


@query("""WITH h AS (SELECT q.vec_id, q.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS n, q.label = e.label AS hit
FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
SELECT count(DISTINCT vec_id) AS queries, avg(CASE WHEN n = 1 THEN hit::INT END) AS top1, (SELECT avg(x) FROM (SELECT max(hit::INT) AS x FROM h WHERE n <= 5 GROUP BY vec_id)) AS recall5 FROM h""")
def retrieval_metrics(t):
    v = F.col("embedding").alias("vector")
    q, items = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), v), t.embeddings.select(F.col("vec_id").alias("item_id"), v)
    top = relational.topk_dense(q, items, 6).where("query_id <> item_id")
    top = top.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "item_id"))).where("n <= 5")
    lab = t.embeddings.select("vec_id", "label")
    j = top.join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(lab.select(F.col("vec_id").alias("item_id"), F.col("label").alias("b")), "item_id")
    per = j.groupBy("query_id").agg(F.max(F.when(F.col("n") == 1, (F.col("a") == F.col("b")).cast("int"))).alias("one"), F.max((F.col("a") == F.col("b")).cast("int")).alias("five"))
    return per.agg(F.count("*").alias("queries"), F.avg("one").alias("top1"), F.avg("five").alias("recall5"))
