"""Source terms to concepts: passes over a vocabulary, decisions, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import normalize_term, unpunctuated


def collect_terms(rows: DataFrame, system: str, term: str, name: str, kind: str) -> DataFrame:
    """Distinct (system, normalised term) with counts, least name and the kinds it occurs as."""
    keyed = rows.withColumn("term_key", normalize_term(F.col(term)))
    return keyed.groupBy(F.col(system).alias("code_system"), "term_key").agg(F.min(term).alias("term"), F.min(name).alias("name"), F.min(kind).alias("kind_low"), F.max(kind).alias("kind_high"), F.count("*").alias("occurrences"))


def expected_domain(low: Column, high: Column, domains: dict[str, str]) -> Column:
    """The domain on which the kinds of a term agree, null if they don't."""
    of = F.create_map(*[F.lit(x) for kv in domains.items() for x in kv])
    return F.when(F.try_element_at(of, low) == F.try_element_at(of, high), F.try_element_at(of, low))


def maps_to(codes: DataFrame, concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """Hop from source codes over `Maps to` to standard concepts. `codes`: code_system, code, key."""
    source = concepts.select(F.col("vocabulary_id").alias("code_system"), F.col("concept_key").alias("key"), F.col("concept_id").alias("from_id"))
    standard = concepts.where("standard_concept = 'S' AND valid").select(F.col("concept_id").alias("to_id"), "domain_id")
    hop = relations.where("relationship_id = 'Maps to'").select(F.col("concept_id_1").alias("from_id"), F.col("concept_id_2").alias("to_id"))
    return codes.join(source, ["code_system", "key"]).join(hop, "from_id").join(standard, "to_id").select("code_system", "code", F.col("to_id").alias("concept_id"), "domain_id")


def primary_targets(found: DataFrame, expected: str | None = "expected") -> DataFrame:
    """Per code the concept of the expected domain, else the lowest id; the number of others; whether it was a choice."""
    off = (F.coalesce(F.col("domain_id") != F.col(expected), F.lit(True)) if expected else F.lit(False)).cast("int")
    g = found.groupBy("code_system", "code").agg(F.min_by("concept_id", F.struct(off.alias("o"), F.col("concept_id").alias("c"))).alias("concept_id"), F.countDistinct("concept_id").alias("targets"))
    return g.withColumn("alternates", F.col("targets") - 1).withColumn("ambiguous", F.col("targets") > 1).drop("targets")


def unambiguous_unpunctuated(concepts: DataFrame) -> DataFrame:
    """Stripped codes that only one concept of the vocabulary has."""
    g = concepts.groupBy("vocabulary_id", unpunctuated(F.col("concept_code")).alias("key")).agg(F.min("concept_id").alias("concept_id"), F.countDistinct("concept_id").alias("n"))
    return g.where("n = 1").drop("n")


def resolve_terms(terms: DataFrame, registry: DataFrame, concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """Passes in order: approved mapping, exact code, code without punctuation. What a pass finds, later ones skip.

    `terms`: code_system, code. `registry`: code_system, term_key, concept_id. Rows: code_system, code,
    concept_id, domain_id, path; a path that had to choose ends in `_ambiguous`; unresolved terms have nulls.
    """
    t = terms.select("code_system", "code").distinct()
    approved = t.withColumn("term_key", normalize_term(F.col("code"))).join(registry, ["code_system", "term_key"]).join(confirm(concepts).select("concept_id", "domain_id"), "concept_id")
    done = approved.select("code_system", "code", "concept_id", "domain_id", F.lit("registry").alias("path"))
    keys = (("exact", F.col("code"), concepts.withColumn("concept_key", F.col("concept_code"))), ("unpunctuated", unpunctuated(F.col("code")), None))
    for path, key, vocabulary in keys:
        left = t.join(done, ["code_system", "code"], "left_anti")
        if vocabulary is None:
            single = unambiguous_unpunctuated(concepts)
            vocabulary = concepts.withColumn("concept_key", unpunctuated(F.col("concept_code"))).join(single.select("concept_id"), "concept_id", "left_semi")
        hits = maps_to(left.withColumn("key", key), vocabulary, relations)
        best = primary_targets(hits, None).join(concepts.select("concept_id", "domain_id"), "concept_id")
        done = done.unionByName(best.select("code_system", "code", "concept_id", "domain_id", F.concat(F.lit(path), F.when(F.col("ambiguous"), "_ambiguous").otherwise("")).alias("path")))
    return t.join(done, ["code_system", "code"], "left")


def resolve_drugs(terms: DataFrame, resolved: DataFrame, index, local_noise=(), truncated_at: int | None = None) -> DataFrame:
    """The last pass of `resolve_terms`: drug terms that are still without a concept, by what their names say.

    `terms`: code_system, code, name, domain (expected); `resolved`: what `resolve_terms` returned; `index`: a
    `drugs.DrugIndex`. A name that fits exactly one product resolves to it, and the path says by which reading.
    """
    from sparkloom.operators.drugs import match_drugs

    left = resolved.where("concept_id IS NULL").join(terms.where("domain = 'Drug'").select("code_system", "code", "name"), ["code_system", "code"])
    found = match_drugs(left, index, "name", local_noise, truncated_at).where("status = 'unique'").select("name", F.col("concept_id").alias("drug_id"), F.concat(F.lit("structured_drug_"), "route").alias("drug_path"))
    hits = left.join(found, "name").select("code_system", "code", "drug_id", "drug_path")
    out = resolved.join(hits, ["code_system", "code"], "left")
    domain = F.when(F.col("drug_id").isNotNull(), "Drug").otherwise(F.col("domain_id"))
    return out.select("code_system", "code", F.coalesce("concept_id", "drug_id").alias("concept_id"), domain.alias("domain_id"), F.coalesce("path", "drug_path").alias("path"))


def confirm(concepts: DataFrame) -> DataFrame:
    return concepts.where("standard_concept = 'S' AND valid")


def by_code(concepts: DataFrame, relations: DataFrame, system: str, code: str) -> DataFrame:
    """At most one row (concept_id, domain_id, source_concept_id, path): the standard concept of a source code.

    Of the concepts with that code a valid one comes first, then the lowest id. It is the answer if it is standard and
    valid, else the standard concept with the lowest id that it maps to; a retired code still maps, and says so.
    """
    source = concepts.where((F.col("vocabulary_id") == system) & (F.col("concept_code") == code)).orderBy(F.desc("valid"), "concept_id").limit(1)
    own = (F.col("standard_concept") == "S") & F.col("valid")
    direct = source.where(own).select("concept_id", "domain_id", F.lit(None).cast("bigint").alias("source_concept_id"), F.lit("standard").alias("path"))
    hop = relations.where("relationship_id = 'Maps to'").select(F.col("concept_id_1").alias("source_concept_id"), F.col("concept_id_2").alias("concept_id"))
    path = F.when(F.col("valid"), "mapped_relationship").otherwise("mapped_relationship_retired")
    from_here = source.where(~F.coalesce(own, F.lit(False))).select(F.col("concept_id").alias("source_concept_id"), path.alias("path"))
    target = concepts.where("standard_concept = 'S'").select("concept_id", "domain_id")
    mapped = from_here.join(hop, "source_concept_id").join(target, "concept_id").orderBy("concept_id").limit(1)
    return direct.unionByName(mapped)


def by_name(concepts: DataFrame, domain: str, name: str) -> DataFrame:
    """At most one row: the valid standard concept of the domain with exactly that name, in any case; the lowest id."""
    hit = confirm(concepts).where((F.lower("concept_name") == name.lower()) & (F.col("domain_id") == domain))
    return hit.orderBy("concept_id").limit(1)


def concept_exists(concepts: DataFrame, concept_id: int) -> bool:
    """Whether the vocabulary has the concept; 0, which stands for none, always exists."""
    return concept_id == 0 or bool(concepts.where(F.col("concept_id") == concept_id).take(1))


def domain_of(concepts: DataFrame, concept_id: int) -> str | None:
    row = concepts.where(F.col("concept_id") == concept_id).select("domain_id").first()
    return row["domain_id"] if row else None


def resolve_one(system: str, code: str, registry: DataFrame, concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """`resolve_terms` for one term: the same passes, with the filters on its code pushed to the vocabulary's scan."""
    one = concepts.sparkSession.createDataFrame([(system, code)], "code_system string, code string")
    near = concepts.where((F.col("vocabulary_id") == system) & (unpunctuated(F.col("concept_code")) == unpunctuated(F.lit(code))) | (F.col("standard_concept") == "S"))
    return resolve_terms(one, registry.where(F.col("code_system") == system), near, relations)


def lexical_candidates(queries: DataFrame, concepts: DataFrame, k: int, common: int = 10_000) -> DataFrame:
    """Top k concepts per query by how many of its words their names hold; then shorter names, then lower ids.

    Words meet through an equi join on the words of the names, so no pair without a common word is made. A word that
    more than `common` names hold would join a third of the vocabulary with every query that has it: it counts for the
    concepts that another word of the query found, and on its own only where the query has no rarer word.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(normalize_term(c), " "), lambda w: w != ""))
    named = concepts.select("concept_id", "concept_name", words(F.col("concept_name")).alias("words"))
    frequent = named.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("names")).where(F.col("names") > common).select("w", F.lit(True).alias("frequent"))
    asked = queries.select("query_id", words(F.col("text")).alias("asked"))
    q = asked.select("query_id", "asked", F.explode("asked").alias("w")).join(frequent, "w", "left").withColumn("frequent", F.coalesce("frequent", F.lit(False)))
    rare = q.groupBy("query_id").agg(F.min("frequent").alias("only_frequent"))
    q = q.join(rare, "query_id").where("only_frequent OR NOT frequent").select("query_id", "asked", "w")
    found = q.join(named.select("concept_id", "concept_name", "words", F.explode("words").alias("w")), "w")
    hits = found.select("query_id", "concept_id", "concept_name", F.size(F.array_intersect("asked", "words")).cast("bigint").alias("hits")).distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), F.length("concept_name"), "concept_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def review_order(queue: DataFrame) -> DataFrame:
    """The review queue as it is worked through: most rows first, then by code; `place` from 1.

    Places come from `surrogate_keys`, so that a queue of any length is numbered without one task for all.
    """
    from sparkloom.operators.relational import surrogate_keys

    keyed = queue.withColumn("falling", -F.col("occurrences"))
    return surrogate_keys(keyed, ["falling", "code"], "place").drop("falling")


def propose(queue: DataFrame, concepts: DataFrame, terms: int, k: int = 10) -> DataFrame:
    """For the `terms` commonest open terms, their lexical candidates as JSON, best first; no candidate: an empty list.

    `queue`: item_id, term, occurrences, status. Candidates are suggestions for a reviewer and are never adopted here.
    """
    top = queue.where("status = 'open'").orderBy(F.desc("occurrences"), "term", "item_id").limit(terms)
    hits = lexical_candidates(top.select(F.col("item_id").alias("query_id"), F.col("term").alias("text")), confirm(concepts), k)
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "concept_id", "concept_name", "hits"))).alias("c"))
    record = F.to_json(F.transform("c", lambda c: F.struct(c["concept_id"].alias("concept_id"), c["concept_name"].alias("concept_name"), c["hits"].alias("hits"))))
    return top.join(lists.withColumnRenamed("query_id", "item_id"), "item_id", "left").select("item_id", "term", "occurrences", F.coalesce(record, F.lit("[]")).alias("candidates"))


def propose_columns(profile: DataFrame, roles: dict[str, tuple[str, ...]]) -> DataFrame:
    """(column, role, score) for profiled columns: the role of whose spellings the column's name holds the largest share
    of words; ties by role; columns that share no word with any role are left out. `profile`: name (see `column_profile`)."""
    rows = [(role, spelling) for role, spellings in roles.items() for spelling in spellings]
    spelled = profile.sparkSession.createDataFrame(rows, "role string, spelling string")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != ""))
    a = profile.select("name", words(F.col("name")).alias("own"))
    b = spelled.select("role", words(F.col("spelling")).alias("other"))
    pairs = a.select("name", "own", F.explode("own").alias("w")).join(b.select("role", "other", F.explode("other").alias("w")), "w")
    score = F.size(F.array_intersect("own", "other")) / F.size(F.array_union("own", "other"))
    best = pairs.groupBy("name", "role").agg(F.max(score).alias("score"))
    pick = F.struct((-F.col("score")).alias("s"), F.col("role").alias("r"))
    return best.groupBy("name").agg(F.min_by("role", pick).alias("role"), F.max("score").alias("score"))


def rank_with_model(candidates: DataFrame, rank) -> DataFrame:
    """Candidates in a model's order. `rank(term, names)` gives positions, best first; it is called once per term, in
    Arrow batches on the executors, and may ask a local service. Positions it leaves out keep their order behind the
    others; whatever it answers, no candidate is added or lost. Columns: term, concept_id, concept_name, rank."""
    import pandas as pd

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "concept_id"], ignore_index=True)
        n = len(pdf)
        said = [i for i in dict.fromkeys(rank(pdf["term"].iloc[0], pdf["concept_name"].tolist())) if isinstance(i, int) and 0 <= i < n]
        order = said + [i for i in range(n) if i not in set(said)]
        return pdf.iloc[order].assign(rank=range(1, n + 1))

    return candidates.select("term", "concept_id", "concept_name", F.col("rank").cast("int").alias("rank")).groupBy("term").applyInPandas(order, "term string, concept_id long, concept_name string, rank int")


def upsert_review(queue: DataFrame, found: DataFrame) -> DataFrame:
    """Review queue after a run: what is still found is open, what no longer is is resolved. Keyed by item_id."""
    new = found.select("item_id", F.col("term").alias("__term"), F.col("occurrences").alias("__n"), F.lit(True).alias("__found"))
    out = queue.join(new, "item_id", "full_outer")
    status = F.when(F.coalesce("__found", F.lit(False)), "open").otherwise("resolved")
    return out.select("item_id", F.coalesce("__term", "term").alias("term"), F.coalesce("__n", "occurrences").alias("occurrences"), status.alias("status"))


def compile_decisions(decisions: DataFrame) -> DataFrame:
    """One outcome per term: the latest date wins; two answers on that date conflict; incomplete ones are refused."""
    complete = F.col("concept_id").isNotNull() & F.col("decided_by").isNotNull() & F.col("decided_on").isNotNull()
    g = decisions.withColumn("__ok", complete).groupBy("code_system", "term_key")
    latest = g.agg(F.max(F.when(F.col("__ok"), F.col("decided_on"))).alias("latest"), F.count_if(~F.col("__ok")).alias("incomplete"))
    last = decisions.where(complete).join(latest, ["code_system", "term_key"]).where("decided_on = latest")
    out = last.groupBy("code_system", "term_key").agg(F.min("concept_id").alias("__a"), F.max("concept_id").alias("__b"))
    joined = latest.join(out, ["code_system", "term_key"], "left")
    outcome = F.when(F.col("__a").isNull(), "incomplete").when(F.col("__a") != F.col("__b"), "conflict").otherwise("accepted")
    return joined.select("code_system", "term_key", outcome.alias("outcome"), F.when(outcome == "accepted", F.col("__a")).alias("concept_id"), "incomplete")


def undecided_published(published: DataFrame, queue: DataFrame) -> DataFrame:
    return published.where("concept_id > 0").join(queue.where("status = 'open'").select("term_key"), "term_key", "left_semi")
