"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import word_count

#: Documents of a source are laid out in the order of a hash; sums are kept for so many ranges of it.
RANGE_DIGITS = 4


def schedule(*knots: tuple[float, float]) -> Column:
    """A weight schedule: piecewise linear through (time, weight) from time 0 to time 1."""
    return F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in knots])


def _segments(knots: Column) -> Column:
    """Knots as segments (t, w, slope, from, upto) with the integral of the weight before and after each."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.struct(F.element_at(knots, i).alias("a"), F.element_at(knots, i + 1).alias("b")))
    zero = F.array().cast("array<struct<t:double,w:double,slope:double,from:double,upto:double>>")

    def add(done: Column, p: Column) -> Column:
        dt = p["b"]["t"] - p["a"]["t"]
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["upto"], F.lit(0.0))
        area = dt * (p["a"]["w"] + p["b"]["w"]) / F.lit(2.0)
        return F.concat(done, F.array(F.struct(p["a"]["t"].alias("t"), p["a"]["w"].alias("w"), (p["b"]["w"] - p["a"]["w"]).__truediv__(dt).alias("slope"), before.alias("from"), (before + area).alias("upto"))))

    return F.aggregate(pairs, zero, add)


def _invert(segments: Column, area: Column) -> Column:
    """The time by which the integral of the weight reaches `area`."""
    s = F.coalesce(F.try_element_at(F.filter(segments, lambda x: x["upto"] > area), F.lit(1)), F.element_at(segments, -1))
    rest = F.greatest(area - s["from"], F.lit(0.0))
    root = F.sqrt(F.greatest(s["w"] * s["w"] + F.lit(2.0) * s["slope"] * rest, F.lit(0.0)))
    return F.least(s["t"] + F.coalesce(F.try_divide(F.lit(2.0) * rest, s["w"] + root), F.lit(0.0)), F.lit(1.0))


def source_targets(totals: DataFrame, *, max_repeats: int = 3, total: Column | None = None) -> DataFrame:
    """Words each source is to give. `totals`: source, source_size, knots; adds segments, weight, target.

    The weight of a source is the integral of its schedule. The sources share `total` (by default all words)
    by weight; none gives more than `max_repeats` times its size and the excess goes to the others by weight.
    That is one water level: in the order of size / weight, a prefix of the sources is full. A window over
    one row per source finds it; sources without weight or words get 0.
    """
    everything = Window.partitionBy()
    fill = Window.partitionBy().orderBy(F.col("ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    t = totals.withColumn("segments", _segments(F.col("knots"))).withColumn("weight", F.element_at("segments", -1)["upto"])
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))).withColumn("ratio", F.try_divide(F.col("cap"), F.col("weight")))
    t = t.withColumn("all_words", F.sum("source_size").over(everything) if total is None else total)
    t = t.withColumn("full_before", F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    t = t.withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", F.try_divide(F.col("all_words") - F.col("full_before"), F.col("weight_left")))
    t = t.withColumn("is_full", F.coalesce(F.col("level") >= F.col("ratio"), F.lit(True)))
    t = t.withColumn("water", F.max(F.when(~F.col("is_full"), F.col("level"))).over(everything))
    target = F.when(F.col("weight") <= 0, 0.0).when(F.col("is_full"), F.col("cap")).otherwise(F.col("weight") * F.col("water"))
    return t.select("source", "source_size", "segments", "weight", target.alias("target"))


def curriculum(docs: DataFrame, knots_of, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_repeats: int = 3, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, positions.

    `knots_of(totals)` turns (source, source_size, n_docs) into (source, source_size, knots). A source's
    documents lie in the order of md5(doc_id), pass after pass; a copy whose middle word lies below the
    source's target is taken, so what is taken misses the target by at most half a document. The middle word
    is demand that the schedule has to have summed up: inverting the integral of the schedule gives the
    training position in [0, 1] of each copy. `positions` holds them in order of the passes.

    Offsets within a source come from sums of 65,536 hash ranges and a window within each range, so a
    source with a third of all rows spreads over all tasks. Null text and text without words have size 0:
    they are taken with the passes but add nothing. Null source is a source of its own, null ids hash as an
    empty id; rows that repeat an id are documents of their own, of equal size by the hash of their texts. An empty table gives no rows.
    `carry` keeps the input row as struct `row`.
    """
    kept = [F.struct(*docs.columns).alias("row")] if carry else []
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), F.xxhash64(text_col).alias("tie"), *kept)
    rows = rows.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("unnamed", F.col("source").isNull()).withColumn("span", F.substring("key", 1, RANGE_DIGITS))
    sums = rows.groupBy("unnamed", "name", "span").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    per_source = sums.groupBy("unnamed", "name").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs"))
    per_source = per_source.select(F.when(F.col("unnamed"), None).otherwise(F.col("name")).alias("source"), "source_size", "n_docs")
    targets = source_targets(knots_of(per_source), max_repeats=max_repeats).withColumn("unnamed", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))).drop("source")
    # prefix sums in two steps of 256 each: no window holds more than 256 rows, however large its source is
    up_to = lambda keys, order: F.sum("words").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    sums = sums.withColumn("part", F.substring("span", 1, RANGE_DIGITS // 2))
    parts = sums.groupBy("unnamed", "name", "part").agg(F.sum("words").alias("words"))
    parts = parts.select("unnamed", "name", "part", up_to(["unnamed", "name"], "part").alias("ahead"))
    spans = sums.withColumn("inside", up_to(["unnamed", "name", "part"], "span")).join(parts, ["unnamed", "name", "part"])
    spans = spans.select("unnamed", "name", "span", (F.col("ahead") + F.col("inside")).alias("before")).join(targets, ["unnamed", "name"])
    within = Window.partitionBy("unnamed", "name", "span").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(spans, ["unnamed", "name", "span"]).withColumn("offset", F.col("before") + F.sum("size").over(within) - F.col("size"))
    middle = lambda k: k * F.col("source_size") + F.col("offset") + F.col("size") / F.lit(2.0)
    passes = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda k: middle(k))
    taken = F.filter(passes, lambda y: y < F.col("target"))
    positions = F.transform(taken, lambda y: _invert(F.col("segments"), y * F.col("weight") / F.col("target")))
    return placed.withColumn("copies", F.size(taken)).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), positions.alias("positions"), *(["row"] if carry else []))


def training_order(docs: DataFrame, knots_of, **options) -> DataFrame:
    """The copies that the curriculum takes, with the columns of `docs`, range-sorted by training position."""
    out = curriculum(docs, knots_of, carry=True, **options).select("row", F.posexplode("positions").alias("pass", "position"))
    return out.repartitionByRange(F.col("position"), F.xxhash64("row")).sortWithinPartitions("position", F.xxhash64("row")).select("row.*")


def ranked_schedules(totals: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Sources by code point, null last, weigh `weights` in turn: the first kind fades in, the last fades out."""
    turn = F.pmod(F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    shapes = [schedule((0, w * (0.5 + i * 0.5)), (1, w * (1.5 - i * 0.5))) for i, w in enumerate(weights)]
    knots = F.when(turn == 0, shapes[0])
    for i, s in enumerate(shapes[1:], 1):
        knots = knots.when(turn == i, s)
    return totals.select("source", "source_size", knots.alias("knots"))
