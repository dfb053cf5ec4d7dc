"""Result cells: number, number with unit, range, comparator, signature, sentinel or text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.hashing import NULL_LITERALS, strip

# Patterns and words that decide how a cell reads.
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
NUMBER_UNIT = rf"^({NUMBER})\s+([^\s].*)$"
RANGE = rf"^({NUMBER})\s*(?:-|–|—|to)\s*([+-]?\d+\.?\d*)$"
COMPARATOR = rf"^(<=|>=|<|>)\s*({NUMBER})$"
SENTINELS = (
    "see below", "see comment", "see comments", "see note", "see report", "see previous", "pending",
    "not calculated", "unable to calculate", "cancelled", "canceled", "qns", "tnp", "no result",
)
SIGNATURES = (
    r"(?i)^\s*(?:electronically\s+)?(?:confirmed|verified|signed|reviewed|finalized|edited)\b.*\bby\b",
    r"(?i)^\s*(?:confirmed|verified|signed)\s+by\b",
)


def _number(text: Column) -> Column:
    return F.when(text.rlike(f"^{NUMBER}$"), text).try_cast("double")


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once per row: plans stay small where an expression is used many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parse_value(cell: Column, unit: Column | None = None, *, known_units: Sequence[str] | None = None, sentinels: Sequence[str] = SENTINELS, null_literals: Sequence[str] = NULL_LITERALS) -> Column:
    """A cell as struct (form, number, text, low, high, unit, flag); the first form that fits decides.

    A number followed by words is a measurement only if the words are a known unit; otherwise it is text that
    gets a flag. Ranges keep their ends, comparators only their text: `<0.5` is not 0.5.
    """
    clean = lambda c: bind(strip(c), lambda x: F.when(~x.isin("", *null_literals), x))
    hint = clean(unit) if unit is not None else F.lit(None).cast("string")
    known = [u.strip().lower() for u in known_units] if known_units is not None else None

    def form_of(t: Column) -> Column:
        numbered = t.rlike(NUMBER_UNIT) & ~t.rlike(RANGE)
        unit_fits = F.lower(F.trim(F.regexp_extract(t, NUMBER_UNIT, 2))).isin(*known) if known is not None else F.lit(True)
        signed = F.lit(False)
        for pattern in SIGNATURES:
            signed = signed | t.rlike(pattern)
        return (
            F.when(t.isNull(), "absent")
            .when(t.rlike(f"^{NUMBER}$"), "number")
            .when(numbered & unit_fits, "number_unit")
            .when(t.rlike(RANGE) & (_number(F.regexp_extract(t, RANGE, 1)) <= _number(F.regexp_extract(t, RANGE, 2))), "range")
            .when(t.rlike(COMPARATOR), "comparator")
            .when(signed, "signature")
            .when(F.lower(F.trim(t)).isin(*sentinels), "sentinel")
            .when(numbered, "numbered_text")
            .otherwise("text")
        )

    def fields(t: Column, hint: Column, form: Column) -> Column:
        is_ = lambda *names: form.isin(*names)
        own = F.when(is_("number_unit"), F.trim(F.regexp_extract(t, NUMBER_UNIT, 2)))
        flag = (
            F.when(is_("number_unit") & hint.isNotNull() & (hint != own), "UNIT_UNPARSED")
            .when(is_("range"), "RANGE_VALUE")
            .when(is_("comparator"), "COMPARATOR_VALUE")
            .when(is_("signature"), "SIGNATURE_LINE")
            .when(is_("sentinel", "numbered_text"), "NON_NUMERIC_RESULT")
        )
        return F.struct(
            F.when(is_("numbered_text"), "text").otherwise(form).alias("form"),
            F.when(is_("number"), _number(t)).when(is_("number_unit"), _number(F.regexp_extract(t, NUMBER_UNIT, 1))).alias("number"),
            F.when(~is_("absent", "number", "number_unit"), t).alias("text"),
            F.when(is_("range"), _number(F.regexp_extract(t, RANGE, 1))).alias("low"),
            F.when(is_("range"), _number(F.regexp_extract(t, RANGE, 2))).alias("high"),
            F.coalesce(hint, own).alias("unit"),
            flag.alias("flag"),
        )

    text_and_form = bind(clean(cell), lambda t: F.struct(t.alias("t"), hint.alias("h"), form_of(t).alias("f")))
    return bind(text_and_form, lambda x: fields(x["t"], x["h"], x["f"]))


def reference_bound(cell: Column) -> Column:
    """A bound of a reference range: only a plain number is one."""
    return _number(strip(cell))


def dose_identity(cell: Column) -> Column:
    """`10 MG` and `10.0 mg` are one dose; anything else is its lower-case text."""

    def name(p: Column) -> Column:
        n = F.when(p["number"] == F.floor(p["number"]), p["number"].cast("bigint").cast("string")).otherwise(p["number"].cast("string"))
        return F.when(p["number"].isNotNull(), F.concat_ws(" ", n, F.lower(p["unit"]))).otherwise(F.lower(strip(cell)))

    return bind(parse_value(cell), name)


def parse_rate(cell: Column, unit: Column) -> Column:
    """A rate as struct (source, number, unit, flag)."""
    own = strip(cell)
    return bind(parse_value(cell), lambda p: F.struct(own.alias("source"), p["number"].alias("number"), F.when(p["number"].isNull(), unit).otherwise(F.coalesce(unit, p["unit"])).alias("unit"), F.when(own.isNotNull() & p["number"].isNull(), "RATE_UNPARSED").alias("flag")))


def numeric_or_quarantine(df, cell: str, unit: str | None = None, **options):
    """(rows with `parsed`, refused rows) of a column that is declared numeric: a cell that no numeric form reads, nor
    absence, a comparator, a signature or a sentinel, is refused with UNPARSEABLE_VALUE and its first 200 characters."""
    from sparkloom.functions.storage import fresh

    (name,) = fresh(df, "parsed")
    out = df.withColumn(name, parse_value(F.col(cell), None if unit is None else F.col(unit), **options))
    refused = F.col(name)["form"] == "text"
    bad = out.where(refused).drop(name).withColumns({"reason": F.lit("UNPARSEABLE_VALUE"), "preview": F.substring(strip(F.col(cell)), 1, 200)})
    return out.where(~refused), bad
