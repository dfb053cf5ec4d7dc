"""Canonical text of cells and rows, and the identities hashed from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "\x1f"
NULL_LITERALS = ("NULL",)
#: Part of every stable id: changing the rules of this module means changing it.
RULES = "1"


def strip(text: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def source_cell(text: Column, null_literals: Sequence[str] = NULL_LITERALS) -> Column:
    """A cell as it is stored: stripped, null literals empty, otherwise as written."""
    s = strip(text)
    return F.when(text.isNull() | s.isin(*null_literals), "").otherwise(s)


def canonical_cell(value: Column, kind: T.DataType | None = None, null_literals: Sequence[str] = NULL_LITERALS) -> Column:
    """A cell as it is hashed, so that one fact typed in two ways hashes once.

    Null is empty; text is stripped, a null literal is empty, a date or time gets the form of a timestamp to
    the second; whole floating numbers lose the point; booleans are true or false.
    """
    kind = kind or T.StringType()
    if isinstance(kind, T.StringType):
        s = source_cell(value, null_literals)
        dated = s.rlike(r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?)?$")
        clock = F.regexp_extract(s, r"^.{10}[ T](\d{2}:\d{2}(?::\d{2})?)", 1)
        clock = F.when(clock == "", "00:00:00").when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
        return F.when(dated, F.concat(F.substring(s, 1, 10), F.lit("T"), clock)).otherwise(s)
    if isinstance(kind, T.BooleanType):
        text = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        x = value.cast("double")
        whole = (x == F.floor(x)) & (F.abs(x) < 9.2e18)
        text = F.when(F.isnan(x), "").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        text = F.date_format(value.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    elif isinstance(kind, T.BinaryType):
        text = F.sha2(value, 256)
    elif isinstance(kind, T.IntegralType):
        text = value.cast("string")
    else:
        raise TypeError(f"no canonical text for {kind.simpleString()}")
    return F.coalesce(text, F.lit(""))


def canonical_row(cells: Sequence[Column]) -> Column:
    """Canonical cells joined by the unit separator; none is null, so none is skipped."""
    return F.concat_ws(SEPARATOR, *cells)


def row_hash(cells: Sequence[Column]) -> Column:
    return F.sha2(canonical_row(cells), 256)


def source_row_id(dataset: Column, partition: Column, source: Column, file_hash: Column, row_number: Column) -> Column:
    return F.sha2(F.concat_ws("|", dataset, partition, source, file_hash, row_number.cast("string")), 256)


def stable_id(cells: Sequence[Column], prefix: str = "") -> Column:
    return F.sha2(F.concat(F.lit(f"{prefix}{RULES}{SEPARATOR}"), canonical_row(cells)), 256)


def _leading_bytes(text: Column) -> Column:
    """First eight bytes of the sha256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def subject_id(dataset: Column, key: Column, salt: str = "") -> Column:
    """63-bit number of a person's key: the same on every machine, not to be traced back."""
    n = _leading_bytes(F.concat_ws(SEPARATOR, F.lit(salt), dataset, strip(key)))
    return (n % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("bigint")


def bucket(subject: Column, buckets: int) -> Column:
    if buckets <= 0:
        raise ValueError("the number of buckets must be positive")
    return (_leading_bytes(subject.cast("string")) % F.lit(buckets).cast("decimal(20,0)")).cast("int")


def split_point(subject: Column, salt: str = "") -> Column:
    """Position of a subject in [0, 1) by which it gets its split."""
    return _leading_bytes(F.concat_ws(SEPARATOR, F.lit(salt), F.lit("split"), subject.cast("string"))).cast("double") / F.lit(float(2**64))


def split_name(subject: Column, weights: Sequence[tuple[str, float]], salt: str = "") -> Column:
    total, upto = sum(w for _, w in weights), 0.0
    if total <= 0:
        raise ValueError("the weights must have a positive sum")
    point, out = split_point(subject, salt) * total, None
    for name, weight in weights[:-1]:
        upto += weight
        out = F.when(point < upto, name) if out is None else out.when(point < upto, name)
    return F.lit(weights[-1][0]) if out is None else out.otherwise(weights[-1][0])
