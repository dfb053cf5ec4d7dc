"""Small text functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUTHY = ("1", "true", "yes", "y", "t")


def truthy(cell: Column) -> Column:
    return F.coalesce(F.lower(F.trim(cell)).isin(*TRUTHY), F.lit(False))


def first_filled(*cells: Column) -> Column:
    """First cell that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cells])


def first_filled_index(*cells: Column) -> Column:
    """Index from 0 of the cell that `first_filled` takes; null if none answers."""
    out = None
    for i, c in enumerate(cells):
        hit = F.nullif(F.trim(c), F.lit("")).isNotNull()
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def unmasked_first(cells: Sequence[Column], masked: Sequence[str]) -> Column:
    """First filled cell; a masked literal counts only if no other cell answers."""
    clear = [F.when(~F.trim(c).isin(*masked), c) for c in cells]
    return F.coalesce(first_filled(*clear), first_filled(*cells))


def normalize_term(text: Column) -> Column:
    """Lower case, punctuation of lists as spaces, single spaces: what terms are looked up by."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[,;:()\[\]\"']", " "), r"\s+", " "))


def unpunctuated(code: Column) -> Column:
    return F.translate(F.upper(code), ". -/", "")


def mask_shape(text: Column) -> Column:
    """Digits as 9 and letters as a."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Za-z]", "a")


def sig_text(dose: Column, rate: Column, most: int = 250) -> Column:
    return F.substring(F.concat_ws("; ", dose, F.concat(F.lit("rate "), rate)), 1, most)


def record_key(cells: Sequence[Column]) -> Column:
    """md5 of cells where null differs from empty."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cells]).cast("binary"))


def as_int(text: Column) -> Column:
    """Whole part of a number in text, null if it is none."""
    x = F.when(F.trim(text).rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), F.trim(text)).try_cast("double")
    return F.when(F.abs(x) < 2**31, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))).cast("int")


#: The longest spelling that is shown, and what a date or a time of day looks like.
SHOWN = 20
DATED = r"\d{1,2}/\d{1,2}(/\d{2,4})?\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}:\d{2}\b"


def reportable(spelling: Column) -> Column:
    """A spelling as a report may show it: at most two words of at most `SHOWN` characters without a comma or a date
    stand as they are, since free text could name a person; of anything else the report has digest and length."""
    shown = spelling.rlike(rf"(?s)^(?=.{{0,{SHOWN}}}$)[^,]*$") & spelling.rlike(r"^\s*(\S+(\s+\S+)?)?\s*$") & ~spelling.rlike(DATED)
    return F.when(shown, spelling).otherwise(F.format_string("text#%s(%s chars)", F.left(F.sha2(spelling, 256), F.lit(12)), F.length(spelling)))


def item_id(kind: Column, system: Column, term: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", kind, F.coalesce(system, F.lit("")), term), 256), 1, 16)
