"""Text, hash and JSON column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """trimmed, white space collapsed, lower-cased; empty is null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))


def squeezed(c: Column) -> Column:
    """The same in its own spelling."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def is_marked(c: Column, mark: str = "x") -> Column:
    """a cell that says yes."""
    return F.coalesce(F.lower(F.trim(c)) == mark, F.lit(False))


def number(c: Column) -> Column:
    """Decimal comma or point; anything else is null, and NaN too."""
    value = F.expr("cast(null as double)") if c is None else F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(value), value)


def month_key(year: Column, month: Column) -> Column:
    """'YYYY-MM'."""
    return F.format_string("%04d-%02d", year.cast("int"), month.cast("int"))


def meter_household(gp_nr: Column, mp_id: Column) -> Column:
    """The household of a meter, or a household made from the meter."""
    return F.coalesce(gp_nr, F.concat(F.lit("MP:"), mp_id))


def pseudonym(c: Column, salt: str = "", size: int = 10) -> Column:
    """short digest of an id."""
    return F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, size)


def in_hash_sample(c: Column, every: int) -> Column:
    """One id in ``every``, the same ids in each month and process."""
    return F.crc32(c.cast("string").cast("binary")) % every == 0


def json_list(values: Column) -> Column:
    """sorted distinct values as JSON."""
    return F.to_json(F.array_sort(F.array_distinct(values)))


def has_part(c: Column, part: str) -> Column:
    """Case-insensitive substring; null is no."""
    return F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))
