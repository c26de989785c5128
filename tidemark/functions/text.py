"""Dates, season windows and identifiers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_range(start: Column, days: Column | int) -> Column:
    """(first, last) of ``start`` ('dd/MM/yyyy') and so many days more, both included."""
    first = F.to_date(start, "dd/MM/yyyy")
    return F.struct(first.alias("first"), F.date_add(first, (F.lit(days) if isinstance(days, int) else days).cast("int")).alias("last"))


def month_range(start: Column, end: Column) -> Column:
    """First day of 'yyyy/MM' start to the last day of 'yyyy/MM' end."""
    return F.struct(F.to_date(start, "yyyy/MM").alias("first"), F.last_day(F.to_date(end, "yyyy/MM")).alias("last"))


def season(year: Column, first_month: Column, last_month: Column) -> Column:
    """First day of the first month to the last day of the last month of one year."""
    one = F.lit(1)
    return F.struct(F.make_date(year, first_month, one).alias("first"), F.last_day(F.make_date(year, last_month, one)).alias("last"))


def month_tag(date: Column) -> Column:
    return F.date_format(date, "yyyyMM")


def dry_months(months: Column) -> Column:
    """'04,05' as sorted integers."""
    return F.array_sort(F.transform(F.split(months, ","), lambda m: F.trim(m).cast("int")))


def date_token(key: Column, index: int = -5, strict: bool = True) -> Column:
    """Eight digits that open the ``index``-th part of an id between underscores, else the first part that opens so.

    An id without such a part is an error, or NULL if not ``strict``."""
    parts = F.split(key, "_")
    at = F.try_element_at(parts, F.lit(index if index < 0 else index + 1))
    own = F.nullif(F.regexp_extract(at, "^([0-9]{8})", 1), F.lit(""))
    other = F.nullif(F.regexp_extract(key, "(?:^|_)([0-9]{8})", 1), F.lit(""))
    found = F.coalesce(own, other)
    if not strict:
        return found
    return F.when(key.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no date in id: "), key)))


def file_name(scene_id: Column) -> Column:
    """The id with anything but letters, digits, _ and - made _."""
    return F.regexp_replace(scene_id, "[^A-Za-z0-9_-]", "_")


def id_part(scene_id: Column, index: int) -> Column:
    """The part of an id between underscores; NULL if there are fewer."""
    return F.try_element_at(F.split(scene_id, "_"), F.lit(index + 1))


def season_tag(dry_years, wet_months) -> str:
    """DRY_a_b_WET_yyyymm_yyyymm of a run; what its tables are partitioned by."""
    return f"DRY_{min(dry_years)}_{max(dry_years)}_WET_{wet_months[0].replace('/', '')}_{wet_months[-1].replace('/', '')}"


def contiguous_years(years) -> list[int]:
    """Every year between the first and the last."""
    return list(range(min(years), max(years) + 1))
