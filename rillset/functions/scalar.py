"""Scalar helpers where a common dialect's meaning differs from Spark's, as Column functions and as SQL functions.

register(spark) makes the SQL forms; they are SQL expressions that Catalyst inlines, not UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: name: (arguments, result, body). All null-propagating.
SQL_FUNCTIONS = {
    "int_div": ("a BIGINT, b BIGINT", "BIGINT", "a div nullif(b, 0)"),
    "safe_div": ("a DOUBLE, b DOUBLE", "DOUBLE", "a / nullif(b, 0)"),
    "safe_mod": ("a BIGINT, b BIGINT", "BIGINT", "a % nullif(b, 0)"),
    "strip_text": ("s STRING", "STRING", r"regexp_replace(s, '^(?U)\\s+|(?U)\\s+$', '')"),
    "lstrip_text": ("s STRING", "STRING", r"regexp_replace(s, '^(?U)\\s+', '')"),
    "rstrip_text": ("s STRING", "STRING", r"regexp_replace(s, '(?U)\\s+$', '')"),
    "sub_text": ("s STRING, start INT, n INT", "STRING", "substring(s, greatest(start, 1), n)"),
    "starts_with": ("s STRING, prefix STRING", "BOOLEAN", "startswith(s, prefix)"),
    "add_date_days": ("d DATE, n INT", "DATE", "date_add(d, n)"),
    "subtract_date_days": ("d DATE, n INT", "DATE", "date_sub(d, n)"),
    "day_of_week": ("d DATE", "BIGINT", "CAST(extract(DAYOFWEEK_ISO FROM d) AS BIGINT)"),
    "day_of_year": ("d DATE", "BIGINT", "CAST(extract(DOY FROM d) AS BIGINT)"),
    "trunc_date": ("unit STRING, d DATE", "DATE", "CASE WHEN upper(unit) = 'DAY' THEN d ELSE trunc(d, unit) END"),
    "whole_days": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", "timestampdiff(DAY, a, b)"),
    "whole_weeks": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", "timestampdiff(WEEK, a, b)"),
    "whole_months": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", "timestampdiff(MONTH, a, b)"),
    "whole_years": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", "timestampdiff(YEAR, a, b)"),
    "whole_hours": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", "timestampdiff(HOUR, a, b)"),
    "whole_minutes": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", "timestampdiff(MINUTE, a, b)"),
    "whole_seconds": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", "timestampdiff(SECOND, a, b)"),
}

UNITS = ("SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "YEAR")
FIELDS = {"YEAR": "YEAR", "MONTH": "MONTH", "DAY": "DAY", "DOW": "DAYOFWEEK_ISO", "DAY_OF_WEEK": "DAYOFWEEK_ISO", "DOY": "DOY", "DAY_OF_YEAR": "DOY", "HOUR": "HOUR", "MINUTE": "MINUTE", "SECOND": "SECOND"}


def register(spark: SparkSession) -> None:
    for name, (arguments, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")


def int_div(a: Column, b: Column) -> Column:
    """Integer division towards zero; null by zero."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def safe_div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def safe_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; null by zero."""
    return a % F.nullif(b, F.lit(0))


def strip(s: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(s, r"^(?U)\s+|(?U)\s+$", "")


def lstrip(s: Column) -> Column:
    return F.regexp_replace(s, r"^(?U)\s+", "")


def rstrip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+$", "")


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """From a place counted from 1; places before the first count as the first, without shortening the length."""
    from_one = F.greatest(start, F.lit(1))
    return F.substr(s, from_one) if length is None else F.substr(s, from_one, length)


def extract(field: str, d: Column) -> Column:
    """A field of a date or timestamp as BIGINT; days of the week run from Monday, 1, to Sunday, 7."""
    return F.extract(F.lit(FIELDS[field.upper()]), d).cast("long")


def date_trunc(unit: str, d: Column, is_date: bool) -> Column:
    if is_date:
        return d if unit.upper() == "DAY" else F.trunc(d, unit)
    return F.date_trunc(unit, d)


def date_diff(unit: str, a: Column, b: Column) -> Column:
    """Complete units from a to b, negative when b comes first."""
    if unit.upper() not in UNITS:
        raise ValueError(f"unit {unit}")
    return F.timestamp_diff(unit.upper(), a, b)
