"""Display formats and date parsing, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import strip

MISSING = "Not available"
ZONE = "Asia/Kolkata"


def inr(value: Column, suffix: str = "", decimals: int = 2) -> Column:
    """Rupee amount: last three digits, then pairs; trailing zeros of the fraction dropped; the sign behind the currency mark."""
    fixed = F.format_string(f"%.{decimals}f", F.abs(value.cast("double")))
    whole = F.regexp_replace(F.substring_index(fixed, ".", 1), r"(?<=\d)(?=(\d\d)+\d$)", ",")
    fraction = F.rtrim(F.when(fixed.contains("."), F.substring_index(fixed, ".", -1)).otherwise(""), F.lit("0"))
    text = F.concat(F.lit("₹"), F.when(value < 0, "-").otherwise(""), whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit(suffix))
    return F.when(value.isNotNull(), text).otherwise(F.lit(MISSING))


def percent(value: Column) -> Column:
    text = strip(value.cast("string"))
    return F.coalesce(F.when(text.endswith("%"), text).otherwise(F.concat(text, F.lit("%"))), F.lit(MISSING))


def to_zone(text: Column, zone: str = ZONE) -> Column:
    """ISO text as a local timestamp of ``zone``; without an offset it is UTC; null where it can't be parsed."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), text)
    return F.from_utc_timestamp(iso.try_cast("timestamp"), zone)


def day(value: Column) -> Column:
    text = strip(value.cast("string"))
    made = F.date_format(to_zone(text), "dd MMM yyyy")
    return F.coalesce(F.when(text.rlike(r"^\d{2}-[A-Z][a-z]{2}-\d{4}$"), text).otherwise(F.coalesce(made, text)), F.lit(MISSING))


def month(value: Column) -> Column:
    text = value.cast("string")
    made = F.coalesce(F.date_format(to_zone(text), "MMM yyyy"), text)
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(MISSING))


def lock_in(years: Column, months: Column, days: Column) -> Column:
    def part(n: Column, unit: str) -> Column:
        return F.when(F.coalesce(n, F.lit(0)) != 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n != 1, "s").otherwise("")))

    text = F.concat_ws(" ", part(years, "year"), part(months, "month"), part(days, "day"))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("None"))


def parsed_date(value: Column) -> Column:
    """``05 Mar 2013``, ``05-Mar-2013``, ``2013-03-05``, else an ISO timestamp's local day; null otherwise."""
    text = strip(value.cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(p)).cast("date") for p in ("dd MMM yyyy", "dd-MMM-yyyy", "yyyy-MM-dd")]
    return F.coalesce(*tries, to_zone(text).cast("date"))
