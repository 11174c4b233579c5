"""Money, numbers, countries, dates and polymorphic JSON as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import let

#: US dollars per unit.
USD_RATES = {"USD": 1.0, "EUR": 1.08, "GBP": 1.27, "CHF": 1.13, "CAD": 0.74, "AUD": 0.66, "NZD": 0.61, "JPY": 0.0067, "CNY": 0.14, "INR": 0.012, "PKR": 0.0036, "AED": 0.272, "SAR": 0.266, "ZAR": 0.054, "BRL": 0.20, "MXN": 0.058, "SEK": 0.094, "NOK": 0.094, "DKK": 0.144}
#: Country names of UK procurement releases.
COUNTRY_NAMES = {"united kingdom": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB", "united states": "US", "germany": "DE", "france": "FR", "ireland": "IE"}
_INT4 = 2_147_483_647


def half_up(x: Column) -> Column:
    """Rounding to whole numbers with halves upwards, also below zero."""
    return F.floor(x + F.lit(0.5))


def _lookup(key: Column, table: dict[str, object]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def to_usd(amount: Column, currency: Column, rate: Column | None = None, overrides: dict[str, float] | None = None) -> Column:
    """Whole US dollars within 32 bits; null without a finite amount, a currency or any rate for it."""
    code = F.upper(currency)
    own = F.when((rate > 0) & ~F.isnan(rate) & (rate < float("inf")), rate) if rate is not None else F.lit(None).cast("double")
    factor = F.when(code == "USD", F.lit(1.0)).otherwise(F.coalesce(own, _lookup(code, USD_RATES | (overrides or {}))))
    finite = ~F.isnan(amount) & (F.abs(amount) < float("inf"))
    whole = half_up(amount.cast("double") * factor)
    return F.when(finite & (F.length(currency) > 0) & whole.isNotNull(), F.greatest(F.lit(-_INT4), F.least(F.lit(_INT4), whole)).cast("int"))


def leading_number(text: Column) -> Column:
    """The number that a text begins with; null where it begins with none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")


def country_iso2(name: Column, table: dict[str, str] | None = None) -> Column:
    return _lookup(F.lower(F.trim(name)), table or COUNTRY_NAMES)


def country_from_code(code: Column) -> Column:
    two = F.substring(F.upper(F.trim(code)), 1, 2)
    return F.when(F.length(two) == 2, two)


def pick_localized(value: Column) -> Column:
    """Of a JSON value: the string itself, a list's first element, or of a language map eng, en, then the first."""
    as_map = F.from_json(value, "map<string,string>")
    as_list = F.from_json(value, "array<string>")
    plain = F.when(value.rlike(r"^\s*[\[{]"), F.lit(None)).otherwise(F.regexp_replace(value, r'^\s*"|"\s*$', ""))
    of_map = F.coalesce(F.try_element_at(as_map, F.lit("eng")), F.try_element_at(as_map, F.lit("en")), F.get(F.map_values(as_map), F.lit(0)))
    inner = F.from_json(of_map, "array<string>")
    return F.coalesce(plain, F.when(value.rlike(r"^\s*\["), F.get(as_list, F.lit(0))), F.when(of_map.rlike(r"^\s*\["), F.get(inner, F.lit(0))).otherwise(of_map))


def to_string_array(value: Column) -> Column:
    """A JSON list as it is, anything else as a list of one; null as an empty list."""
    return F.when(value.isNull(), F.array().cast("array<string>")).when(value.rlike(r"^\s*\["), F.from_json(value, "array<string>")).otherwise(F.array(F.regexp_replace(value, r'^\s*"|"\s*$', "")))


#: Month names by their first three letters.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
#: Dialects: pattern, then the groups of year, month, day, hour, minute, am/pm, and hours from UTC.
DIALECTS = {
    "iso": (r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2}))?", (1, 2, 3, 4, 5, 0), 0.0),
    "slash_dmy": (r"(\d{1,2})/(\d{1,2})/(\d{4})(?:\s+(\d{1,2}):(\d{2}))?", (3, 2, 1, 4, 5, 0), 0.0),
    "slash_ymd": (r"(\d{4})/(\d{1,2})/(\d{1,2})", (1, 2, 3, 0, 0, 0), 0.0),
    "day_month_year": (r"(\d{1,2})(?:st|nd|rd|th)?[\s-]+([A-Za-z]{3})[A-Za-z]*\.?,?[\s-]+(\d{4})(?:\s+(\d{1,2}):(\d{2})\s*([AaPp][Mm])?)?", (3, 2, 1, 4, 5, 6), 0.0),
    "month_day_year": (r"([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?:\s+(\d{1,2}):(\d{2})\s*([AaPp][Mm])?)?", (3, 1, 2, 4, 5, 6), 0.0),
}
#: Portals: dialects in order of trial, and their local time's hours from UTC.
PORTALS = {
    "loose": (("iso", "month_day_year", "day_month_year"), 0.0),
    "ppra": (("month_day_year", "day_month_year"), 5.0),
    "punjab": (("slash_dmy", "day_month_year"), 5.0),
    "austender": (("day_month_year",), 10.0),
    "gebiz": (("day_month_year",), 8.0),
    "gem": (("day_month_year", "iso"), 5.5),
    "ecepp": (("slash_dmy",), 0.0),
    "gca": (("slash_dmy",), 0.0),
    "afdb": (("day_month_year",), 0.0),
    "iadb": (("month_day_year",), 0.0),
    "jica": (("slash_ymd",), 0.0),
    "iso": (("iso",), 0.0),
}


def _parsed(text: Column, dialect: str) -> Column:
    pattern, groups, _ = DIALECTS[dialect]
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, groups[k]), F.lit("")) if groups[k] else F.lit(None).cast("string")
    month = F.coalesce(_lookup(F.lower(F.substring(part(1), 1, 3)), MONTHS), part(1).try_cast("int"))
    half = F.lower(part(5))
    hour = F.coalesce(part(3).try_cast("int"), F.lit(0))
    hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    return F.try_make_timestamp(part(0).try_cast("int"), month, part(2).try_cast("int"), hour, F.coalesce(part(4).try_cast("int"), F.lit(0)), F.lit(0).cast("decimal(16,6)"))


def _with_offset(text: Column) -> Column:
    sign = F.when(F.regexp_extract(text, r"GMT\s*([+-])", 1) == "-", -1.0).otherwise(1.0)
    hours = F.coalesce(F.regexp_extract(text, r"GMT\s*[+-]?\s*(\d{1,2})", 1).try_cast("double"), F.lit(0.0)) + F.coalesce(F.regexp_extract(text, r"GMT\s*[+-]?\s*\d{1,2}[.:](\d{1,2})", 1).try_cast("double"), F.lit(0.0)) / F.when(text.rlike(r"GMT\s*[+-]?\s*\d{1,2}:"), 60.0).otherwise(100.0)
    return _parsed(text, "day_month_year") - F.make_dt_interval(mins=(sign * hours * 60).cast("int"))


def parse_date(text: Column, portal: str = "loose") -> Column:
    """UTC time of a portal's date text, or null; days that a month does not have are null. UNGM names its own offset."""
    if portal == "ungm":
        return let(text, _with_offset)
    dialects, offset = PORTALS[portal]
    return let(text, lambda t: F.coalesce(*[_parsed(t, d) for d in dialects])) - F.make_dt_interval(mins=F.lit(int(offset * 60)))


#: Hours of the zones that feeds name.
ZONES = {"ut": 0, "utc": 0, "gmt": 0, "z": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
_MAIL_DATE = r"^\s*(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4}|\d{2})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?\s*([A-Za-z]+|[+-]\d{2}:?\d{2})?\s*$"
_NET_DATE = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})(?:[Tt ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*([A-Za-z]+|[+-]\d{2}:?\d{2})?)?\s*$"


def feed_date(text: Column) -> Column:
    """The instant of a feed's date: of mail headers (``Tue, 05 Mar 2024 10:00:00 +0300``, ``5 Mar 24 10:00 EST``) or of the net
    (``2024-03-05T10:00:00-05:00``). No zone is UTC; a zone that is not known, or a day that its month lacks, is null."""
    found = []
    for pattern, order in ((_MAIL_DATE, (3, 2, 1)), (_NET_DATE, (1, 2, 3))):
        part = lambda k, pattern=pattern: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
        year, month, day = (part(k) for k in order)
        n = year.try_cast("int")
        year = F.when(F.length(year) == 4, n).when(n < 50, n + 2000).otherwise(n + 1900)
        month = F.coalesce(_lookup(F.lower(F.substring(month, 1, 3)), MONTHS), month.try_cast("int"))
        clock = [F.coalesce(part(k).try_cast("int"), F.lit(0)) for k in (4, 5, 6)]
        at = F.try_make_timestamp(year, month, day.try_cast("int"), clock[0], clock[1], clock[2].cast("decimal(16,6)"))
        zone = part(7)
        digits = F.regexp_replace(zone, "[^0-9]", "")
        signed = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)
        minutes = F.when(zone.isNull(), 0).when(zone.rlike("^[+-]"), signed).otherwise(_lookup(F.lower(zone), ZONES) * 60)
        found.append(at - F.make_dt_interval(mins=minutes))
    return F.coalesce(*found)


def min_max_dates(dates: Column) -> tuple[Column, Column]:
    """Published and deadline of a row's dates: of two or more the earliest and the latest; one alone is the deadline."""
    known = F.filter(dates, lambda x: x.isNotNull())
    return F.when(F.size(known) >= 2, F.array_min(known)), F.array_max(known)


def dimension(spark: SparkSession, table: dict[str, object], key: str, value: str) -> DataFrame:
    """A small fixed table for a broadcast join."""
    return spark.createDataFrame(list(table.items()), [key, value])
