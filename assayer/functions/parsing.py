"""Expressions that turn text into typed values; anything unparseable becomes null."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalise, strip

# fixed values: tokens a CSV reader treats as missing
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# fixed values: the vocabularies a two-valued column is matched against
BOOLEAN_VOCABULARIES = [
    ["true", "false"], ["yes", "no"], ["y", "n"], ["t", "f"], ["0", "1"], ["0.0", "1.0"],
]
TRUE_TOKENS = ["true", "yes", "y", "t", "1", "1.0"]
FALSE_TOKENS = ["false", "no", "n", "f", "0", "0.0"]

# fixed values: the accepted layouts of a day as (guard, Spark pattern); month comes before day when ambiguous
DAY_LAYOUTS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "M.d.yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}[ -][A-Za-z]{3}[ -]\d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2},? \d{4}$", "MMMM d yyyy"),
]
# fixed value: two-digit years from here on belong to the last century
_CENTURY = 2070
_DAY_NAMES, _MONTH_NAMES = "mon|tue|wed|thu|fri|sat|sun", "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_WEEKDAY = rf"(?i)^({_DAY_NAMES})[a-z]*,? +"
# a time of day after the day, with an optional half of the day and zone
_CLOCK = (r"(?i)(?:(?<=\d)T| +)(\d{1,2}):(\d{2})(?::(\d{2})(\.\d+)?)?(?: ?([ap])\.?m\.?)?(?: ?(z|utc|gmt|[+-]\d{2}:?\d{2}))?$")
# the day and the six parts of a time, between signs that no date holds
_TAKEN_APART = "\x01".join(f"${k}" for k in range(1, 8))
_COMPACT = r"^\d{8}T\d{6}$"
_ISO = r"^\d{4}-\d{1,2}(-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?(Z|[+-]\d{2}:?\d{2}))?)?)?$"
# how any of the forms above begins; a number with one point is none of them
_DATE_LIKE = (r"^(?=[^0-9]*[0-9])(?!\d*\.\d*$)(?:\d{8}(?!\d)|\d{1,4}[-/. ]"
              rf"|(?i:{_DAY_NAMES}|{_MONTH_NAMES})[A-Za-z]*,? )[A-Za-z0-9 ,:/.+-]*$")
_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$"


def null_if_missing(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def parse_number(c: Column) -> Column:
    """Double value of a numeric text; the guard refuses suffixes such as 1f that a cast would accept."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def _day(s: Column) -> Column:
    """Midnight of a day in one of DAY_LAYOUTS."""
    tidy = F.initcap(F.regexp_replace(F.regexp_replace(s, ",", ""), "(?<=[A-Za-z])-|-(?=[A-Za-z])", " "))
    layouts: dict[str, list[Column]] = {}
    for guard, layout in DAY_LAYOUTS:
        day = F.try_to_timestamp(tidy if "MMM" in layout else s, F.lit(layout))
        if layout.endswith("/yy"):
            day = F.when(F.year(day) >= _CENTURY, day - F.expr("interval 100 years")).otherwise(day)
        layouts.setdefault(guard, []).append(day)
    (first, attempts), *others = layouts.items()
    parsed = F.when(s.rlike(first), F.coalesce(*attempts))
    for guard, attempts in others:
        parsed = parsed.when(s.rlike(guard), F.coalesce(*attempts))
    return parsed


def _seconds(parts: Column) -> Column:
    """Seconds from midnight in the session's zone (UTC) of a time taken apart by _CLOCK; null for impossible times."""
    def part(k: int) -> Column:
        return F.nullif(parts[k], F.lit(""))

    hour, half, zone = part(1).cast("int"), F.lower(part(5)), F.lower(part(6))
    hour24 = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    minute, second = part(2).cast("int"), F.coalesce(part(3).cast("int"), F.lit(0))
    digits = F.regexp_replace(zone, "[^0-9]", "")
    shift = (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60) * F.when(zone.startswith("-"), -1).otherwise(1)
    shift = F.when(zone.rlike("^[+-]"), shift).otherwise(0)
    fraction = F.coalesce(part(4).cast("double"), F.lit(0.0))
    return F.when((hour24 <= 23) & (minute <= 59) & (second <= 59), hour24 * 3600 + minute * 60 + second - shift + fraction)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _parse_stripped_datetime(s: Column) -> Column:
    # a day, a time and a zone are read each for itself, so that any of the layouts can be combined; one match takes them apart
    def combined(parts: Column) -> Column:
        day = _day(parts[0])
        return F.when(F.size(parts) == 1, day).otherwise(_let(day, lambda d: F.timestamp_micros(
            F.unix_micros(d) + F.when(d.isNotNull(), F.round(_seconds(parts) * 1_000_000).cast("bigint")))))

    pieces = F.split(F.regexp_replace(F.regexp_replace(s, _WEEKDAY, ""), "^(.*?)" + _CLOCK, _TAKEN_APART), "\x01")
    parsed = F.when(s.rlike(_ISO), s.try_cast("timestamp")).when(s.rlike(_COMPACT), F.try_to_timestamp(s, F.lit("yyyyMMdd'T'HHmmss"))) \
        .otherwise(_let(pieces, combined))
    # one cheap test spares prose, codes and numbers the whole chain
    return F.when(s.rlike(_DATE_LIKE), parsed)


def parse_datetime(c: Column, stripped: bool = False) -> Column:
    """Timestamp of an ISO text, or of a day in one of DAY_LAYOUTS, with or without weekday, time and zone."""
    if stripped:
        return _parse_stripped_datetime(c)
    return _let(strip(c.cast("string")), _parse_stripped_datetime)


def parse_boolean(c: Column) -> Column:
    s = normalise(c.cast("string"))
    return F.when(s.isin(TRUE_TOKENS), True).when(s.isin(FALSE_TOKENS), False)
