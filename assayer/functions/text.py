"""String expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: all characters that count as blank at the edges of a text
_BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
           "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_SHORT = 64


def strip(c: Column) -> Column:
    """Without blanks at either end; only the edges are looked at, whatever the length."""
    return F.btrim(c, F.lit(_BLANKS))


def normalise(c: Column) -> Column:
    """Trimmed and lower-cased form used to spot spelling variants."""
    return F.lower(strip(c))


def is_short(c: Column) -> Column:
    return F.char_length(c) <= _SHORT


def token(c: Column) -> Column:
    """The value itself when short, otherwise a 128-bit fingerprint, so long texts never enter a shuffle."""
    return F.when(~is_short(c), F.concat(
        F.lit("\x00"),
        F.lpad(F.hex(F.xxhash64(c)), 16, "0"),
        F.lpad(F.hex(F.xxhash64(F.lit(7), c)), 16, "0"))).otherwise(c)


def slug(c: Column, fallback: str = "import", width: int = 60) -> Column:
    """Lower-case name with runs of other characters as one dash."""
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, width)
    return F.when(F.length(cut) > 0, cut).otherwise(F.lit(fallback))


def general3(c: Column) -> Column:
    """Three significant digits, shortest form: 5, 0.25, 123, 1.23e+05."""
    x = c.cast("double")
    mag = F.floor(F.log10(F.abs(x)))
    # rounding can carry into the next power of ten (999.6 -> 1000)
    rounded_up = F.bround(F.abs(x) / F.pow(F.lit(10.0), mag), 2) >= 10
    exp = F.when(rounded_up, mag + 1).otherwise(mag).cast("int")
    mantissa = F.bround(x / F.pow(F.lit(10.0), exp), 2)

    def tidy(s: Column) -> Column:
        return F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)

    fixed = tidy(F.when(exp >= 2, F.format_string("%.0f", F.bround(x, 0)))
                 .when(exp == 1, F.format_string("%.1f", F.bround(x, 1)))
                 .when(exp == 0, F.format_string("%.2f", F.bround(x, 2)))
                 .when(exp == -1, F.format_string("%.3f", F.bround(x, 3)))
                 .when(exp == -2, F.format_string("%.4f", F.bround(x, 4)))
                 .when(exp == -3, F.format_string("%.5f", F.bround(x, 5)))
                 .otherwise(F.format_string("%.6f", F.bround(x, 6))))
    scientific = F.concat(
        tidy(F.format_string("%.2f", mantissa)), F.lit("e"),
        F.when(exp < 0, "-").otherwise("+"), F.lpad(F.abs(exp).cast("string"), 2, "0"))
    return (F.when(x.isNull(), F.lit("nan"))
            .when(x == 0, F.lit("0"))
            .when((exp >= 3) | (exp < -4), scientific)
            .otherwise(fixed))


def thousands(c: Column) -> Column:
    return F.format_number(c.cast("bigint"), 0)


def signed(c: Column, decimals: int = 0) -> Column:
    return F.format_string(f"%+.{decimals}f", F.bround(c.cast("double"), decimals))
