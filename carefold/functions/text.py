"""Small text and number expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the number form of measured values.
NUMBER = r"[-+]?\d+(?:\.\d+)?"


def empty_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def first_number(value: Column) -> Column:
    """The first number inside a text as a double, else null."""
    return F.regexp_extract(value, NUMBER, 0).try_cast("double")


def strict_number(value: Column) -> Column:
    """The whole text as a double, else null (a type suffix is not a number)."""
    return F.when(~value.rlike(r"[dDfF]\s*$"), value.try_cast("double"))


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed days as a double, to the microsecond."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def title_words(value: Column) -> Column:
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def exact_round(value: Column, digits: int) -> Column:
    """Rounds the binary value of a double correctly, true ties to even.

    ``round`` and ``bround`` look at the shortest decimal text instead, which
    differs where that text ends in a 5. The product with the power of ten is
    split into its rounded value and the exact rest; at a half the sign of the
    rest decides.
    """
    return _round_at(value, F.lit(float(10**digits)))


def _round_at(value: Column, scale: Column) -> Column:
    product = value * scale
    spread = value * 134217729.0
    high = spread - (spread - value)
    rest = (high * scale - product) + (value - high) * scale
    half = product - F.floor(product) == 0.5
    whole = (
        F.when(half & (rest > 0), F.ceil(product).cast("double"))
        .when(half & (rest < 0), F.floor(product).cast("double"))
        .otherwise(F.rint(product))
    )
    return F.when(F.abs(product) < 4503599627370496.0, whole / scale).otherwise(value)


def fixed_point(value: Column, digits: int) -> Column:
    """A double as text with ``digits`` decimals."""
    return F.format_string(f"%.{digits}f", exact_round(value, digits))


def literal_map(pairs: dict[str, str]) -> Column:
    """A small constant map; meant for tables of a few dozen entries."""
    flat: list[Column] = []
    for key, value in pairs.items():
        flat += [F.lit(key), F.lit(value)]
    return F.create_map(*flat)


def significant(value: Column, digits: int = 4) -> Column:
    """A double in the general format with ``digits`` significant digits.

    Fixed notation between 1e-4 and 10**digits with trailing zeros removed,
    scientific notation with a two-digit exponent outside it.
    """
    # The rounded mantissa decides the exponent: 9999.96 becomes 1e+04.
    scientific = F.format_string(f"%.{digits - 1}e", value)
    mantissa = F.split(scientific, "e")[0]
    exponent = F.split(scientific, "e")[1].cast("int")
    trim = lambda c: F.when(
        F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.?0+$", "")
    ).otherwise(c)
    # At most digits + 3 decimals are left, and the trim drops the zeros behind them.
    rounded = _round_at(value, F.pow(F.lit(10.0), (F.lit(digits - 1) - exponent).cast("double")))
    fixed = F.format_string(f"%.{digits + 3}f", rounded)
    return (
        F.when(value == 0, F.lit("0"))
        .when(
            (exponent < -4) | (exponent >= digits),
            F.concat(trim(mantissa), F.lit("e"), F.format_string("%+03d", exponent)),
        )
        .otherwise(trim(fixed))
    )


def filled(sentence: str, *columns: Column | str) -> Column:
    """``sentence`` with the columns in place of its ``{}``, in order; null if one of them is null."""
    parts = sentence.split("{}")
    pieces = [F.lit(parts[0])]
    for column, part in zip(columns, parts[1:], strict=True):
        pieces += [F.col(column) if isinstance(column, str) else column, F.lit(part)]
    return F.concat(*pieces)
