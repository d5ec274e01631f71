"""Unit spelling and comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carefold.functions.text import literal_map

# ---------------------------------------------------------------------------
# Spellings (lower case, no blanks) of each canonical unit, and
# the pairs that measure one quantity in different systems.
# ---------------------------------------------------------------------------
UNIT_ALIASES = {
    "mg/dl": "mg/dL", "mg/100ml": "mg/dL", "mg%": "mg/dL",
    "g/dl": "g/dL", "g/100ml": "g/dL",
    "ng/ml": "ng/mL", "ng/dl": "ng/dL",
    "pg/ml": "pg/mL",
    "ug/dl": "ug/dL", "µg/dl": "ug/dL", "mcg/dl": "ug/dL",
    "mmol/l": "mmol/L", "mmol/lt": "mmol/L",
    "umol/l": "umol/L", "µmol/l": "umol/L",
    "meq/l": "mEq/L", "meq/lt": "mEq/L",
    "miu/l": "mIU/L", "miu/ml": "mIU/mL",
    "iu/l": "IU/L", "iu/ml": "IU/mL", "u/l": "U/L", "u/ml": "U/mL",
    "10^3/ul": "10^3/uL", "10e3/ul": "10^3/uL", "k/ul": "10^3/uL",
    "10^3/l": "10^3/L", "th/ul": "10^3/uL", "thou/ul": "10^3/uL",
    "10^6/ul": "10^6/uL", "m/ul": "10^6/uL",
    "cells/ul": "cells/uL", "/ul": "/uL", "µl": "uL",
    "%": "%", "percent": "%", "ratio": "ratio",
    "ml/min/1.73m2": "mL/min/1.73m2",
    "ml/min/1.73m^2": "mL/min/1.73m2",
    "mmhg": "mmHg", "bpm": "bpm", "kg/m2": "kg/m2", "kg/m^2": "kg/m2",
    "c": "°C", "°c": "°C", "degc": "°C",
    "kg": "kg", "cm": "cm",
}
CROSS_SYSTEM_PAIRS = (
    ("mg/dL", "mmol/L"),
    ("g/dL", "mmol/L"),
    ("ug/dL", "nmol/L"),
    ("ng/mL", "pmol/L"),
    ("IU/L", "ukat/L"),
)


def normal_unit(raw: Column) -> Column:
    """Canonical spelling; an unknown unit keeps its text with blanks collapsed."""
    cleaned = F.regexp_replace(F.btrim(raw, F.lit(" \t\n\r\x0b\x0c")), r"(?U)\s+", " ")
    key = F.replace(F.lower(cleaned), F.lit(" "), F.lit(""))
    return F.when(
        F.length(cleaned) > 0, F.coalesce(F.element_at(literal_map(UNIT_ALIASES), key), cleaned)
    )


def units_comparable(a: Column, b: Column) -> Column:
    """Of two normal units: the same unit, or nothing to compare."""
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(True))


def is_cross_system(a: Column, b: Column) -> Column:
    """Of two normal units: one quantity in two systems."""
    pair = F.concat_ws("|", F.array_sort(F.array(a, b)))
    known = ["|".join(sorted(p)) for p in CROSS_SYSTEM_PAIRS]
    return F.coalesce(a.isNotNull() & b.isNotNull() & pair.isin(known), F.lit(False))
