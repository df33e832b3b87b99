"""Units, comparison operators and yes/no comparisons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of the five comparison operators.
OPERATOR_SPELLINGS = {
    "<": "<",
    "lt": "<",
    "<=": "<=",
    "lte": "<=",
    "le": "<=",
    ">": ">",
    "gt": ">",
    ">=": ">=",
    "gte": ">=",
    "ge": ">=",
    "==": "==",
    "eq": "==",
}

# The spellings each unit table reads as seconds, hours and days.
# What a table does not list is minutes, except in "strict", where it is an error.
UNIT_TABLES = {
    "lenient": {"seconds": ["seconds", "sec"], "hours": ["hours", "hrs"], "days": []},
    "extended": {
        "seconds": ["seconds", "sec", "secs"],
        "hours": ["hours", "hrs", "hr"],
        "days": ["days", "day"],
    },
    "strict": {
        "seconds": ["second", "seconds", "sec", "secs"],
        "hours": ["hour", "hours", "hr", "hrs"],
        "days": ["day", "days"],
        "minutes": ["minute", "minutes", "min", "mins"],
    },
}


def threshold_minutes(threshold: Column, unit: Column, table: str = "strict") -> Column:
    """A threshold in minutes under one of the unit tables (a missing unit means minutes)."""
    names = UNIT_TABLES[table]
    value = threshold.cast("double")
    key = F.lower(F.trim(F.coalesce(unit, F.lit("minutes")))) if table == "strict" else unit
    out = F.when(key.isin(names["seconds"]), value / 60.0).when(
        key.isin(names["hours"]), value * 60.0
    )
    if names["days"]:
        out = out.when(key.isin(names["days"]), value * 1440.0)
    if table != "strict":
        return out.otherwise(value)
    out = out.when(key.isin(names["minutes"] + [""]), value)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown unit: "), unit)).cast("double"))


def canonical_operator(operator: Column, on_error: str = "raise") -> Column:
    """The canonical symbol; a missing or unknown operator is an error (or null on request)."""
    spelling = F.create_map(*[F.lit(x) for kv in OPERATOR_SPELLINGS.items() for x in kv])
    known = F.when(spelling[operator].isNotNull(), spelling[operator])
    if on_error == "null":
        return known
    message = F.concat(F.lit("explicit operator required; got "), F.coalesce(operator, F.lit("null")))
    return known.otherwise(F.raise_error(message).cast("string"))


def holds(actual: Column, operator: Column, threshold: Column, equality: str = "exact") -> Column:
    """Whether `actual operator threshold` holds, for a canonical operator.

    ``equality`` is "exact", "minutes" (within 0.01) or "relative" (within one part in 1e9).
    """
    gap = F.abs(actual - threshold)
    same = {
        "exact": actual == threshold,
        "minutes": gap < 0.01,
        "relative": gap <= F.lit(1e-9) * F.greatest(F.abs(actual), F.abs(threshold)),
    }[equality]
    return (
        F.when(operator == "<", actual < threshold)
        .when(operator == "<=", actual <= threshold)
        .when(operator == ">", actual > threshold)
        .when(operator == ">=", actual >= threshold)
        .when(operator == "==", same)
    )


def yes_no(condition: Column) -> Column:
    """A null condition (nothing to compare) reads as "no"."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit("yes")).otherwise(F.lit("no"))
