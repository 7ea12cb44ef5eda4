"""Number helpers: fall-backs and the metric structure."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.text import col

COMPUTED = "computed"
MISSING = "missing_data"
ZERO_DIVISION = "division_by_zero"
ANOMALY = "anomaly"


def not_nan(c) -> Column:
    return F.when(~F.isnan(col(c).cast("double")), col(c))


def safe_or(*choices) -> Column:
    """First choice that is neither null nor NaN nor zero; the last one is taken as it is."""
    cleaned = [not_nan(c) for c in choices]
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cleaned[:-1]], cleaned[-1])


def ratio(num: Column, den: Column, mult: float = 1.0):
    """(value, status) of a guarded division; null is tested before zero."""
    missing = num.isNull() | den.isNull()
    value = F.when(~missing & (den != 0), num / den * F.lit(float(mult)))
    status = (F.when(missing, MISSING).when(den == 0, ZERO_DIVISION).otherwise(COMPUTED))
    return value, status


def metric_struct(value: Column, status: Column, unit: str, formula: str,
                  inputs: dict[str, Column] | None = None) -> Column:
    fields = [F.round(value, 4).alias("value"), F.lit(unit).alias("unit"),
              F.lit(formula).alias("formula"), status.alias("status")]
    if inputs is not None:
        pairs = [part for name, c in inputs.items() for part in (F.lit(name), c.cast("double"))]
        made = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
        fields.append(made.alias("inputs"))
    return F.struct(*fields)


def plain_number(c) -> Column:
    """A double as plain decimal text: 25.0, 31.25, 0.0005, 1500000000000.0."""
    d = col(c).cast("double")
    fixed = F.regexp_replace(F.format_string("%.6f", d), r"(\.\d+?)0+$", "$1")
    size = F.abs(d)
    return F.when((size < 1e16) & ((size >= 1e7) | ((size < 1e-3) & (size > 0))), fixed).otherwise(d.cast("string"))
