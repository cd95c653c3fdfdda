"""Unit conversion by factors to a base unit per quantity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Factors to metres, seconds, degrees, metres per second, per second, watts and cubic metres.
FEET = 1 / 3.2808398950131
PER = {"second": 1.0, "minute": 1 / 60, "hour": 1 / 3600}
LENGTHS = {
    "meter": 1.0, "kilometer": 1000.0, "decimeter": 0.1, "centimeter": 0.01, "millimeter": 0.001, "micron": 1e-6,
    "foot": FEET, "inch": FEET / 12, "yard": FEET * 3, "mile": FEET * 5280,
}
FACTORS = {
    "length": LENGTHS,
    "time": {"second": 1.0, "minute": 60.0, "hour": 3600.0},
    "angle": {"degree": 1.0, "radian": 57.29577951308232, "gradian": 0.9, "turn": 360.0},
    "speed": {f"{size}_per_{time}": LENGTHS[size] * f for size in ("meter", "centimeter", "foot", "inch") for time, f in PER.items()}
    | {"kilometer_per_hour": 1 / 3.6, "mile_per_hour": FEET * 5280 / 3600},
    "cost_rate": {f"per_{time}": f for time, f in PER.items()},
    "energy_rate": {f"joule_per_{time}": f for time, f in PER.items()},
    "volume": {
        "cubic_meter": 1.0, "cubic_decimeter": 1e-3, "cubic_centimeter": 1e-6, "cubic_inch": 0.0254**3, "cubic_foot": 0.3048**3, "cubic_yard": 0.9144**3,
    },
}
#: Units of a day, whose hours are a parameter.
DAYS = {"time": ("day", 3600.0, 1), "cost_rate": ("per_day", 1 / 3600, -1), "energy_rate": ("joule_per_day", 1 / 3600, -1)}


def factor(quantity: str, unit: str, hours_per_day: float = 24.0) -> float:
    name, one, power = DAYS.get(quantity, ("", 1.0, 1))
    return one * hours_per_day**power if unit == name else FACTORS[quantity][unit]


def convert(value: Column, quantity: str, source: str, target: str, hours_per_day: float = 24.0) -> Column:
    return value * F.lit(factor(quantity, source, hours_per_day)) / F.lit(factor(quantity, target, hours_per_day))


def factor_table(spark: SparkSession) -> DataFrame:
    """(quantity, unit, factor): a few dozen rows, for units that are data."""
    rows = [(q, u, f) for q, units in FACTORS.items() for u, f in units.items()] + [(q, u, factor(q, u)) for q, (u, _, _) in DAYS.items()]
    return spark.createDataFrame(rows, "quantity string, unit string, factor double")


def convert_rows(rows: DataFrame, quantity: str) -> DataFrame:
    """rows (value, source, target) plus ``converted``; null for an unknown unit."""
    table = factor_table(rows.sparkSession).where(F.col("quantity") == quantity).drop("quantity")
    side = lambda c: F.broadcast(table.select(F.col("unit").alias(c), F.col("factor").alias(f"_{c}")))
    both = rows.join(side("source"), "source", "left").join(side("target"), "target", "left")
    return both.withColumn("converted", F.col("value") * F.col("_source") / F.col("_target")).drop("_source", "_target")


def terms(expression: Column) -> Column:
    """The operands of an expression of ``+``, ``-`` and ``*``, trimmed, empty ones left out."""
    parts = F.transform(F.split(F.coalesce(expression, F.lit("")), r"[+\-*]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")
