"""Column expressions shared by several operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, functions as F

from fleetpulse.config import FEATURES, SENSOR_PAIRS, SENSORS


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def nan_to_null(col: Column) -> Column:
    """NaN compares true with >= in Spark; treat it as a missing value."""
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def clip(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def rounded(col: Column, digits: int) -> Column:
    """Half-up rounding without a negative zero."""
    return F.round(col, digits) + F.lit(0.0)


def normal_label(col: Column) -> Column:
    return F.lower(F.trim(col.cast("string")))


def sensor_of(feature: str) -> str:
    """Sensor, or joined sensors for a correlation, a feature name speaks of."""
    for a, b in SENSOR_PAIRS:
        if feature == f"{a}_{b}_corr":
            return f"{a} & {b}"
    return next((s for s in SENSORS if feature.startswith(s)), feature)


def sensor_label(feature: Column) -> Column:
    """``sensor_of`` as a lookup in a literal map of the known features."""
    pairs = ", ".join(f"'{name}', '{sensor_of(name)}'" for name in FEATURES)
    return F.coalesce(F.element_at(F.expr(f"map({pairs})"), feature), feature)


# Rational approximation of the normal distribution function
# (Hart 1968, as given by West 2005), highest power first.
PHI_NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
PHI_DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
PHI_SPLIT = 7.07106781186547
PHI_SQRT_2PI = 2.506628274631
PHI_CUTOFF = 37.0


def normal_cdf_sql(z: str) -> str:
    """SQL of the standard normal distribution function of column ``z``.

    No built-in exists. The argument is named many times, so give it a column.
    """
    a = f"abs({z})"

    def polynomial(coefficients: tuple[float, ...]) -> str:
        return reduce(lambda acc, c: f"({acc} * {a} + {c!r}D)", coefficients[1:], f"{coefficients[0]!r}D")

    bell = f"exp(-{a} * {a} / 2.0D)"
    near = f"{bell} * {polynomial(PHI_NUMERATOR)} / {polynomial(PHI_DENOMINATOR)}"
    fraction = reduce(lambda acc, k: f"({a} + {k}D / {acc})", (4.0, 3.0, 2.0, 1.0), f"({a} + 0.65D)")
    far = f"{bell} / {fraction} / {PHI_SQRT_2PI}D"
    lower = f"(CASE WHEN {a} > {PHI_CUTOFF}D THEN 0.0D WHEN {a} < {PHI_SPLIT}D THEN {near} ELSE {far} END)"
    return f"CASE WHEN {z} > 0 THEN 1.0D - {lower} ELSE {lower} END"


def normal_cdf_values(z: np.ndarray) -> np.ndarray:
    """The same function, term by term, of an array."""
    with np.errstate(all="ignore"):
        a = np.abs(z)
        bell = np.exp(-a * a / 2.0)
        near = bell * reduce(lambda acc, c: acc * a + c, PHI_NUMERATOR[1:], PHI_NUMERATOR[0])
        near = near / reduce(lambda acc, c: acc * a + c, PHI_DENOMINATOR[1:], PHI_DENOMINATOR[0])
        far = bell / reduce(lambda acc, k: a + k / acc, (4.0, 3.0, 2.0, 1.0), a + 0.65) / PHI_SQRT_2PI
        lower = np.where(a > PHI_CUTOFF, 0.0, np.where(a < PHI_SPLIT, near, far))
    return np.where(z > 0, 1.0 - lower, lower)


def normal_cdf(z: str) -> Column:
    return F.expr(normal_cdf_sql(z))
