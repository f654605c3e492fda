"""Rolling-window features: thirty statistics of the last ten readings.

Each row gets its nine predecessors by ``lag``; everything after that is plain
arithmetic on one row, centred on the window mean before powers are taken.
Windows that are incomplete, hold a missing value, or are flat in a sensor have
no defined feature row and are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetpulse.config import DEFAULT, FEATURES, SENSOR_PAIRS, SENSORS, EngineConfig
from fleetpulse.functions.columns import all_of

# A window whose values differ by no more than a few roundings is constant.
FLAT_SPREAD = 4 * 2.220446049250313e-16
LARGEST = 1.7976931348623157e308


def with_history(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Complete windows only: sensor ``s`` gets columns s_0 (now) .. s_{n-1}."""
    w = W.partitionBy(*keys).orderBy(*order)
    lags = [F.lag(s, k).over(w).alias(f"{s}_{k}") for s in SENSORS for k in range(1, n)]
    wide = df.select("*", *[F.col(s).alias(f"{s}_0") for s in SENSORS], *lags)
    return wide.filter(all_of(F.col(f"{s}_{k}").isNotNull() for s in SENSORS for k in range(n)))


def create_features(
    df: DataFrame,
    keys: Sequence[str] = ("asset_id",),
    order: Sequence[Column | str] = ("ts",),
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Append the feature columns to every row with a complete window.

    ``df`` needs the three sensor columns with missing values as NULL.  Plan:
    one exchange by ``keys`` (none when already partitioned), one sort, one
    window, then projections.
    """
    n = cfg.window_rows
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    base = df.columns
    wide = with_history(df, keys, order, n)
    steps = range(n)

    # location and size, straight from the readings
    plain = []
    for s in SENSORS:
        x = [f"{s}_{k}" for k in steps]
        plain.append(f"({_plus(x)}) / {float(n)}D AS {s}_mean")
        plain.append(f"greatest({', '.join(x)}) AS {s}_max")
        plain.append(f"least({', '.join(x)}) AS {s}_min")
        plain.append(f"sqrt(({_plus(f'{v} * {v}' for v in x)}) / {float(n)}D) AS {s}_rms")
    wide = wide.selectExpr("*", *plain).filter(" AND ".join(_varies(s) for s in SENSORS))
    done = [f"{s}_{stat}" for s in SENSORS for stat in ("mean", "max", "min", "rms")]

    # centred moments; one sensor per projection keeps generated methods small
    waiting = [f"{s}_{k}" for s in SENSORS for k in steps]
    centred: list[str] = []
    for s in SENSORS:
        waiting = [c for c in waiting if not c.startswith(f"{s}_")]
        d = [f"{s}_d{k}" for k in steps]
        wide = wide.selectExpr(
            *base, *done, *waiting, *centred, *[f"{s}_{k} - {s}_mean AS {s}_d{k}" for k in steps]
        ).selectExpr(
            "*",
            f"({_plus(f'{v} * {v}' for v in d)}) / {float(n)}D AS {s}_m2",
            f"({_plus(f'{v} * {v} * {v}' for v in d)}) / {float(n)}D AS {s}_m3",
            f"({_plus(f'{v} * {v} * {v} * {v}' for v in d)}) / {float(n)}D AS {s}_m4",
            f"{_plus(f'{v} * {(n - 1) / 2.0 - k}D' for k, v in enumerate(d))} AS {s}_drift",
        )
        done += [f"{s}_{m}" for m in ("m2", "m3", "m4", "drift")]
        centred += d
    cross = [
        f"({_plus(f'{a}_d{k} * {b}_d{k}' for k in steps)}) / {float(n)}D AS {a}_{b}_co" for a, b in SENSOR_PAIRS
    ]
    wide = wide.selectExpr(*base, *done, *cross)
    return wide.selectExpr(*base, *[f"{_feature(name, n)} AS {name}" for name in FEATURES])


def _plus(terms: Iterable[str]) -> str:
    return " + ".join(terms)


def _varies(sensor: str) -> str:
    """Spread is finite and above rounding noise; else no shape is defined."""
    spread = f"({sensor}_max - {sensor}_min)"
    return f"{spread} > abs({sensor}_mean) * {FLAT_SPREAD!r}D AND {spread} <= {LARGEST!r}D"


def _feature(name: str, n: int) -> str:
    """One feature from the moments; bias-corrected skew and excess kurtosis."""
    if name.endswith("_corr"):
        a, b = name.split("_")[:2]
        return f"{a}_{b}_co / sqrt({a}_m2 * {b}_m2)"
    sensor, stat = name.split("_", 1)
    m2, m3, m4 = (f"{sensor}_{m}" for m in ("m2", "m3", "m4"))
    if stat == "std":
        return f"sqrt({m2} * {n / (n - 1)!r}D)"
    if stat == "skew":
        return f"{m3} / ({m2} * sqrt({m2})) * {sqrt(n * (n - 1)) / (n - 2)!r}D"
    if stat == "kurtosis":
        scale = (n - 1) / ((n - 2) * (n - 3))
        return f"({m4} / ({m2} * {m2}) * {n + 1.0}D - {3.0 * (n - 1)}D) * {scale!r}D"
    if stat == "crest_factor":
        return f"{sensor}_max / {sensor}_rms"
    if stat == "trend_slope":
        return f"{sensor}_drift / {n * (n * n - 1) / 12.0!r}D"
    return name


def feature_columns(df: DataFrame, identity: Sequence[str] = ("asset_id", "ts")) -> list[str]:
    """Feature names of a feature table: every column but its identity.

    Known features come in registry order; a model pins that order.
    """
    others = [c for c in df.columns if c not in identity]
    known = [c for c in FEATURES if c in others]
    return known + [c for c in others if c not in FEATURES and c not in ("tick", *SENSORS)]


def drop_counts(n_input: DataFrame, n_output: DataFrame) -> DataFrame:
    """Rows per asset before and after the incomplete-window filter."""
    before = n_input.groupBy("asset_id").agg(F.count("*").alias("n_readings"))
    after = n_output.groupBy("asset_id").agg(F.count("*").alias("n_features"))
    joined = before.join(after, "asset_id", "left").fillna(0, ["n_features"])
    return joined.withColumn("n_dropped", F.col("n_readings") - F.col("n_features"))
