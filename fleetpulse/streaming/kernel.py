"""Arithmetic of one asset's next readings, on small arrays inside a task.

Row-frame windows are not allowed on streams, so the stateful operator needs
the same formulas on the few rows a micro-batch brings for one asset.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np

from fleetpulse.config import FEATURES, MINUTES_PER_DAY, SENSOR_PAIRS, SENSORS, EngineConfig
from fleetpulse.functions.columns import normal_cdf_values
from fleetpulse.operators.features import FLAT_SPREAD, LARGEST
from fleetpulse.operators.forecast import MIN_RESIDUAL, NO_RISK, TINY_RESIDUAL

TREND_BATCH = 64


def rolling_features(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of every full window of ``values`` (rows x sensors).

    Returns (windows x 30 features, usable mask).
    """
    by_sensor = np.ascontiguousarray(values.T)
    back = [by_sensor[:, n - 1 - k : len(values) - k] for k in range(n)]  # sensors x windows, the newest reading first
    with np.errstate(all="ignore"):
        mean, high, low = sum(back) / n, reduce(np.maximum, back), reduce(np.minimum, back)
        spread = high - low
        usable = ((spread > np.abs(mean) * FLAT_SPREAD) & (spread <= LARGEST)).all(axis=0)
        d = [x - mean for x in back]
        squares = [x * x for x in d]
        m2, m3 = sum(squares) / n, sum(q * x for q, x in zip(squares, d)) / n
        m4 = sum(q * x * x for q, x in zip(squares, d)) / n
        rms = np.sqrt(sum(x * x for x in back) / n)
        per_sensor = {
            "mean": mean,
            "std": np.sqrt(m2 * n / (n - 1)),
            "max": high,
            "min": low,
            "rms": rms,
            "kurtosis": (m4 / m2**2 * (n + 1) - 3 * (n - 1)) * (n - 1) / ((n - 2) * (n - 3)),
            "skew": m3 / (m2 * np.sqrt(m2)) * math.sqrt(n * (n - 1)) / (n - 2),
            "crest_factor": high / rms,
            "trend_slope": sum(x * ((n - 1) / 2.0 - k) for k, x in enumerate(d)) / (n * (n * n - 1) / 12.0),
        }
        columns = {f"{s}_{stat}": v[i] for stat, v in per_sensor.items() for i, s in enumerate(SENSORS)}
        for a, b in SENSOR_PAIRS:
            i, j = SENSORS.index(a), SENSORS.index(b)
            columns[f"{a}_{b}_corr"] = sum(x[i] * x[j] for x in d) / n / np.sqrt(m2[i] * m2[j])
    return np.column_stack([columns[f] for f in FEATURES]), usable


def level_updates(level: float, variance: float, health: Sequence[float], cfg: EngineConfig) -> tuple[list[float], float]:
    """Filtered levels for consecutive measurements, and the final variance."""
    out = []
    for measured in health:
        predicted = variance + cfg.process_var
        gain = predicted / (predicted + cfg.measurement_var)
        level += gain * (measured - level)
        variance = (1.0 - gain) * predicted
        out.append(level)
    return out, variance


def trend_fits(x: np.ndarray, y: np.ndarray, new: int, cfg: EngineConfig) -> np.ndarray:
    """Fit the last ``lookback`` points ending at each of the ``new`` last ones.

    Columns: n, slope, residual, sxx; slope is NaN below ``min_points``.
    """
    size, total = cfg.lookback, len(x)
    pad = size - 1
    px, py = np.concatenate([np.zeros(pad), x]), np.concatenate([np.zeros(pad), y])
    weight = np.concatenate([np.zeros(pad), np.ones(total)])
    view = np.lib.stride_tricks.sliding_window_view
    wx, wy, ww = (view(a, size)[total - new :] for a in (px, py, weight))
    out = np.empty((new, 4))
    for a in range(0, new, TREND_BATCH):
        b = slice(a, min(a + TREND_BATCH, new))
        if total - new + a >= pad:  # whole windows only
            n = np.full(b.stop - a, float(size))
            dx, dy = (v - v.mean(axis=1, keepdims=True) for v in (wx[b], wy[b]))
        else:
            w = ww[b]
            n = w.sum(axis=1)
            dx, dy = ((v - ((v * w).sum(axis=1) / n)[:, None]) * w for v in (wx[b], wy[b]))
        sxx, sxy, syy = (np.einsum("ij,ij->i", p, q) for p, q in ((dx, dx), (dx, dy), (dy, dy)))
        with np.errstate(all="ignore"):
            slope = np.where((n >= cfg.min_points) & (sxx > 0), sxy / sxx, np.nan)
            residual = np.sqrt(np.maximum(syy - slope * sxy, 0.0) / n)
        residual = np.where(residual < TINY_RESIDUAL, MIN_RESIDUAL, residual)
        out[b] = np.column_stack([n, slope, residual, sxx])
    return out


def decimals(values: np.ndarray, digits: int) -> np.ndarray:
    """Half up on the shortest text of a double, as the column function rounds."""
    out = np.round(values, digits)
    scaled = np.abs(values) * 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):  # near ties only
        step = Decimal(1).scaleb(-digits)
        out[i] = float(Decimal(repr(float(values[i]))).quantize(step, ROUND_HALF_UP))
    return out


def raw_levels(outputs: np.ndarray, level: np.ndarray, fits: np.ndarray, cfg: EngineConfig) -> tuple[np.ndarray, np.ndarray]:
    """Severity 0..2 of each output and whether health itself triggered it."""
    n, slope, residual, sxx = fits.T
    horizon = min(cfg.horizons, key=lambda h: abs(h - cfg.policy_horizon)) * MINUTES_PER_DAY
    with np.errstate(all="ignore"):
        z = (cfg.health_failed - (level + slope * horizon)) / (residual * math.sqrt(max(horizon, 1.0)))
        error = residual * np.sqrt(n / np.maximum(n - 2, 1)) / np.sqrt(sxx)
        significant = np.abs(slope / error) >= cfg.slope_z
    z = np.where(np.isnan(slope), NO_RISK, z)
    p = decimals(normal_cdf_values(z), 4)
    settled = outputs - (cfg.min_points - 1) >= cfg.settle_fits
    trusted = np.isnan(slope) | (settled & significant)
    failed, inspect = level <= cfg.health_failed, level <= cfg.health_inspect
    urgent, plan = trusted & (p >= cfg.prob_urgent), trusted & (p >= cfg.prob_plan)
    severity = np.select([failed, urgent, plan, inspect], [2, 2, 1, 1], 0)
    return severity, failed | (inspect & ~urgent & ~plan)


def hold(state: tuple[int, int, int], severity: Sequence[int], by_health: Sequence[bool], cfg: EngineConfig):
    """Hysteresis over consecutive outputs.

    ``state`` is (candidate, streak, held). Returns per-output (streak, held)
    and the next state.
    """
    candidate, streak, held = state
    rows = []
    for level, instant in zip(severity, by_health):
        streak = streak + 1 if level == candidate and not instant else 1
        candidate = level
        if not instant and streak >= (cfg.confirm_ticks if level > held else cfg.clear_ticks):
            held = level
        rows.append((streak, held))
    return rows, (int(candidate), int(streak), int(held))
