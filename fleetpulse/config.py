"""Settings of the engine.

All thresholds are operational policy and can be overridden per call with
``dataclasses.replace(DEFAULT, ...)``.  The last group of fields only decides
how the work is spread over tasks; it never changes a result.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass

SENSORS = ("vibration", "current", "temperature")
SENSOR_PAIRS = (
    ("vibration", "current"),
    ("vibration", "temperature"),
    ("current", "temperature"),
)
SENSOR_STATS = (
    "mean",
    "std",
    "max",
    "min",
    "rms",
    "kurtosis",
    "skew",
    "crest_factor",
    "trend_slope",
)
FEATURES = tuple(f"{s}_{stat}" for s in SENSORS for stat in SENSOR_STATS) + tuple(
    f"{a}_{b}_corr" for a, b in SENSOR_PAIRS
)

LABELS = ("normal", "warning", "critical")
MINUTES_PER_DAY = 1440.0

# Bump whenever the definition of any feature changes: stored models carry it.
FEATURE_VERSION = 1


@dataclass(frozen=True)
class EngineConfig:
    # Defaults of the monitoring policy, down to min_calibration_rows.
    # rolling features
    window_rows: int = 10
    # rated range of a healthy reading (inclusive)
    vibration_limit: float = 3.0
    current_limit: float = 6.0
    temperature_limit: float = 50.0
    # commissioning fallback: the first N readings of an asset
    commissioning_rows: int = 2880
    # isolation forest
    n_trees: int = 200
    tree_sample: int = 256
    seed: int = 42
    # score -> health
    health_spread: float = 4.0
    # level filter
    process_var: float = 0.01
    measurement_var: float = 9.0
    seed_readings: int = 15
    # trend
    lookback: int = 720
    min_points: int = 60
    settle_fits: int = 60
    slope_z: float = 2.0
    max_days: int = 90
    # failure probability
    horizons: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)
    # maintenance policy
    policy_horizon: float = 1.0
    prob_urgent: float = 0.80
    prob_plan: float = 0.60
    health_inspect: float = 30.0
    health_failed: float = 20.0
    confirm_ticks: int = 5
    clear_ticks: int = 15
    top_k: int = 3
    # calibration of one asset
    min_calibration_rows: int = 200
    # spread of the work (results do not depend on these)
    hot_rows: int = 1_000_000  # an asset above this is cut into blocks
    block_rows: int = 262_144  # rows per block of such an asset
    max_listed_hot: int = 10_000  # hot assets kept as a broadcast list

    def __post_init__(self) -> None:
        if not 2 <= self.confirm_ticks <= self.clear_ticks:
            raise ValueError("need 2 <= confirm_ticks <= clear_ticks")
        if self.process_var <= 0 or self.measurement_var <= 0:
            raise ValueError("process_var and measurement_var must be above 0")
        if self.window_rows < 4:
            raise ValueError("kurtosis needs window_rows >= 4")

    # -- derived ---------------------------------------------------------
    @property
    def steady_gain(self) -> float:
        """Limit of the filter gain: positive root of the variance recursion."""
        q, r = self.process_var, self.measurement_var
        predicted = (q + math.sqrt(q * q + 4.0 * q * r)) / 2.0
        return predicted / (predicted + r)

    @property
    def filter_span(self) -> int:
        """Emissions after which an old level keeps < 1e-7 of its weight."""
        return 64 * math.ceil(16.2 / -math.log1p(-self.steady_gain) / 64)

    @property
    def history_rows(self) -> int:
        """Emissions before a block that decide everything inside it."""
        return 3 * self.filter_span + self.lookback + self.clear_ticks + self.seed_readings

    @property
    def sensor_limits(self) -> dict[str, float]:
        return {
            "vibration": self.vibration_limit,
            "current": self.current_limit,
            "temperature": self.temperature_limit,
        }

    def horizon_name(self, days: float) -> str:
        return f"{days:g}d"

    def feature_hash(self) -> str:
        """Identifies the feature definition a table or model was built with."""
        payload = {
            "version": FEATURE_VERSION,
            "window_rows": self.window_rows,
            "features": list(FEATURES),
        }
        return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()

    def as_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


DEFAULT = EngineConfig()
