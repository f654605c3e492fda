"""Which features, and through them which sensors, moved the most."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.config import DEFAULT, FEATURES, EngineConfig
from fleetpulse.functions.columns import sensor_of


def z_score(feature: str) -> str:
    """SQL of one feature's z against feat_mean / feat_std; missing is 0."""
    return f"coalesce(try_divide({feature} - feat_mean['{feature}'], feat_std['{feature}']), 0.0D)"


def z_scores(features: Sequence[str] = FEATURES) -> Column:
    """Array of z in feature order."""
    return F.expr(f"array({', '.join(z_score(f) for f in features)})")


def top_contributors(features: Sequence[str] = FEATURES, cfg: EngineConfig = DEFAULT) -> Column:
    """The ``top_k`` features by |z|; equal values keep feature order."""
    entries = [
        f"named_struct('rank', -abs({z_score(f)}), 'position', {i}, "
        f"'feature', '{f}', 'z', {z_score(f)}, 'sensor', '{sensor_of(f)}')"
        for i, f in enumerate(features)
    ]
    best = f"slice(array_sort(array({', '.join(entries)})), 1, {cfg.top_k})"
    return F.expr(f"transform({best}, e -> named_struct('feature', e.feature, 'z', e.z, 'sensor', e.sensor))")


def with_places(df: DataFrame, name: str, features: Sequence[str] = FEATURES, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Add ``top_contributors`` as positions among the features and their z, which are short enough to travel.

    Two projections without functions of elements: those are interpreted, with
    all that they are given, while these are compiled. The second one names the
    sorted array several times, so the two stay apart.
    """
    entries = [f"named_struct('rank', -abs({z_score(f)}), 'position', {i}, 'z', {z_score(f)})" for i, f in enumerate(features)]
    ranked = df.withColumn("_ranked", F.expr(f"sort_array(array({', '.join(entries)}))"))
    best = [f"named_struct('position', _ranked[{i}].position, 'z', _ranked[{i}].z)" for i in range(min(cfg.top_k, len(features)))]
    return ranked.select(*df.columns, F.expr(f"array({', '.join(best)})").alias(name))


def named_places(places: Column, features: Sequence[str] = FEATURES) -> Column:
    """What ``with_places`` added, with the names of features and sensors."""
    names, sensors = F.array(*map(F.lit, features)), F.array(*[F.lit(sensor_of(f)) for f in features])
    return F.transform(
        places,
        lambda e: F.struct(F.get(names, e["position"]).alias("feature"), e["z"].alias("z"), F.get(sensors, e["position"]).alias("sensor")),
    )


def contributors_when_alerting(features: Sequence[str] = FEATURES, cfg: EngineConfig = DEFAULT) -> Column:
    return F.when(F.col("maintenance_level") != "OK", top_contributors(features, cfg))


def _each(contributors: Column) -> Column:
    return F.transform(contributors, lambda e: F.format_string("%s (z=%+.1f)", e["feature"], e["z"]))


def joined_contributors(contributors: Column) -> Column:
    """Log form: entries joined by '; ', empty when there are none."""
    return F.coalesce(F.concat_ws("; ", _each(contributors)), F.lit(""))


def summarize(contributors: Column) -> Column:
    text = F.concat(F.lit("driven mainly by "), F.concat_ws(", ", _each(contributors)))
    return F.when(F.coalesce(F.size(contributors), F.lit(0)) > 0, text).otherwise(F.lit(""))
