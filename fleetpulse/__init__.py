"""Fleet health analytics on Spark: see README.md."""

from fleetpulse.config import DEFAULT, EngineConfig
from fleetpulse.plans.evaluation import evaluate, replay
from fleetpulse.plans.monitoring import flatten_predictions, monitor_batch, monitor_features, score
from fleetpulse.plans.recalibration import recalibrate
from fleetpulse.plans.training import train
from fleetpulse.session import ship, tune
from fleetpulse.streaming.monitor import finish, monitor_stream, start

__all__ = [
    "DEFAULT",
    "EngineConfig",
    "diagnose",
    "evaluate",
    "finish",
    "flatten_predictions",
    "monitor",
    "monitor_batch",
    "monitor_features",
    "monitor_stream",
    "recalibrate",
    "replay",
    "score",
    "ship",
    "start",
    "train",
    "tune",
]


def monitor(readings, model, cfg=DEFAULT, **options):
    """Predictions of a batch, or the stateful rows of a stream of readings."""
    run = monitor_stream if readings.isStreaming else monitor_batch
    return run(readings, model, cfg, **options)


def diagnose(model, features, cfg=DEFAULT):
    """Permutation importances and redundant feature pairs of a model."""
    from fleetpulse.operators import diagnostics

    rows = diagnostics.reference_features(features, model.reference)
    importances = diagnostics.permutation_importance(rows, model.nodes, model.n_reference_rows, cfg=cfg)
    return importances, diagnostics.redundant_pairs(rows)
