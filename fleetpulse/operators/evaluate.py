"""Evaluation of predictions against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetpulse.config import DEFAULT, EngineConfig
from fleetpulse.functions.columns import clip, normal_label
from fleetpulse.operators import layout
from fleetpulse.operators.layout import ASSET
from fleetpulse.operators.policy import policy_column

ECE_BINS = 10
RANK_BUCKETS = 1024
RANK_REACH = 4.0


# -- alignment and targets ------------------------------------------------


def _next_within(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    later = W.partitionBy(*keys).orderBy(F.desc("ts")).rangeBetween(W.unboundedPreceding, 0)
    critical = F.when(F.col("health_status") == "critical", F.col("ts"))
    return df.withColumn("next_critical", F.min(critical).over(later))


def next_critical_time(labels: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Add the first critical time at or after each row of its asset.

    A running minimum from the end, no as-of join. Assets too large for one
    task run per time slice; one row per slice carries the minimum across.
    """
    labels = labels.withColumn("health_status", normal_label(F.col("health_status")))
    split = layout.split_by_heat(labels, cfg)
    cold = _next_within(split.cold, [ASSET])
    if split.hot is None:
        return cold
    sliced = layout.sliced(split.hot, [F.col("ts")], split.hot_slices, "labels")
    firsts = sliced.groupBy(ASSET, "slice").agg(
        F.min(F.when(F.col("health_status") == "critical", F.col("ts"))).alias("first")
    )
    backwards = W.partitionBy(ASSET).orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    carry = firsts.select(ASSET, "slice", F.min("first").over(backwards).alias("from_later"))
    hot = _next_within(sliced, [ASSET, "slice"]).join(carry, [ASSET, "slice"])
    hot = hot.withColumn("next_critical", F.coalesce("next_critical", "from_later"))
    return cold.unionByName(hot.select(*cold.columns))


def fails_within(days: float) -> Column:
    """A critical time lies in [ts, ts + days], both ends included."""
    horizon = F.expr(f"INTERVAL {round(days * 1440)} MINUTES")
    return F.coalesce((F.col("next_critical") >= F.col("ts")) & (F.col("next_critical") <= F.col("ts") + horizon), F.lit(False))


def align_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join on (asset, time); a key repeated on either side, or unmatched, fails the job.

    Labels are counted by key before the join, so that a repeated label fails
    even where no prediction asks for it.
    """
    twice = F.raise_error(F.concat(F.lit("not one to one: label repeated at "), F.concat_ws(" ", ASSET, F.col("ts").cast("string")))).cast("string")
    values = [c for c in labels.columns if c not in (ASSET, "ts")]
    single = labels.groupBy(ASSET, "ts").agg(F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in values])
    single = single.withColumn("health_status", F.when(F.col("n") > 1, twice).otherwise(F.col("health_status"))).drop("n")
    joined = predictions.join(single, [ASSET, "ts"], "left")
    copies = F.count("*").over(W.partitionBy(ASSET, "ts"))
    key = F.concat_ws(" ", ASSET, F.col("ts").cast("string"))
    checked = (
        F.when(F.col("copies") > 1, F.raise_error(F.concat(F.lit("not one to one at "), key)).cast("string"))
        .when(F.col("health_status").isNull(), F.raise_error(F.concat(F.lit("no label for prediction at "), key)).cast("string"))
        .otherwise(F.col("health_status"))
    )
    return joined.withColumn("copies", copies).withColumn("health_status", checked).drop("copies")


def targets(flat: DataFrame, labelled: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row per prediction with every truth and score the metrics need.

    ``flat`` is the log form of predictions: health is the rounded health.
    """
    labels = next_critical_time(labelled.select(ASSET, "ts", "health_status"), cfg)
    joined = align_labels(flat, labels)
    return joined.select(
        ASSET,
        "ts",
        (F.col("health_status") != "normal").cast("int").alias("y_health"),
        (F.col("health_state") <= cfg.health_inspect).cast("int").alias("pred_health"),
        clip((100.0 - F.col("health_state")) / 100.0, 0.0, 1.0).alias("health_risk"),
        fails_within(cfg.policy_horizon).cast("int").alias("y_failure"),
        clip(policy_column(cfg), 0.0, 1.0).alias("failure_prob"),
        (F.col("maintenance_level") != "OK").cast("int").alias("pred_maintenance"),
    )


# -- metrics --------------------------------------------------------------


def confusion(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    return df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(y & ~p).alias("fn"),
    )


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Rates from confusion counts.

    Without a denominator precision, recall, accuracy and F1 are 0, the false
    alarm and miss rates undefined (NULL).
    """
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))

    def or_zero(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return counts.select(
        "*",
        or_zero(tp, tp + fp).alias("precision"),
        or_zero(tp, tp + fn).alias("recall"),
        or_zero(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(fp, fp + tn).alias("false_alarm_rate"),
        F.try_divide(fn, fn + tp).alias("miss_rate"),
    )


def ranking_metrics(df: DataFrame, truth: str, score: str) -> DataFrame:
    """ROC-AUC (ties count half) and average precision, exact, as one row.

    Rows first collapse to one per distinct score. Cumulative counts run inside
    buckets of the score; a table of one row per bucket carries the totals
    across. Scores beyond RANK_REACH share the end buckets, so that table has at
    most 2 * RANK_REACH * RANK_BUCKETS + 1 rows whatever the scores are. NULL
    with one class.
    """
    per_score = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")
    )
    per_score = per_score.withColumn("bucket", F.floor(clip(F.col("score"), -RANK_REACH, RANK_REACH) * RANK_BUCKETS).cast("int"))
    totals = per_score.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    higher = W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        "bucket",
        F.coalesce(F.sum("pos").over(higher), F.lit(0)).alias("pos_before"),
        F.coalesce(F.sum("neg").over(higher), F.lit(0)).alias("neg_before"),
        F.sum("pos").over(everything).alias("n_pos"),
        F.sum("neg").over(everything).alias("n_neg"),
    )
    within = W.partitionBy("bucket").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    d = per_score.withColumn("pos_in", F.sum("pos").over(within)).withColumn("neg_in", F.sum("neg").over(within))
    d = d.join(F.broadcast(offsets), "bucket")
    pos_so_far, neg_so_far = F.col("pos_before") + F.col("pos_in"), F.col("neg_before") + F.col("neg_in")
    area = F.col("neg") * (pos_so_far - F.col("pos") / 2.0)
    step = F.col("pos") * F.try_divide(pos_so_far, pos_so_far + neg_so_far)
    n_pos, n_neg = F.max("n_pos"), F.max("n_neg")
    both = (n_pos > 0) & (n_neg > 0)
    return d.agg(
        F.when(both, F.try_divide(F.sum(area), n_pos.cast("double") * n_neg)).alias("roc_auc"),
        F.when(both, F.try_divide(F.sum(step), n_pos.cast("double"))).alias("average_precision"),
    )


def brier(df: DataFrame, truth: str, prob: str) -> DataFrame:
    away = F.col(prob) - F.col(truth)
    return df.agg(F.avg(away * away).alias("brier"))


def ece_bin(prob: Column, bins: int = ECE_BINS) -> Column:
    """Index of the fixed-width bin, left edge included, 1.0 in the last.

    Edges are the floating-point multiples of the width, so compare with them;
    scaling and flooring puts 0.3 and others one bin off.
    """
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    return sum((F.when(prob >= e, 1).otherwise(0) for e in edges), F.lit(0))


def expected_calibration_error(df: DataFrame, truth: str, prob: str, bins: int = ECE_BINS) -> DataFrame:
    p = clip(F.col(prob), 0.0, 1.0)
    per_bin = df.groupBy(ece_bin(p, bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(F.col(truth).cast("double")).alias("observed"), F.avg(p).alias("expected")
    )
    gap = F.col("n") * F.abs(F.col("observed") - F.col("expected"))
    return per_bin.agg(F.try_divide(F.sum(gap), F.sum("n")).alias("ece"))


def dataset_counts(labelled: DataFrame, target_rows: DataFrame) -> DataFrame:
    """Raw, emitted, warm-up, degraded and failure-positive rows, as one row."""
    raw = labelled.select(F.lit(1).alias("raw"), F.lit(0).alias("emitted"), F.lit(0).alias("y_health"), F.lit(0).alias("y_failure"))
    out = target_rows.select(F.lit(0).alias("raw"), F.lit(1).alias("emitted"), "y_health", "y_failure")
    sums = raw.unionByName(out).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in raw.columns])
    return sums.select(
        F.col("raw").alias("n_raw"),
        F.col("emitted").alias("n_emitted"),
        (F.col("raw") - F.col("emitted")).alias("n_warm_up"),
        F.col("y_health").alias("n_degraded"),
        F.col("y_failure").alias("n_failure_positive"),
    )


def as_metrics(rows: DataFrame, section: str, *keys: str) -> DataFrame:
    """One row for each key as long (keys, section, metric, value) rows."""
    names = [c for c in rows.columns if c not in keys]
    pairs = ", ".join(f"'{n}', double({n})" for n in names)
    long = rows.selectExpr(*keys, f"stack({len(names)}, {pairs}) AS (metric, value)")
    return long.select(*keys, F.lit(section).alias("section"), "metric", "value")


# -- by asset and for the fleet at once -------------------------------------


def scope(everything: str, is_fleet: str | None = None) -> Column:
    """Name of a rolled-up row: its asset, or ``everything`` for the row over all of them."""
    fleet = F.grouping("asset_id") if is_fleet is None else F.col(is_fleet)
    return F.when(fleet == 1, F.lit(everything)).otherwise(F.col("asset_id"))


def section_sums(rows: DataFrame) -> DataFrame:
    """Counts and sums of all sections for each asset and the fleet, from one pass over the targets."""

    def cells(name: str, truth: str, predicted: str) -> list[Column]:
        y, p = F.col(truth) == 1, F.col(predicted) == 1
        return [F.count_if(c).alias(f"{name}_{n}") for n, c in (("tp", y & p), ("fp", ~y & p), ("tn", ~y & ~p), ("fn", y & ~p))]

    away = F.col("failure_prob") - F.col("y_failure")
    return rows.rollup(ASSET).agg(
        F.grouping(ASSET).alias("is_fleet"),
        F.count("*").alias("n_emitted"),
        F.sum("y_health").alias("n_degraded"),
        F.sum("y_failure").alias("n_failure_positive"),
        *cells("health", "y_health", "pred_health"),
        *cells("maintenance", "y_failure", "pred_maintenance"),
        F.avg(away * away).alias("brier"),
    )


def rates_of(sums: DataFrame, name: str) -> DataFrame:
    return binary_metrics(sums.select("scope", *[F.col(f"{name}_{c}").alias(c) for c in ("tp", "fp", "tn", "fn")]))


def scoped_counts(raw: DataFrame, sums: DataFrame) -> DataFrame:
    """Raw, emitted, warm-up, degraded and failure-positive rows; assets without outputs have zeros."""
    both = raw.join(sums.select("scope", "n_emitted", "n_degraded", "n_failure_positive"), raw["scope"].eqNullSafe(sums["scope"]), "left")
    zero = {c: F.coalesce(sums[c], F.lit(0)).alias(c) for c in ("n_emitted", "n_degraded", "n_failure_positive")}
    return both.select(
        raw["scope"], "n_raw", zero["n_emitted"], (F.col("n_raw") - zero["n_emitted"]).alias("n_warm_up"), zero["n_degraded"], zero["n_failure_positive"]
    )


def scoped_calibration_error(rows: DataFrame, everything: str, bins: int = ECE_BINS) -> DataFrame:
    """(scope, ece): bins of each asset, and of all assets."""
    binned = rows.select(ASSET, ece_bin(F.col("failure_prob"), bins).alias("bin"), "y_failure", "failure_prob")
    per_bin = binned.rollup("bin", ASSET).agg(
        F.grouping("bin").alias("no_bin"), scope(everything).alias("scope"), F.count("*").alias("n"),
        F.avg(F.col("y_failure").cast("double")).alias("observed"), F.avg("failure_prob").alias("expected"),
    ).filter("no_bin = 0")
    gap = F.col("n") * F.abs(F.col("observed") - F.col("expected"))
    return per_bin.groupBy("scope").agg(F.try_divide(F.sum(gap), F.sum("n")).alias("ece"))


def scoped_ranking(rows: DataFrame, truth: str, score: str, everything: str) -> DataFrame:
    """(scope, roc_auc, average_precision) of ``ranking_metrics`` for each asset and the fleet.

    Rows collapse to one for each (score, asset) and, in the same rollup, for
    each score. Running counts stay inside (scope, bucket of the score); the
    totals of the buckets, at most as many as the scores' range has, are carried
    across by a window over (scope) on them alone. The offsets join by key: with
    very many assets they are no small table.
    """
    per_score = rows.select(ASSET, F.col(truth).alias("truth"), F.col(score).alias("score")).rollup("score", ASSET).agg(
        F.grouping("score").alias("no_score"), scope(everything).alias("scope"),
        F.count_if(F.col("truth") == 1).alias("pos"), F.count_if(F.col("truth") != 1).alias("neg"),
    ).filter("no_score = 0")
    per_score = per_score.select(
        "scope", "score", "pos", "neg", F.floor(clip(F.col("score"), -RANK_REACH, RANK_REACH) * RANK_BUCKETS).cast("int").alias("bucket")
    )
    totals = per_score.groupBy("scope", "bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    higher = W.partitionBy("scope").orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("scope")
    offsets = totals.select(
        F.col("scope").alias("of"), F.col("bucket").alias("at"),
        *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_before") for c in ("pos", "neg")],
        *[F.sum(c).over(whole).alias(f"n_{c}") for c in ("pos", "neg")],
    )
    within = W.partitionBy("scope", "bucket").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    d = per_score.withColumn("pos_in", F.sum("pos").over(within)).withColumn("neg_in", F.sum("neg").over(within))
    d = d.join(offsets, d["scope"].eqNullSafe(offsets["of"]) & (d["bucket"] == offsets["at"]))
    pos_so_far, neg_so_far = F.col("pos_before") + F.col("pos_in"), F.col("neg_before") + F.col("neg_in")
    area = F.col("neg") * (pos_so_far - F.col("pos") / 2.0)
    step = F.col("pos") * F.try_divide(pos_so_far, pos_so_far + neg_so_far)
    n_pos, n_neg = F.max("n_pos"), F.max("n_neg")
    both = (n_pos > 0) & (n_neg > 0)
    return d.groupBy("scope").agg(
        F.when(both, F.try_divide(F.sum(area), n_pos.cast("double") * n_neg)).alias("roc_auc"),
        F.when(both, F.try_divide(F.sum(step), n_pos.cast("double"))).alias("average_precision"),
    )
