"""Thresholds, confusion counts and ranking curves on a long score table.

Scores: (model, id, label, score, attack_technique), higher = more anomalous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from querysieve.operators.ordering import exact_quantile, previous_row, running_sums
from querysieve.session import broadcast_if_small

MAX_FALSE_POSITIVE_RATE = 0.001
# A rank error of 0.0002: a fifth of the default rate.
SKETCH_K = 32_768


def fpr_threshold(validation: DataFrame, max_rate: float = MAX_FALSE_POSITIVE_RATE) -> DataFrame:
    """(model, threshold): the (1 - max_rate) quantile of validation scores."""
    return exact_quantile(validation, "score", 1 - max_rate, ["model"], "threshold")


def sketch_rank_error(k: int) -> float:
    """Two-sided rank error of a quantile sketch of ``k``, as published for it (99 %)."""
    return 2.296 / k**0.9021


def fpr_threshold_sketch(validation: DataFrame, max_rate: float = MAX_FALSE_POSITIVE_RATE, k: int = SKETCH_K) -> DataFrame:
    """(model, threshold, rank_error): as ``fpr_threshold``, from quantile sketches that tasks merge.

    One scan, and a shuffle of one sketch for each task and model, however many scores there are. The threshold's rank
    differs from the wanted one by ``rank_error`` of all scores at most; models without scores have no row.
    """
    sketched = validation.where(F.col("score").isNotNull()).groupBy("model").agg(
        F.kll_sketch_agg_double(F.col("score"), F.lit(k)).alias("s")
    )
    return sketched.select(
        "model", F.kll_sketch_get_quantile_double("s", F.lit(1.0 - max_rate)).alias("threshold"), F.lit(sketch_rank_error(k)).alias("rank_error")
    )


def with_threshold(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Attach each model's threshold (one row per model, size-checked broadcast)."""
    return scores.join(broadcast_if_small(thresholds.select("model", "threshold")), "model")


def threshold_share(validation: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Count and share of validation scores strictly above the threshold."""
    above = F.count_if(F.col("score") > F.col("threshold"))
    return with_threshold(validation, thresholds).groupBy("model").agg(
        above.alias("n_above"), (above / F.count("*")).alias("share_above")
    )


def predict(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """1 where the score reaches the threshold."""
    return with_threshold(scores, thresholds).withColumn(
        "pred", (F.col("score") >= F.col("threshold")).cast("int")
    )


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def confusion(predictions: DataFrame) -> DataFrame:
    """Confusion counts and rates per model; undefined rates are 0."""
    is_ = lambda label, pred: F.count_if((F.col("label") == label) & (F.col("pred") == pred))
    counts = predictions.groupBy("model").agg(
        is_(0, 0).alias("tn"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"), is_(1, 1).alias("tp")
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        "fone": _ratio(2 * tp, 2 * tp + fp + fn),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "fpr": _ratio(fp, fp + tn),
    })


def ranked_scores(scores: DataFrame) -> DataFrame:
    """Cumulative true and false positives per distinct score, from the highest down.

    Rows are first combined per (model, score), so ties cost nothing downstream.
    """
    steps = scores.groupBy("model", "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    ranked = running_sums(
        steps, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, ["model"]
    )
    # The running sums sit on a written table, so the totals do not go back to the scores.
    totals = ranked.groupBy("model").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return ranked.join(broadcast_if_small(totals), "model")


def pr_curve(scores: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """(model, threshold, precision, recall) per distinct score plus the (0, 1) end point."""
    ranked = ranked_scores(scores) if ranked is None else ranked
    points = ranked.select(
        "model",
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        # Without attacks recall is 1 by convention.
        F.coalesce(F.try_divide("tp", "p"), F.lit(1.0)).alias("recall"),
    )
    end = ranked.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def auprc(scores: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Trapezoid area under the precision-recall curve.

    Each row knows its own increment, so its predecessor is arithmetic, not a lag.
    """
    ranked = ranked_scores(scores) if ranked is None else ranked
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    area = F.try_divide(F.col("pos"), F.col("p")) * (before + here) / 2
    return ranked.groupBy("model").agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("auprc"))


def roc_curve(scores: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """(model, threshold, fpr, tpr) per distinct score plus the origin."""
    ranked = ranked_scores(scores) if ranked is None else ranked
    points = ranked.select(
        "model",
        F.col("score").alias("threshold"),
        _ratio(F.col("fp"), F.col("n")).alias("fpr"),
        _ratio(F.col("tp"), F.col("p")).alias("tpr"),
    )
    origin = ranked.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def auroc(scores: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Trapezoid area under the ROC curve."""
    ranked = ranked_scores(scores) if ranked is None else ranked
    twice = F.col("neg") * (2 * F.col("tp") - F.col("pos"))
    return ranked.groupBy("model").agg(
        _ratio(F.sum(twice), 2 * F.max("p") * F.max("n")).alias("auroc")
    )


def recall_by_technique(predictions: DataFrame) -> DataFrame:
    """(model, attack_technique, recall) over attack rows."""
    return (
        predictions.where((F.col("label") == 1) & F.col("attack_technique").isNotNull())
        .groupBy("model", "attack_technique")
        .agg(F.avg("pred").alias("recall"), F.count("*").alias("n"))
    )


def recall_columns(recalls: DataFrame, techniques: list[str]) -> DataFrame:
    """One column ``recall<technique>`` per technique; a technique that is not listed raises."""
    technique = F.col("attack_technique")
    unknown = F.raise_error(F.concat(F.lit("unlisted technique "), technique)).cast("string")
    named = recalls.withColumn("attack_technique", F.when(technique.isin(*techniques), technique).otherwise(unknown))
    return named.groupBy("model").pivot("attack_technique", techniques).agg(F.first("recall")).select(
        "model", *[F.col(t).alias(f"recall{t}") for t in techniques]
    )


def prevalence(scores: DataFrame) -> DataFrame:
    """Precision of a random classifier."""
    return scores.groupBy("model").agg(F.avg("label").alias("prevalence"))


def auc_from_points(points: DataFrame, x: str, y: str, y_descending: bool = False) -> DataFrame:
    """Trapezoid area of stored curve points per model, in x order.

    ``y_descending`` orders equal-x points the way a precision-recall curve visits them.
    """
    tie = F.desc(y) if y_descending else F.asc(y)
    # Equal points add no area; merging them makes the order total.
    distinct = points.groupBy("model", x, y).agg(F.lit(1))
    paired = previous_row(distinct.select("model", x, y), [F.col(x), tie], {"_x0": x, "_y0": y}, ["model"])
    area = (F.col(x) - F.col("_x0")) * (F.col(y) + F.col("_y0")) / 2
    return paired.groupBy("model").agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("area"))


def label_conflicts(scores: DataFrame) -> DataFrame:
    """Rows whose label differs between pipelines."""
    return (
        scores.groupBy("id").agg(F.min("label").alias("lowest"), F.max("label").alias("highest"))
        .where(F.col("lowest") != F.col("highest"))
    )


def percent(value: Column, decimals: int = 2) -> Column:
    """Fixed decimals with a percent sign, ties to even; null stays null."""
    shown = F.format_string(f"%.{decimals}f%%", F.bround(value * 100, decimals))
    return F.when(value.isNotNull(), shown)


def metrics_report(
    test: DataFrame,
    validation: DataFrame,
    techniques: list[str],
    max_rate: float = MAX_FALSE_POSITIVE_RATE,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """One formatted row per model: rates at the validation threshold, areas, recall per technique."""
    predictions = predict(test, fpr_threshold(validation, max_rate))
    ranked = ranked_scores(test) if ranked is None else ranked
    areas = auprc(test, ranked).join(auroc(test, ranked), "model")
    recalls = recall_columns(recall_by_technique(predictions), techniques)
    shown = lambda t: F.coalesce(percent(F.col(f"recall{t}")), F.lit("")).alias(f"recall{t}")
    return (
        confusion(predictions).join(areas, "model").join(recalls, "model", "left").select(
            "model",
            *[percent(F.col(c)).alias(c) for c in ("fone", "accuracy", "precision", "recall")],
            percent(F.col("fpr"), 5).alias("fpr"),
            F.format_string("%.4f", F.bround("auprc", 4)).alias("auprc"),
            F.format_string("%.4f", F.bround("auroc", 4)).alias("rocauc"),
            *[shown(t) for t in techniques],
        )
    )


def write_report(report: DataFrame, root: str, gpu: bool = False, on_user_inputs: bool = False) -> str:
    """Store the report in a folder named after the run mode."""
    path = f"{root}/results{'-gpu' if gpu else ''}{'-on-user-inputs' if on_user_inputs else ''}.csv"
    report.write.mode("overwrite").option("header", True).csv(path)
    return path
