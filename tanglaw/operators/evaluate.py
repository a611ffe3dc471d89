"""Classification metrics from a table of predictions (doc_id, language, y_true, y_pred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(pred: DataFrame, by: list[str]) -> DataFrame:
    """(by..., label, tp, fp, fn): one shuffle of partial counts of (true, predicted) pairs."""
    pairs = pred.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    sides = pairs.select(
        *by, F.explode(F.array(
            F.struct(F.col("y_true").alias("label"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"),
                     F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0).alias("fn")),
            F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("fn")),
        )).alias("s"),
    )
    return sides.groupBy(*by, F.col("s.label").alias("label")).agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "fp", "fn")])


def ratio(a: str, b: str):
    return F.when(F.col(a) + F.col(b) > 0, F.col("tp") / (F.col(a) + F.col(b))).otherwise(0.0)


def per_class(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and support of every label that occurs, true or predicted."""
    by = by or []
    out = counts(pred, by).withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn"), "support": F.col("tp") + F.col("fn")})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1).select(*by, "label", "precision", "recall", "f1", "support")


def summary(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Documents, accuracy, macro-F1 over the labels that occur, and the share of errors of two levels."""
    by = by or []
    f1 = per_class(pred, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    basic = pred.groupBy(*by).agg(
        F.count("*").alias("n_docs"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
        F.avg((F.abs(F.col("y_true") - F.col("y_pred")) >= 2).cast("double")).alias("nonadjacent"),
    )
    if by:
        return basic.join(f1, by)
    return basic.withColumn("_k", F.lit(1)).join(f1.withColumn("_k", F.lit(1)), "_k").drop("_k")


def confusion(pred: DataFrame, labels: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Row-normalized confusion matrix, four decimals; a label without true rows has none."""
    cells = [F.count_if(F.col("y_pred") == k) for k in labels]
    return pred.groupBy("y_true").agg(*[F.round(c / F.count("*"), 4).alias(f"p{k}") for k, c in zip(labels, cells)])


def fold_summary(pred: DataFrame) -> DataFrame:
    """Mean and population deviation over folds of accuracy and macro-F1 rounded to four decimals. ``pred`` has fold."""
    folds = summary(pred, ["fold"]).select(F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))
    return folds.agg(
        F.avg("macro_f1").alias("mean_macro_f1"), F.stddev_pop("macro_f1").alias("std_macro_f1"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy")
    )


def delta(a: DataFrame, b: DataFrame, by: str, threshold: float) -> DataFrame:
    """Macro-F1 of two configurations by group, their difference, and whether it reaches the threshold; groups of either side appear."""
    left, right = summary(a, [by]).select(by, F.col("macro_f1").alias("f1_a")), summary(b, [by]).select(by, F.col("macro_f1").alias("f1_b"))
    both = left.join(right, by, "full")
    return both.select(by, "f1_a", "f1_b", (F.col("f1_b") - F.col("f1_a")).alias("delta"), (F.coalesce(F.col("f1_b") - F.col("f1_a"), F.lit(0.0)) >= threshold).alias("accepted"))


def ranked(pred: DataFrame, by: list[str]) -> DataFrame:
    """Groups by their accuracy, best first."""
    s = summary(pred, by)
    return s.withColumn("place", F.rank().over(Window.orderBy(F.desc("accuracy"))))
