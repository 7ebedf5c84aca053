"""Clustering and parsing quality.  labels: seq, pred, truth.  All from one contingency table; nothing is paired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.text import one_spaced


def joined(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Labels by seq; an error if the lists differ in length."""
    a, b = pred.count(), truth.count()
    if a != b:
        raise ValueError(f"{a} predictions, {b} true labels")
    return pred.select("seq", F.col("label").alias("pred")).join(truth.select("seq", F.col("label").alias("truth")), "seq")


def label_accuracy(labels: DataFrame) -> DataFrame:
    return labels.agg(F.coalesce(F.avg((F.col("pred") == F.col("truth")).cast("double")), F.lit(0.0)).alias("label_accuracy"))


def parsing_accuracy(labels: DataFrame) -> DataFrame:
    """Equality of templates apart from white space."""
    same = one_spaced(F.col("pred")) == one_spaced(F.col("truth"))
    return labels.agg(F.coalesce(F.avg(same.cast("double")), F.lit(0.0)).alias("parsing_accuracy"))


def contingency(labels: DataFrame) -> DataFrame:
    return labels.groupBy("pred", "truth").agg(F.count(F.lit(1)).alias("n"))


def f1(labels: DataFrame) -> DataFrame:
    """f1, precision, recall; a zero denominator gives 0."""
    table = contingency(labels)
    rows = table.groupBy("pred").agg(F.max("n").alias("m"), F.sum("n").alias("s")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("s") - F.col("m")), F.lit(0)).alias("fp"))
    columns = table.groupBy("truth").agg(F.max("n").alias("m"), F.sum("n").alias("s")).agg(F.coalesce(F.sum(F.col("s") - F.col("m")), F.lit(0)).alias("fn"))
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp = F.col("tp")
    both = rows.join(columns).select(part(tp, tp + F.col("fp")).alias("precision"), part(tp, tp + F.col("fn")).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return both.select(part(2 * p * r, p + r).alias("f1"), "precision", "recall")


def template_accuracy(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of true templates (template_id, pattern) whose predicted pattern is equal apart from white space."""
    both = truth.join(pred.select("template_id", F.col("pattern").alias("_p")), "template_id", "left")
    same = F.coalesce(one_spaced(F.col("_p")) == one_spaced(F.col("pattern")), F.lit(False))
    return both.agg(F.coalesce(F.avg(same.cast("double")), F.lit(0.0)).alias("template_accuracy"))


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """ari; 0 for fewer than two rows and where the largest index equals the expected one."""
    pairs = lambda n: n * (n - 1) / 2
    table = contingency(labels)
    total = lambda by: (table.groupBy(by) if by else table.groupBy("pred", "truth")).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    one = total(None).withColumnRenamed("c", "index").join(total("pred").select(F.col("c").alias("a"))).join(total("truth").select(F.col("c").alias("b")))
    expected = F.try_divide(F.col("a") * F.col("b"), pairs(F.col("n")))
    largest = (F.col("a") + F.col("b")) / 2
    return one.select(F.when((F.col("n") < 2) | (largest == expected), 0.0).otherwise(F.coalesce((F.col("index") - expected) / F.nullif(largest - expected, F.lit(0.0)), F.lit(0.0))).alias("ari"))


def set_accuracy(labels: DataFrame) -> DataFrame:
    """The usual grouping accuracy: share of rows whose predicted and true clusters are the same set."""
    table = contingency(labels)
    p, t = table.groupBy("pred").agg(F.sum("n").alias("np")), table.groupBy("truth").agg(F.sum("n").alias("nt"))
    full = table.join(p, "pred").join(t, "truth")
    return full.agg(F.coalesce(F.sum(F.when((F.col("n") == F.col("np")) & (F.col("n") == F.col("nt")), F.col("n")).otherwise(0)) / F.sum("n"), F.lit(0.0)).alias("set_accuracy"))


def all_metrics(labels: DataFrame, pred: DataFrame | None = None, truth: DataFrame | None = None) -> DataFrame:
    out = label_accuracy(labels).join(f1(labels)).join(adjusted_rand(labels))
    return out.join(template_accuracy(pred, truth)) if pred is not None and truth is not None else out
