"""Classification metrics as aggregates (all distributed; derived tables have a few rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, truth: str, pred: str, classes=(0, 1)) -> DataFrame:
    """Rows = truth class, columns pred_<c> = counts (zeros filled)."""
    return (df.groupBy(F.col(truth).alias("truth"))
              .pivot(pred, list(classes)).count()
              .select("truth", *[F.coalesce(F.col(str(c)), F.lit(0)).cast("long").alias(f"pred_{c}") for c in classes]))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Binary report: per class precision/recall/f1/support, accuracy, macro and weighted avg.

    Zero division gives 0 (the scikit-learn convention).  Built from one four-count
    aggregate, so the input is read once.
    """
    t, p = F.col(truth), F.col(pred)
    n = df.agg(*[F.count_if((t == a) & (p == b)).cast("double").alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    p0, r0 = _ratio(n00, n00 + n10), _ratio(n00, n00 + n01)
    p1, r1 = _ratio(n11, n11 + n01), _ratio(n11, n11 + n10)
    s0, s1 = n00 + n01, n10 + n11
    tot = s0 + s1
    m = n.select(p0.alias("p0"), r0.alias("r0"), p1.alias("p1"), r1.alias("r1"),
                 s0.alias("s0"), s1.alias("s1"), tot.alias("tot"),
                 _ratio(n00 + n11, tot).alias("acc"))
    f0 = _ratio(F.lit(2.0) * F.col("p0") * F.col("r0"), F.col("p0") + F.col("r0"))
    f1 = _ratio(F.lit(2.0) * F.col("p1") * F.col("r1"), F.col("p1") + F.col("r1"))
    m = m.withColumns({"f0": f0, "f1": f1})

    def row(label, prec, rec, f, sup):
        return F.struct(F.lit(label).alias("label"), prec.cast("double").alias("precision"),
                        rec.cast("double").alias("recall"), f.cast("double").alias("f1_score"),
                        sup.cast("long").alias("support"))
    c = F.col
    rows = F.array(
        row("0", c("p0"), c("r0"), c("f0"), c("s0")),
        row("1", c("p1"), c("r1"), c("f1"), c("s1")),
        row("accuracy", F.lit(None), F.lit(None), c("acc"), c("tot")),
        row("macro avg", (c("p0") + c("p1")) / 2, (c("r0") + c("r1")) / 2, (c("f0") + c("f1")) / 2, c("tot")),
        row("weighted avg", _ratio(c("p0") * c("s0") + c("p1") * c("s1"), c("tot")),
            _ratio(c("r0") * c("s0") + c("r1") * c("s1"), c("tot")),
            _ratio(c("f0") * c("s0") + c("f1") * c("s1"), c("tot")), c("tot")))
    return m.select(F.explode(rows).alias("r")).select("r.*")


def roc_auc(df: DataFrame, label: str, score: str) -> float:
    """Exact ROC AUC (ties averaged) via MLlib's distributed sort; no score binning."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    ev = BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, metricName="areaUnderROC", numBins=0)
    return ev.evaluate(df.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias(label)))


def roc_auc_frame(df: DataFrame, label: str, score: str, buckets: int | None = None) -> DataFrame:
    """Exact ROC AUC (ties averaged) as a one-row DataFrame, fully distributed; NULL with one class only.

    Scores are grouped first (pos/neg per distinct score).  Distinct scores are then
    cut into ``buckets`` ranges (by default one per shuffle partition) by approximate
    quantiles (boundaries only decide the split, not the result); negatives below a score = negatives in earlier buckets
    (a prefix over <= ``buckets`` rows, broadcast) + a running sum inside its bucket
    (a window partitioned by bucket).  No single task sees all scores.
    """
    from pyspark.sql import Window
    if buckets is None:
        buckets = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    g = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
           .groupBy(F.col(score).cast("double").alias("s"))
           .agg(F.sum(F.col(label).cast("long")).alias("pos"),
                F.sum((1 - F.col(label)).cast("long")).alias("neg")))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = g.agg(F.percentile_approx("s", probs, max(10000, 20 * buckets)).alias("c")).first()["c"] or []
    cuts = sorted(set(float(c) for c in cuts))
    # Boundaries travel as one literal array; a score's range is the number of boundaries below it.
    arr = F.lit(cuts) if cuts else F.array().cast("array<double>")
    gb = g.withColumn("b", F.size(F.filter(arr, lambda c: c < F.col("s"))))
    per = gb.groupBy("b").agg(F.sum("neg").alias("bneg"))
    prefix = per.withColumn("off", F.coalesce(
        F.sum("bneg").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    c = (gb.join(F.broadcast(prefix.select("b", "off")), "b")
           .withColumn("below", F.col("off") + F.coalesce(F.sum("neg").over(w), F.lit(0))))
    # In doubles: products of row counts pass the range of a long at about 3e9 rows per class.
    pos, neg, below = (F.col(k).cast("double") for k in ("pos", "neg", "below"))
    return c.agg(F.try_divide(F.sum(pos * (below + neg / 2.0)), F.sum(pos) * F.sum(neg)).alias("auc"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    from pyspark.sql import Window
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return counts.select("class", "n_c",
                         (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def fold_aucs(scored: DataFrame, fold: str, folds, label: str, score: str) -> DataFrame:
    """(fold, auc): the ROC AUC of every fold named and, as fold ``mean``, their mean."""
    out = None
    for f in folds:
        one = roc_auc_frame(scored.where(F.col(fold) == f), label, score).select(F.lit(str(f)).alias("fold"), "auc")
        out = one if out is None else out.unionByName(one)
    return out.unionByName(out.agg(F.lit("mean").alias("fold"), F.avg("auc").alias("auc")))
