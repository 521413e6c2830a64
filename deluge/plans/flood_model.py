"""Stage 2 as jobs: train and evaluate a flood model from a sample table, score a predictor table.

Both read and write the typed CSV tables that the stages hand to each other
(``sources/files.py``), so stage 1 output feeds training and scoring, and scores feed the
zone comparison.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModelSettings
from ..operators import metrics as MT
from ..operators import ml as ML
from ..sources import files as FI
from ..sources import sinks as SK


@dataclass
class Evaluation:
    """Hold-out quality of a fitted model (a few rows each)."""

    matrix: DataFrame
    report: DataFrame
    auc: DataFrame


def evaluate(scored: DataFrame, label: str) -> Evaluation:
    """Confusion matrix, classification report and ROC AUC of scored hold-out rows."""
    return Evaluation(MT.confusion_matrix(scored, label, "flood_predicted"),
                      MT.classification_report(scored, label, "flood_predicted"),
                      MT.roc_auc_frame(scored, label, "flood_probability"))


def train_job(spark: SparkSession, samples_csv: str, out_dir: str, ms: ModelSettings = ModelSettings(),
              folds: bool = True) -> ML.TrainingResult:
    """Samples CSV -> cross-validation, hold-out evaluation, calibration, importances, saved model.

    Writes ``model``, ``confusion_matrix``, ``classification_report``, ``importances`` and
    ``auc`` (cross-validation folds and mean, hold-out before and after calibration) below
    ``out_dir``; returns the training result.
    """
    samples = FI.read_csv(spark, samples_csv, FI.SAMPLES_DDL)
    res = ML.train(samples, ms)
    ev = evaluate(res.test_scored, ms.label)
    SK.write_csv(ev.matrix, f"{out_dir}/confusion_matrix")
    SK.write_csv(ev.report, f"{out_dir}/classification_report")
    SK.write_csv(ML.importances(res.model, spark), f"{out_dir}/importances")
    before, after = ML.calibrated_auc(res, ms)
    rows = [("holdout", float(before)), ("holdout_calibrated", float(after))]
    if folds:
        per = ML.cross_validate(res.train, ms, res.codes)
        rows += [(f"fold_{f}", float(a)) for f, a in per] + [("cv_mean", float(sum(a for _, a in per) / len(per)))]
    SK.write_csv(spark.createDataFrame(rows, "name string, auc double"), f"{out_dir}/auc")
    ML.save(res.model, f"{out_dir}/model")
    return res


def score_job(spark: SparkSession, model_path: str, predictors_csv: str, out_csv: str) -> None:
    """Predictors CSV -> the same columns plus ``flood_probability`` and ``flood_predicted`` as CSV."""
    model = FI.load_model(model_path)
    scored = ML.score(model, FI.read_csv(spark, predictors_csv, FI.PREDICTORS_DDL))
    SK.write_csv(scored, out_csv)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return FI.read_csv(spark, path, FI.PREDICTIONS_DDL)


def holdout_checks(ev: Evaluation) -> DataFrame:
    """label, support, and whether every figure of the report is what the matrix says.

    Precision, recall, f1 and support of both classes, accuracy and both averages are worked out
    again from the four counts of the matrix.
    """
    def of(truth, pred):
        return F.sum(F.when(F.col("truth") == truth, F.col(f"pred_{pred}")).otherwise(0)).cast("double")
    n = ev.matrix.agg(of(0, 0).alias("n00"), of(0, 1).alias("n01"), of(1, 0).alias("n10"), of(1, 1).alias("n11"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    n = n.select("*", *[e.alias(k) for k, e in {
        "p0": ratio(c("n00"), c("n00") + c("n10")), "r0": ratio(c("n00"), c("n00") + c("n01")),
        "p1": ratio(c("n11"), c("n11") + c("n01")), "r1": ratio(c("n11"), c("n11") + c("n10")),
        "s0": c("n00") + c("n01"), "s1": c("n10") + c("n11"), "total": c("n00") + c("n01") + c("n10") + c("n11")}.items()])
    n = n.select("*", *[ratio(2.0 * c(f"p{k}") * c(f"r{k}"), c(f"p{k}") + c(f"r{k}")).alias(f"f{k}") for k in (0, 1)],
                 ratio(c("n00") + c("n11"), c("total")).alias("accuracy"))
    none = F.lit(None).cast("double")
    macro = [(c(f"{m}0") + c(f"{m}1")) / 2 for m in "prf"]
    weighted = [ratio(c(f"{m}0") * c("s0") + c(f"{m}1") * c("s1"), c("total")) for m in "prf"]
    want = n.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("label"), *[v.alias(k) for k, v in zip(("p", "r", "f", "s"), values)])
        for name, values in {"0": (c("p0"), c("r0"), c("f0"), c("s0")), "1": (c("p1"), c("r1"), c("f1"), c("s1")),
                             "accuracy": (none, none, c("accuracy"), c("total")), "macro avg": (*macro, c("total")),
                             "weighted avg": (*weighted, c("total"))}.items()])).alias("w")).select("w.*")

    def same(a, b):
        return (a.isNull() & b.isNull()) | (F.abs(a - b) < 1e-12)
    both = ev.report.join(F.broadcast(want), "label")  # five rows
    return both.select("label", "support", F.coalesce(
        same(c("precision"), c("p")) & same(c("recall"), c("r")) & same(c("f1_score"), c("f"))
        & (c("support").cast("double") == c("s")), F.lit(False)).alias("consistent"))
