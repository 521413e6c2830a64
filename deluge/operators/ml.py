"""Random-forest flood model on Spark ML.

Pipeline = SQLTransformer (one-hot of the land-cover code over the codes seen in
training) -> VectorAssembler -> RandomForestClassifier.  The one-hot stage is part of
the saved model, so scoring data is aligned to the training columns by construction:
codes unseen in training (or NULL) become all zeros, extra codes are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ModelSettings
from . import metrics as MT
from .sampling import stratified_folds, stratified_split


def fit_codes(df: DataFrame, column: str, max_codes: int | None = None) -> list[int]:
    """Distinct category codes, sorted; more than ``max_codes`` (if given) is an error.

    One column of the model per code, so the vocabulary has to fit the driver anyway.
    """
    codes = df.agg(F.sort_array(F.collect_set(F.col(column).cast("int"))).alias("c")).first()["c"]
    if max_codes is not None and len(codes) > max_codes:
        raise ValueError(f"{len(codes)} distinct {column} codes, more than the limit of {max_codes}")
    return [int(c) for c in codes]


def one_hot_sql(column: str, codes: list[int]) -> str:
    cols = ", ".join(f"coalesce(double(`{column}` = {c}), 0D) AS `{column}_{c}`" for c in codes)
    return f"SELECT *, {cols} FROM __THIS__" if cols else "SELECT * FROM __THIS__"


def one_hot(df: DataFrame, column: str, codes: list[int]) -> DataFrame:
    return df.withColumns({f"{column}_{c}": F.coalesce((F.col(column) == c).cast("double"), F.lit(0.0))
                           for c in codes})


def align(df: DataFrame, template: list[str]) -> DataFrame:
    """Columns of ``template`` in order; missing ones as 0, extras dropped."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(0.0).alias(c) for c in template])


def feature_columns(ms: ModelSettings, codes: list[int]) -> list[str]:
    base = [f for f in ms.features if f != ms.categorical]
    return base + [f"{ms.categorical}_{c}" for c in codes]


def with_weights(df: DataFrame, label: str) -> DataFrame:
    w = MT.class_weights(df, label).select(F.col("class").alias(label), F.col("weight").alias("_w"))
    return df.join(F.broadcast(w), label, "left")


def build_pipeline(ms: ModelSettings, codes: list[int]) -> Pipeline:
    feats = feature_columns(ms, codes)
    return Pipeline(stages=[
        SQLTransformer(statement=one_hot_sql(ms.categorical, codes)),
        VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep"),
        RandomForestClassifier(featuresCol="features", labelCol="_y", weightCol="_w", numTrees=ms.trees,
                               maxDepth=ms.max_depth, minInstancesPerNode=ms.min_leaf, seed=ms.seed,
                               featureSubsetStrategy="sqrt", probabilityCol="probability",
                               # larger node groups: fewer passes per level; node ids cached per
                               # row instead of shipping 200 deep trees every level (checkpointed
                               # into spark.checkpoint.dir every 10 iterations)
                               maxMemoryInMB=512, cacheNodeIds=True, checkpointInterval=10)])


def fit(df: DataFrame, ms: ModelSettings, codes: list[int] | None = None) -> PipelineModel:
    from ..session import checkpoint_dir
    classes = df.select(ms.label).where(F.col(ms.label).isNotNull()).distinct().limit(2).count()
    if classes < 2:
        raise ValueError(f"a forest needs samples of two classes of {ms.label}; the sample has {classes}")
    checkpoint_dir(df.sparkSession)  # the node-id cache checkpoints into the shared folder
    codes = fit_codes(df, ms.categorical, ms.max_codes) if codes is None else codes
    data = with_weights(df, ms.label).withColumn("_y", F.col(ms.label).cast("double"))
    return build_pipeline(ms, codes).fit(data)


#: Poisson(1): chances of at most 0, 1, 2 ... draws; beyond the last it is taken as one more.
_POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9))


def bootstrap(df: DataFrame, key: str, trees: int, seed: int) -> DataFrame:
    """``df`` once per tree that draws the row, with ``tree`` and ``draws``.

    How often a tree draws a row is a Poisson(1) number read off a hash of (key, tree, seed): what a
    bootstrap of a large sample gives, without shuffling or counting rows, and the same on every run.
    """
    named = df.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    text = F.concat_ws(":", F.col(f"`{key}`").cast("string"), F.col("tree").cast("string"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)
    draws = sum((F.when(u >= F.lit(p), 1).otherwise(0) for p in _POISSON), F.lit(0))
    return named.withColumn("draws", draws).where("draws > 0")


def bootstrap_weights(drawn: DataFrame, label: str) -> DataFrame:
    """(tree, class, n, weight): draws per tree and class, and the weight that balances the tree's classes."""
    per = drawn.groupBy("tree", F.col(label).alias("class")).agg(F.sum("draws").cast("long").alias("n"))
    whole = per.groupBy("tree").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    return per.join(whole, "tree").select("tree", "class", "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


@dataclass
class SubsampledForest:
    """Trees fitted one by one; a row's probability is the mean over the trees."""

    trees: list[PipelineModel]

    def score(self, df: DataFrame) -> DataFrame:
        """Adds flood_probability (mean P(class 1)) and flood_predicted (0/1)."""
        out = PipelineModel(self.trees[0].stages[:-1]).transform(df)  # the same features for all
        names = []
        for k, tree in enumerate(self.trees):
            one = tree.stages[-1].copy()
            one.setProbabilityCol(f"_v{k}").setRawPredictionCol("").setPredictionCol("")
            out = one.transform(out)
            names.append(vector_to_array(f"_v{k}")[1])
        mean = sum(names, F.lit(0.0)) / len(names)
        return out.select(*[F.col(f"`{c}`") for c in df.columns], mean.alias("flood_probability")).withColumn(
            "flood_predicted", (F.col("flood_probability") > 0.5).cast("int"))


def fit_balanced(df: DataFrame, ms: ModelSettings, key: str = "system:index", codes: list[int] | None = None,
                 parallel: int = 4) -> SubsampledForest:
    """A forest whose class weights are those of each tree's own bootstrap (``balanced_subsample``).

    Every tree is a forest of one, fitted on its drawn rows with draws x class weight as row weight and the usual
    random choice of features per node.  ``parallel`` trees are fitted at a time.
    """
    from concurrent.futures import ThreadPoolExecutor

    from ..session import checkpoint_dir, cut_lineage
    checkpoint_dir(df.sparkSession)
    codes = fit_codes(df, ms.categorical, ms.max_codes) if codes is None else codes
    drawn = cut_lineage(bootstrap(df, key, ms.trees, ms.seed))
    weights = bootstrap_weights(drawn, ms.label).withColumnsRenamed({"tree": "_tree", "class": "_class", "weight": "_cw"}).drop("n")
    data = drawn.join(F.broadcast(weights), (F.col("tree") == F.col("_tree")) & (F.col(ms.label) == F.col("_class")))  # trees x classes rows
    data = cut_lineage(data.withColumn("_w", F.col("draws") * F.col("_cw")).withColumn("_y", F.col(ms.label).cast("double"))
                       .drop("_tree", "_class", "_cw"))

    def one(tree: int) -> PipelineModel:
        pipeline = build_pipeline(replace(ms, trees=1, seed=ms.seed + tree), codes)
        pipeline.getStages()[-1].setBootstrap(False)
        return pipeline.fit(data.where(F.col("tree") == tree))
    with ThreadPoolExecutor(parallel) as pool:
        return SubsampledForest(list(pool.map(one, range(ms.trees))))


def score(model: PipelineModel, df: DataFrame, calibrator=None) -> DataFrame:
    """Adds flood_probability (P(class 1)) and flood_predicted (0/1).

    With an isotonic ``calibrator`` both are the calibrated ones: the class is 1 where the
    calibrated probability is above one half.
    """
    out = model.transform(df)
    keep = [F.col(f"`{c}`") for c in df.columns]
    out = out.select(*keep, vector_to_array("probability")[1].alias("flood_probability"),
                     F.col("prediction").cast("int").alias("flood_predicted"))
    if calibrator is not None:
        cal = calibrator.copy({calibrator.featuresCol: "flood_probability", calibrator.predictionCol: "_p_cal"})
        out = cal.transform(out).withColumn("flood_probability", F.col("_p_cal"))
        out = out.withColumn("flood_predicted", (F.col("_p_cal") > 0.5).cast("int")).drop("_p_cal")
    return out


def fit_calibrator(model: PipelineModel, train_df: DataFrame, label: str):
    """Isotonic map from forest probability to observed frequency, fitted on training rows."""
    from pyspark.ml.regression import IsotonicRegression
    tr = score(model, train_df).withColumn("_yy", F.col(label).cast("double"))
    return IsotonicRegression(featuresCol="flood_probability", labelCol="_yy", predictionCol="p_cal").fit(tr)


def save(model: PipelineModel, path: str, calibrator=None) -> None:
    """Forest pipeline at ``path``; with ``calibrator`` also ``path/calibrator`` (opt-in)."""
    model.write().overwrite().save(path)
    if calibrator is not None:
        calibrator.write().overwrite().save(f"{path.rstrip('/')}/calibrator")


def load(path: str, calibrated: bool = False):
    from pyspark.ml.regression import IsotonicRegressionModel
    model = PipelineModel.load(path)
    return model, (IsotonicRegressionModel.load(f"{path.rstrip('/')}/calibrator") if calibrated else None)


def importances(model: PipelineModel, spark) -> DataFrame:
    """Feature importances, one row per feature (bounded by the feature count), sorted."""
    names = model.stages[1].getInputCols()
    vals = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(names, vals)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


@dataclass
class TrainingResult:
    model: PipelineModel
    codes: list[int]
    train: DataFrame
    test: DataFrame
    test_scored: DataFrame


def prepare(samples: DataFrame, ms: ModelSettings, order_cols=("system:index",)) -> DataFrame:
    """dropna over every column, then stratified test split (``is_test``)."""
    from .collection import dropna_any
    clean = dropna_any(samples)
    return stratified_split(clean, ms.label, ms.test_fraction, ms.seed, list(order_cols))


def train(samples: DataFrame, ms: ModelSettings, order_cols=("system:index",)) -> TrainingResult:
    from ..session import cut_lineage
    # The sample table is bounded (classes x samples per class); checkpoint it so the
    # forest's many passes do not recompute the composites behind it.
    data = cut_lineage(prepare(samples, ms, order_cols))
    codes = fit_codes(data.where("is_test = 0"), ms.categorical, ms.max_codes)
    tr, te = data.where("is_test = 0"), data.where("is_test = 1")
    model = fit(tr, ms, codes)
    return TrainingResult(model, codes, tr, te, score(model, te))


def cross_validate(train_df: DataFrame, ms: ModelSettings, codes: list[int], order_cols=("system:index",)):
    """Per-fold ROC AUC with stratified folds; returns [(fold, auc)]."""
    folded = stratified_folds(train_df, ms.label, ms.folds, ms.seed, list(order_cols))
    out = []
    for f in range(ms.folds):
        m = fit(folded.where(F.col("fold") != f), ms, codes)
        scored = score(m, folded.where(F.col("fold") == f))
        out.append((f, MT.roc_auc(scored, ms.label, "flood_probability")))
    return out


def calibrated_auc(res: TrainingResult, ms: ModelSettings) -> tuple[float, float]:
    """Test AUC before and after isotonic calibration fitted on the training rows."""
    iso = fit_calibrator(res.model, res.train, ms.label)
    te = score(res.model, res.test, calibrator=iso)
    return (MT.roc_auc(res.test_scored, ms.label, "flood_probability"), MT.roc_auc(te, ms.label, "flood_probability"))
