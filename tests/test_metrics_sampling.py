import math

from pyspark.sql import functions as F

from deluge.operators import metrics as MT
from deluge.operators import sampling as S


def test_golden_classification_report(spark):
    rows = [(0, 0)] * 704 + [(0, 1)] * 46 + [(1, 0)] * 3 + [(1, 1)] * 747
    df = spark.createDataFrame(rows, "y int, p int")
    cm = {r.truth: (r.pred_0, r.pred_1) for r in MT.confusion_matrix(df, "y", "p").collect()}
    assert cm == {0: (704, 46), 1: (3, 747)}
    rep = {r.label: r for r in MT.classification_report(df, "y", "p").collect()}
    r3 = lambda v: round(v, 3)
    assert (r3(rep["0"].precision), r3(rep["0"].recall), r3(rep["0"].f1_score), rep["0"].support) == (0.996, 0.939, 0.966, 750)
    assert (r3(rep["1"].precision), r3(rep["1"].recall), r3(rep["1"].f1_score), rep["1"].support) == (0.942, 0.996, 0.968, 750)
    assert r3(rep["accuracy"].f1_score) == 0.967
    assert (r3(rep["macro avg"].precision), r3(rep["macro avg"].recall), r3(rep["macro avg"].f1_score)) == (0.969, 0.967, 0.967)
    assert (r3(rep["weighted avg"].precision), r3(rep["weighted avg"].f1_score)) == (0.969, 0.967)


def test_auc_frame_matches_evaluator_with_ties(spark):
    rows = [(i % 2, float(i % 7)) for i in range(200)] + [(1, 9.0)] * 5
    df = spark.createDataFrame(rows, "y int, s double")
    a = MT.roc_auc(df, "y", "s")
    b = MT.roc_auc_frame(df, "y", "s").first()[0]
    assert abs(a - b) < 1e-12


def test_round_half_even_percentage(spark):
    df = spark.createDataFrame([(1, 32)], "f long, t long")
    v = df.select(F.bround(F.try_divide(F.col("f"), F.col("t")) * 100, 2)).first()[0]
    assert v == 3.12


def test_stratified_sample_sizes_and_determinism(spark):
    df = spark.range(0, 20000).select((F.col("id") % 7 == 0).cast("int").alias("cls"), F.col("id").alias("k"))
    a = S.stratified_sample(df, "cls", 500, 42, ["k"])
    counts = {r.cls: r["count"] for r in a.groupBy("cls").count().collect()}
    assert counts == {0: 500, 1: 500}
    b = S.stratified_sample(df, "cls", 500, 42, ["k"])
    assert sorted(r.k for r in a.collect()) == sorted(r.k for r in b.collect())
    small = S.stratified_sample(df.where("k < 30"), "cls", 500, 42, ["k"])
    assert small.count() == 30


def test_split_and_folds_exact(spark):
    df = spark.range(0, 1003).select((F.col("id") % 2).cast("int").alias("cls"), F.col("id").alias("k"))
    sp = S.stratified_split(df, "cls", 0.25, 42, ["k"])
    got = {(r.cls, r.is_test): r["count"] for r in sp.groupBy("cls", "is_test").count().collect()}
    assert got[(0, 1)] == math.ceil(502 * 0.25) and got[(1, 1)] == math.ceil(501 * 0.25)
    f = S.stratified_folds(sp.where("is_test = 0"), "cls", 5, 42, ["k"])
    sizes = [r["count"] for r in f.groupBy("cls", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_stratified_sample_shortfall_retry_is_exact(spark, monkeypatch):
    df = spark.range(0, 30000).select((F.col("id") % 3 == 0).cast("int").alias("cls"), F.col("id").alias("k"))
    want = sorted(r.k for r in S.stratified_sample(df, "cls", 700, 7, ["k"]).collect())
    monkeypatch.setattr(S, "_margin", lambda n: n * 0.3)  # forces every class short on the first pass
    got = sorted(r.k for r in S.stratified_sample(df, "cls", 700, 7, ["k"]).collect())
    assert got == want and len(got) == 1400
