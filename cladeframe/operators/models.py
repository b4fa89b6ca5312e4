"""Classifiers of sites: cleaning, germline detection, random forests with relaxed cuts. Spark ML, so training is distributed."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calls import SCDNA_LADDER, SCRNA_LADDER, class_decode
from .matrix import trimmed_cut


def clean_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Words become missing, infinities the greatest finite value, missing values the median of the column."""
    out = df.select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) if c in names else F.col(c) for c in df.columns])
    stats = out.agg(
        *[F.expr(f"median(CASE WHEN abs(`{c}`) < double('infinity') THEN `{c}` END)").alias(f"_md_{c}") for c in names],
        *[F.expr(f"max(CASE WHEN abs(`{c}`) < double('infinity') THEN `{c}` END)").alias(f"_mx_{c}") for c in names],
    )
    out = out.crossJoin(F.broadcast(stats))
    fixed = lambda c: F.expr(f"CASE WHEN `{c}` IS NULL OR isnan(`{c}`) THEN `_md_{c}` WHEN abs(`{c}`) = double('infinity') THEN `_mx_{c}` ELSE `{c}` END").alias(c)
    return out.select(*[fixed(c) if c in names else F.col(c) for c in df.columns])


def clean_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Without a numbered suffix, underscores and outer blanks."""
    return df.withColumn(label, F.trim(F.regexp_replace(F.regexp_replace(F.trim(label), "[.][0-9]+$", ""), "_", " ")))


def germline(scores: DataFrame, training: DataFrame, tested: str | None = None, fraction_stats: DataFrame | None = None) -> DataFrame:
    """mut, prob, germline. Logistic regression on FP_mean, FP_std, FP_cv (balanced weights) learnt from the other samples' labelled rows; the cut
    is `trimmed_cut` of the probabilities. A mutation with zero scores is no candidate and no germline; without candidates the result is
    all false."""
    features = ["fp_mean", "fp_std", "fp_cv"]
    known = training if tested is None else training.where(F.col("sampleid") != tested)
    known = known.withColumn("y", (F.col("label") == "germline").cast("double"))
    share = known.agg(F.avg("y").alias("s")).first()["s"]
    candidates = scores.where("fp_mean > 0 OR fp_std > 0")
    if share is None or share in (0.0, 1.0):
        return scores.select("mut", F.lit(0.0).alias("prob"), F.lit(False).alias("germline"))
    known = known.withColumn("w", F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="f"), LogisticRegression(featuresCol="f", labelCol="y", weightCol="w", regParam=0.01)]).fit(known)
    prob = model.transform(candidates).select("mut", vector_to_array("probability")[1].alias("prob"))
    cut = trimmed_cut(prob)
    out = prob.crossJoin(F.broadcast(cut)).select("mut", "prob", F.expr("coalesce(prob > cut, false)").alias("germline"))
    rest = scores.join(out.select("mut"), "mut", "left_anti").select("mut", F.lit(0.0).alias("prob"), F.lit(False).alias("germline"))
    return out.unionByName(rest)


def forest(training: DataFrame, features: list[str], label: str = "label", weights: dict[str, float] | None = None, trees: int = 1000, depth: int = 15, seed: int = 42) -> PipelineModel:
    """Median imputation, z scores, random forest with class weights."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col(label) == name, w).otherwise(weight)
    rows = training.select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in features], F.col(label).alias("label"), weight.alias("w"))
    filled = [f"{c}_filled" for c in features]
    return Pipeline(
        stages=[
            StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"),
            Imputer(inputCols=features, outputCols=filled, strategy="median"),
            VectorAssembler(inputCols=filled, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="f", withMean=True),
            RandomForestClassifier(featuresCol="f", labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed),
        ]
    ).fit(rows)


def classify(model: PipelineModel, rows: DataFrame, features: list[str], ladder: list[tuple[str, float]], key: str = "mut") -> DataFrame:
    """key, p_<class>, label by the relaxed ladder."""
    names = model.stages[0].labels
    typed = rows.select(key, *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in features])
    scored = PipelineModel(stages=model.stages[1:]).transform(typed).withColumn("_p", vector_to_array("probability"))
    out = scored.select(key, *[F.col("_p")[i].alias(f"p_{n}") for i, n in enumerate(names)])
    for missing in {c for c, _ in ladder} - set(names):
        out = out.withColumn(f"p_{missing}", F.lit(0.0))
    return class_decode(out, ladder)


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))


def scrna(training: DataFrame, rows: DataFrame, features: list[str], tested: str | None = None, trees: int = 1000) -> DataFrame:
    known = training if tested is None else training.where(F.col("sampleid") != tested)
    return classify(forest(known, features, weights={"mosaic": 1.0, "artifact": 0.8}, trees=trees), rows, features, SCRNA_LADDER)


def scdna(training: DataFrame, rows: DataFrame, features: list[str], trees: int = 1000) -> DataFrame:
    return classify(forest(training, features, weights={"mosaic": 1.0, "germline_het": 0.8, "repeat": 0.8}, trees=trees), rows, features, SCDNA_LADDER)
