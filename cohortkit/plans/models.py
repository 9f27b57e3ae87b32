"""Model training and evaluation on Spark ML.

Trainers are distributed Spark ML estimators; the search (``search.py``)
scores a seeded sample of the grid by the AUROC of stratified folds (M4).  The additive boosted model is re-aimed as
depth-limited gradient boosting (depth 1 = additive in single features);
the SVM is linear (kernel SVMs have no distributed form here).
"""

from __future__ import annotations

import itertools
import json
import random
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .metrics import auroc_ap
from .search import best_candidates, search
from .split import stratified_folds


def fit_preprocessor(train: DataFrame, categorical: Sequence[str], continuous: Sequence[str],
                     scale: bool = False, encode: bool = True) -> PipelineModel:
    """M1: categoricals mode-imputed (+ ordinal codes, alphabetical, unseen
    -> -1); continuous mean-imputed (+ standardised with the population
    std).  Fitted statistics come from one aggregate over ``train``."""
    stats_exprs = [F.mode(F.col(c).cast("string"), True).alias(f"m_{c}") for c in categorical]
    stats_exprs += [F.avg(F.col(c).cast("double")).alias(f"a_{c}") for c in continuous]
    stats_exprs += [F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in continuous]
    st = train.agg(*stats_exprs).first().asDict() if stats_exprs else {}

    def q(v):
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    sel = ["*"]
    for c in categorical:
        sel.append(f"coalesce(CAST(`{c}` AS STRING), {q(st[f'm_{c}'])}) AS `__cat_{c}`")
    for c in continuous:
        mean = st[f"a_{c}"] if st[f"a_{c}"] is not None else 0.0
        expr = f"coalesce(CAST(`{c}` AS DOUBLE), {mean!r})"
        if scale:
            sd = st[f"s_{c}"] or 1.0
            expr = f"(({expr}) - {mean!r}) / {sd!r}"
        sel.append(f"{expr} AS `__num_{c}`")
    stages: list[Transformer] = [SQLTransformer(statement=f"SELECT {', '.join(sel)} FROM __THIS__")]
    feats = [f"__num_{c}" for c in continuous]
    if encode and categorical:
        idx = StringIndexer(inputCols=[f"__cat_{c}" for c in categorical],
                            outputCols=[f"__idx_{c}" for c in categorical],
                            stringOrderType="alphabetAsc", handleInvalid="keep")
        fitted = idx.fit(SQLTransformer(statement=stages[0].getStatement()).transform(train))
        stages.append(fitted)
        fix = ["*"] + [f"CASE WHEN `__idx_{c}` >= {len(lbls)} THEN -1.0 ELSE `__idx_{c}` END AS `__ord_{c}`"
                       for c, lbls in zip(categorical, fitted.labelsArray)]
        stages.append(SQLTransformer(statement=f"SELECT {', '.join(fix)} FROM __THIS__"))
        feats = [f"__ord_{c}" for c in categorical] + feats
    stages.append(VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep"))
    return PipelineModel(stages=stages)


# Search spaces (translated to Spark ML parameters).
RF_GRID = {"numTrees": [100, 200, 500], "maxDepth": [30, 10, 20], "minInstancesPerNode": [1, 2, 5],
           "featureSubsetStrategy": ["sqrt", "log2"]}
GBT_GRID = {"maxDepth": [1, 2, 3], "stepSize": [0.01, 0.05, 0.1], "maxIter": [50, 100]}
SVM_GRID = {"regParam": [100.0, 10.0, 1.0, 0.1, 0.01], "maxIter": [100]}

MODEL_CONFIGS = [
    {"name": "additive_boosting", "estimator": GBTClassifier, "grid": GBT_GRID, "n_iter": 20, "scale": False},
    {"name": "random_forest", "estimator": RandomForestClassifier, "grid": RF_GRID, "n_iter": 30, "scale": False,
     "params": {"cacheNodeIds": True}},  # the same trees: rows keep their nodes, else go down every tree from its root for each level
    {"name": "svm", "estimator": LinearSVC, "grid": SVM_GRID, "n_iter": 20, "scale": True},
]


def sample_grid(est, grid: dict, n_iter: int, seed: int) -> list[dict]:
    """Seeded random subset of the full grid (at most its size)."""
    keys = sorted(grid)
    combos = list(itertools.product(*[grid[k] for k in keys]))
    rnd = random.Random(seed)
    picked = rnd.sample(combos, min(n_iter, len(combos)))
    return [{est.getParam(k): v for k, v in zip(keys, vals)} for vals in picked]


def positive_score(df: DataFrame) -> DataFrame:
    """Score of class 1: probability when the model has one, else margin."""
    if "probability" in df.columns:
        return df.withColumn("y_pred", vector_to_array("probability")[1])
    return df.withColumn("y_pred", vector_to_array("rawPrediction")[1])


def run_cv_and_final_train(train: DataFrame, holdout: DataFrame, target: str, id_col: str,
                           categorical: Sequence[str], continuous: Sequence[str], config: dict,
                           n_folds: int = 5, seed: int = 42, parallelism: int = 4, store: str | None = None) -> dict:
    """M5: preprocessing fitted on train, seeded search of ``n_iter``
    candidates (the whole grid when it has no more) scored by the AUROC of
    stratified folds, refit on all of train, holdout AUROC / AP.

    Results of the search go to ``store``, where a second run finds them."""
    pre = fit_preprocessor(train, categorical, continuous, scale=config["scale"])
    # The search scans the training frame once per fold, candidate and
    # boosting round: store it once (stage boundary) instead of replaying
    # the feature plan every time.
    tr = cut_lineage(stratified_folds(pre.transform(train).withColumn("label", F.col(target).cast("double")),
                                      "label", id_col, n_folds, seed).select(id_col, "features", "label", "fold"))
    est = config["estimator"](featuresCol="features", labelCol="label", **config.get("params", {}),
                              **({"seed": seed} if config["estimator"] is not LinearSVC else {}))
    grid = sample_grid(est, config["grid"], config["n_iter"], seed)
    store = store or f"{ensure_checkpoint_dir(train.sparkSession)}/search-{uuid.uuid4().hex}"
    found = search(tr, {config["name"]: (est, grid)}, store, n_folds, parallelism)
    top = best_candidates(found.where(F.col("model") == config["name"]), n_folds).first()
    best = est.copy(grid[top["candidate"]]).fit(tr)
    scored = positive_score(best.transform(pre.transform(holdout))).withColumn("label", F.col(target))
    m = auroc_ap(scored, "label", "y_pred").first()
    return {"model_name": config["name"],
            "best_params": json.loads(top["params"]), "n_candidates": top["n_candidates"], "search_seconds": top["seconds"],
            "cv_auroc": top["cv_auroc"], "holdout_auroc": m["auroc"], "holdout_auprc": m["ap"],
            "n_train": tr.count(), "n_holdout": m["n"], "n_positive_holdout": m["n_positive"],
            "pipeline": PipelineModel(stages=[*pre.stages, best])}


def check_class_diversity(df: DataFrame, target: str) -> None:
    """M9 guard: both classes must be present."""
    if df.select(target).distinct().count() < 2:
        raise ValueError("target has a single class; cannot train")


def train_models(dataset: DataFrame, cfg: dict, categorical: Sequence[str], continuous: Sequence[str],
                 out_dir: str | None = None, configs: Sequence[dict] = MODEL_CONFIGS,
                 return_pipelines: bool = False, store: str | None = None, **kw):
    """M9: split by PID, guard classes, fit every configured model, save
    the pipelines and return one summary row per model (S13) -- plus the
    fitted pipelines by name when ``return_pipelines``.  With a ``store`` a
    second run reads the search results of the first.

    The models are trained at the same time: a fit of boosting or of the SVM is
    a chain of hundreds of short jobs that leaves most cores idle."""
    from .split import train_test_split
    target, id_col = cfg["target"], cfg["dataset"]["id_col"]
    train, holdout = train_test_split(cfg, cut_lineage(dataset))
    check_class_diversity(train, target)

    def train_one(c: dict) -> dict:
        r = run_cv_and_final_train(train, holdout, target, id_col, categorical, continuous, c, store=store, **kw)
        if out_dir:
            r["pipeline"].write().overwrite().save(f"{out_dir}/{c['name']}")
        return r

    with ThreadPoolExecutor(max(1, len(configs))) as pool:
        done = [f.result() for f in [pool.submit(inheritable_thread_target(dataset.sparkSession)(train_one), c) for c in configs]]
    pipes = {c["name"]: r["pipeline"] for c, r in zip(configs, done)}
    rows = [{k: v for k, v in r.items() if k != "pipeline"} for r in done]
    return (rows, pipes) if return_pipelines else rows


def evaluate_at(model: PipelineModel, dataset: DataFrame, target: str, id_col: str,
                masking_point: str, time_min: float | None) -> tuple[dict | None, DataFrame]:
    """Score one masking point; metrics are None when one class."""
    scored = positive_score(model.transform(dataset))
    preds = scored.select(F.col(id_col), F.col(target).cast("int").alias("y_true"), "y_pred",
                          F.lit(masking_point).alias("masking_point"),
                          F.lit(time_min).cast("double").alias("time_min"),
                          (F.lit(time_min) / 60.0).cast("double").alias("time_hours"),
                          (F.lit(time_min) / 1440.0).cast("double").alias("time_days"))
    if preds.select("y_true").distinct().count() < 2:
        return None, preds
    m = auroc_ap(preds, "y_true", "y_pred").first().asDict()
    m["masking_point"] = masking_point
    return m, preds
