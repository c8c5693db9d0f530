"""From the curated table to a chosen model with its evidence."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift import domain as D
from spindrift.models import estimators as E
from spindrift.models import lane
from spindrift.models import matrix as M
from spindrift.operators import splitting, stats
from spindrift.session import cut

#: Most models of the cross-validation in a batch, and MB of them (roughly, packed); three batches are held at a time.
HELD, HELD_MB = 64, 24
#: The same for the models that a task fits and scores itself.
OWN_HELD, OWN_MB = 10, 12
FEATURES = [*D.NUMERIC_FEATURES, *D.CATEGORICAL_FEATURES, *D.BINARY_FEATURES]


@dataclass
class Knobs:
    """Sizes of the work. trees caps the number of trees of every candidate (None: the locked numbers), fit_rows the rows of the fits."""

    families: tuple[str, ...] = tuple(D.COMPLEXITY)
    trees: int | None = None
    draws: int = 50
    folds: int = 5
    seeds: tuple[int, ...] = tuple(range(42, 52))
    curve: tuple[float, ...] = (0.2, 0.35, 0.5, 0.7, 0.85, 1.0)
    test_share: float = 0.2
    fit_rows: int | None = None  # None: fits use all rows of their training set
    seed: int = 42


@dataclass
class Prepared:
    rows: DataFrame  # all rows with Source_Stratum, Set, fold (null for test rows)
    sample: pd.DataFrame | lane.Kept  # training rows in drawn order: all of them, or the first fit_rows
    knobs: Knobs = field(default_factory=Knobs)


def _capped(p: dict, k: Knobs) -> dict:
    return p | {"n_estimators": min(p["n_estimators"], k.trees)} if k.trees and "n_estimators" in p else p


def candidates(k: Knobs) -> list[dict]:
    """One entry for each family and parameter point, in order of complexity."""
    out = []
    for f in sorted(k.families, key=D.COMPLEXITY.get):
        points = [D.LOCKED_PARAMS[f]] if f in D.LOCKED_PARAMS else splitting.draw_grid(D.SEARCH_SPACES[f], k.draws, k.seed)
        out += [{"family": f, "variant": i, "params": _capped(p, k)} for i, p in enumerate(points)]
    return out


def prepare(df: DataFrame, knobs: Knobs | None = None) -> Prepared:
    k = knobs or Knobs()
    df = df.filter(F.col(f"`{D.TARGET}`").isNotNull())
    s = splitting.stratified_split(splitting.strata(df, "Source_File"), "row_id", "Source_Stratum", k.test_share, k.seed)
    f = splitting.folds(s.filter("Set = 'Train'").select("row_id"), "row_id", k.folds, k.seed)
    rows = cut(s.join(f, "row_id", "left").withColumn("fold", F.col("fold").cast("string")))
    sample = lane.training_rows(rows.filter("Set = 'Train'"), "row_id", [*FEATURES, D.TARGET, "fold"], k.fit_rows, k.seed)
    return Prepared(rows, sample, k)


def _others(fold: int, n: int) -> list[str]:
    return [str(i) for i in range(n) if i != fold]


def _mb(task: dict, rows: int) -> float:
    """Roughly the packed size of a model, which also ranks the time of its fit."""
    p = task["params"]
    if "n_estimators" not in p:
        return 0.3
    most = rows / p.get("min_samples_leaf", 1)
    return p["n_estimators"] * min(most, 2.0 ** (1 + min(p.get("max_depth") or 60, 60))) * 13e-6


def _seconds(task: dict) -> float:
    """Roughly the time of a fit, which only orders the fits."""
    p = task["params"]
    return p["n_estimators"] * min(p.get("max_depth") or 10, 10) / 1000 if "n_estimators" in p else 0.6


def _batches(tasks: list[dict], rows: int, held: int = HELD, mb: float = HELD_MB) -> list[list[dict]]:
    """Every task once, in batches of at most `held` models; large and small ones are mixed, so that none is much above `mb`."""
    out = []
    for own in ([t for t in tasks if t["family"] == "SVR"], [t for t in tasks if t["family"] != "SVR"]):
        own = sorted(own, key=lambda t: -_mb(t, rows))
        n = max(math.ceil(len(own) / held), math.ceil(sum(_mb(t, rows) for t in own) / mb))
        dealt: list[list[dict]] = [[] for _ in range(n)]
        for t in own:  # to the lightest batch that has room
            min((b for b in dealt if len(b) < held), key=lambda b: (sum(_mb(x, rows) for x in b), len(b))).append(t)
        out += [b for b in dealt if b]
    return out


def cross_validate(p: Prepared) -> DataFrame:
    """(family, variant, fold, Train_R2, Validation_R2, CV_Gap, Validation_MAE, Validation_RMSE): fitted on the
    other folds, judged on all training rows."""
    k, spark = p.knobs, p.rows.sparkSession
    schema = "task_id string, fold string, n bigint, sy double, syy double, sse double, sae double"
    found = _judge(p, candidates(k), every=True)
    sums, part = spark.createDataFrame(found, schema), F.split("task_id", r"\|")
    sums = cut(sums.withColumn("side", F.when(F.col("fold") == part[2], "v").otherwise("t")))
    m = lane.metrics_of(sums, ["task_id", "side"])
    t, v = m.filter("side = 't'").select("task_id", F.col("R2").alias("Train_R2")), m.filter("side = 'v'")
    return t.join(v, "task_id").select(
        part[0].alias("family"), part[1].cast("int").alias("variant"), part[2].cast("int").alias("fold"), "Train_R2", F.col("R2").alias("Validation_R2"),
        (F.col("Train_R2") - F.col("R2")).alias("CV_Gap"), F.col("MAE").alias("Validation_MAE"), F.col("RMSE").alias("Validation_RMSE"),
    )


def _cv_tasks(k: Knobs, fold: int, points: list[dict]) -> list[dict]:
    return [{"task_id": f"{c['family']}|{c['variant']}|{fold}", "family": c["family"], "params": c["params"], "seed": k.seed, "where": ["fold", _others(fold, k.folds)], "on": str(fold)} for c in points]


def _judge(p: Prepared, points: list[dict], every: bool = False) -> list[tuple]:
    """(task_id, fold, n, sy, syy, sse, sae) of every model of every fold, judged on its own fold, or on every one. A model is
    scored in the task that fits it; where fits see fewer rows than there are (fit_rows) and those are too many to send, the models go to the rows."""
    k, spark = p.knobs, p.rows.sparkSession
    rows = None if k.fit_rows is None else p.rows.filter("fold is not null")
    count = len(p.sample) if rows is None else rows.count()
    if rows is None or count <= lane.SENT_ROWS:
        batches = []
        for i in range(k.folds):  # models of one fold share its encoding, and SVR models their distances
            tasks = _cv_tasks(k, i, points)
            svr = [t for t in tasks if t["family"] == "SVR"]
            each = len(svr) if len(p.sample) <= 5000 else 2  # long fits are spread
            batches += [svr[a : a + each] for a in range(0, len(svr), each or 1)] + _batches([t for t in tasks if t["family"] != "SVR"], len(p.sample), OWN_HELD, OWN_MB)
        found = lane.judge_tasks(spark, rows, p.sample, sorted(batches, key=lambda b: -sum(map(_seconds, b))), "fold", every=every)
    else:
        cores = spark.sparkContext.defaultParallelism
        rows = cut(rows.repartition(cores * max(1, math.ceil(count / (1 if every else k.folds) / (cores * 0.9 * lane.SCORED_ROWS))), "row_id"))  # each part is scored in one go
        work = [(i, b) for i in range(k.folds) for b in _batches(_cv_tasks(k, i, points), len(p.sample))]

        def judged(one: tuple[int, list]) -> list:
            sums = lane.score_sums(rows if every else rows.filter(F.col("fold") == str(one[0])), lane.fit_tasks(spark, p.sample, one[1]), "fold")
            return [tuple(r) for r in sums.collect()]  # one row a model and fold

        with ThreadPoolExecutor(3) as pool:  # fits of one batch go on while the last rows of another are scored
            found = [r for rows_of in pool.map(judged, work) for r in rows_of]
    if len({r[0] for r in found}) != k.folds * len(points) and count:
        raise RuntimeError("scores of some models are missing")
    return found


def validate(p: Prepared) -> DataFrame:
    """The validation figures of cross_validate, without the training side: every model of every fold is fitted as there and
    scores all rows of its own fold, which is all that the choice of the variants needs."""
    spark = p.rows.sparkSession
    found = [(r[0], *r[2:]) for r in _judge(p, candidates(p.knobs))]
    part = F.split("task_id", r"\|")
    found = [r for r in found if r[1]]  # a fold without rows judges nothing
    m = lane.metrics_of(spark.createDataFrame(found, "task_id string, n bigint, sy double, syy double, sse double, sae double"), ["task_id"])
    return cut(m.select(part[0].alias("family"), part[1].cast("int").alias("variant"), part[2].cast("int").alias("fold"), F.col("R2").alias("Validation_R2"), F.col("MAE").alias("Validation_MAE"), F.col("RMSE").alias("Validation_RMSE")))


def _with_train_side(p: Prepared, cv: DataFrame, points: list[dict]) -> DataFrame:
    """Rows of validate() for the given points, with Train_R2 and CV_Gap as in cross_validate, over all rows of the other folds."""
    spark = p.rows.sparkSession
    found = _judge(p, points, every=True)
    part = F.split("task_id", r"\|")
    sums = spark.createDataFrame(found, "task_id string, fold string, n bigint, sy double, syy double, sse double, sae double").filter(F.col("fold") != part[2])
    t = lane.metrics_of(sums, ["task_id"]).select(part[0].alias("family"), part[1].cast("int").alias("variant"), part[2].cast("int").alias("fold"), F.col("R2").alias("Train_R2"))
    return cut(cv.join(t, ["family", "variant", "fold"]).withColumn("CV_Gap", F.col("Train_R2") - F.col("Validation_R2")))


def compare(p: Prepared, cv: DataFrame) -> tuple[DataFrame, dict[str, dict]]:
    """(comparison, final models by family): the best variant of each family by mean validation R2, refitted on
    the training rows and judged on all rows; CV_Rank; the chosen row flagged. cv: of cross_validate, or of validate; the training
    side of the best variants, which alone is told, is then made here."""
    k, spark = p.knobs, p.rows.sparkSession
    params = {(c["family"], c["variant"]): c["params"] for c in candidates(k)}
    top = cv.groupBy("family", "variant").agg(F.avg("Validation_R2").alias("m")).groupBy("family").agg(F.max_by("variant", F.struct("m", -F.col("variant"))).alias("variant"))
    picked = {(r.family, r.variant) for r in top.collect()}  # one row a family
    tasks = [{"task_id": f, "family": f, "params": params[f, v], "seed": k.seed} for f, v in picked]

    def finals() -> tuple[dict[str, dict], DataFrame]:
        models = {m["task_id"]: m for m in lane.fit_tasks(spark, p.sample, tasks)}
        return models, cut(lane.score_sums(p.rows, list(models.values()), "Set"))  # one row a model and set

    cv = cv.filter(F.concat_ws("|", "family", "variant").isin([f"{f}|{v}" for f, v in picked]))
    with ThreadPoolExecutor(1) as pool:
        made = pool.submit(finals)
        if "Train_R2" not in cv.columns:
            cv = _with_train_side(p, cv, [c for c in candidates(k) if (c["family"], c["variant"]) in picked])
        final, sums = made.result()
    best = cv.groupBy("family", "variant").agg(
        F.avg("Validation_R2").alias("CV_R2_Mean"), F.stddev_samp("Validation_R2").alias("CV_R2_SD"), F.avg("Train_R2").alias("CV_Train_R2_Mean"), F.avg("CV_Gap").alias("CV_Gap_Mean"),
        F.stddev_samp("CV_Gap").alias("CV_Gap_SD"), F.avg("Validation_MAE").alias("CV_MAE_Mean"), F.avg("Validation_RMSE").alias("CV_RMSE_Mean"),
    ).collect()  # one row a family
    m = lane.metrics_of(sums, ["task_id", "Set"])
    wide = m.groupBy("task_id").pivot("Set", ["Train", "Test"]).agg(F.first("R2").alias("R2"), F.first("MAE").alias("MAE"), F.first("RMSE").alias("RMSE"))
    head = spark.createDataFrame(
        [(b.family, D.COMPLEXITY[b.family], *(b[c] for c in ("CV_R2_Mean", "CV_R2_SD", "CV_Train_R2_Mean", "CV_Gap_Mean", "CV_Gap_SD", "CV_MAE_Mean", "CV_RMSE_Mean")), E.params_text(params[b.family, b.variant])) for b in best],
        "Candidate string, Complexity_Rank int, CV_R2_Mean double, CV_R2_SD double, CV_Train_R2_Mean double, CV_Gap_Mean double, CV_Gap_SD double, CV_MAE_Mean double, CV_RMSE_Mean double, Best_Params string",
    )
    comp = cut(head.join(wide, head.Candidate == wide.task_id).drop("task_id").withColumn("Train_Test_R2_Gap", F.col("Train_R2") - F.col("Test_R2")))
    chosen = stats.select_model(comp).first()["Candidate"]
    order = sorted((r for r in comp.select("Candidate", "CV_R2_Mean").collect()), key=lambda r: -r.CV_R2_Mean)
    rank = spark.createDataFrame([(r.Candidate, 1 + sum(x.CV_R2_Mean > r.CV_R2_Mean for x in order)) for r in order], "Candidate string, CV_Rank int")
    return comp.join(rank, "Candidate").withColumn("Selected", F.col("Candidate") == chosen), final


def holdout(p: Prepared, model: dict) -> DataFrame:
    keep = ["row_id", "Source_File", "Canonical_Catalyst_ID", "Catalyst", "Set", D.TARGET]
    s = lane.score(p.rows, [model], keep)
    e = F.col("Predicted") - F.col(f"`{D.TARGET}`")
    return s.select(*keep[:-1], F.col(f"`{D.TARGET}`").alias("Actual"), "Predicted", e.alias("Residual"), F.abs(e).alias("Abs_Residual"))


def stability(df: DataFrame, family: str, params: dict, knobs: Knobs) -> DataFrame:
    """(Split_Seed, Train_n, Test_n, Train_Sources, Test_Sources, metrics): a fresh split and fit for each seed."""
    base = splitting.strata(df.filter(F.col(f"`{D.TARGET}`").isNotNull()), "Source_File")

    def one(s: int) -> DataFrame:
        rows = cut(splitting.stratified_split(base, "row_id", "Source_Stratum", knobs.test_share, s))
        sample = lane.training_rows(rows.filter("Set = 'Train'"), "row_id", [*FEATURES, D.TARGET], knobs.fit_rows, s)
        models = lane.fit_tasks(df.sparkSession, sample, [{"task_id": str(s), "family": family, "params": _capped(params, knobs), "seed": s}])
        m = lane.metrics_of(lane.score_sums(rows, models, "Set"), ["Set"]).groupBy().pivot("Set", ["Train", "Test"]).agg(F.first("n").alias("n"), F.first("R2").alias("R2"), F.first("MAE").alias("MAE"), F.first("RMSE").alias("RMSE"))
        n = rows.groupBy().pivot("Set", ["Train", "Test"]).agg(F.count_distinct("Source_File").alias("Sources"), F.count(F.lit(1)).alias("rows")).select("Train_Sources", "Test_Sources")
        return cut(m.crossJoin(n).select(F.lit(s).alias("Split_Seed"), "Train_n", "Test_n", "Train_Sources", "Test_Sources", "Train_R2", "Test_R2", "Test_MAE", "Test_RMSE", (F.col("Train_R2") - F.col("Test_R2")).alias("Train_Test_R2_Gap")))  # one row each

    with ThreadPoolExecutor(4) as pool:  # seeds share the cluster
        return reduce(DataFrame.unionByName, pool.map(one, knobs.seeds))


def learning_curve(p: Prepared, family: str, params: dict) -> DataFrame:
    """(Train_Size, Train_R2_Mean, Train_R2_SD, Validation_R2_Mean, Validation_R2_SD) over folds, shuffled prefixes
    of the other folds' rows."""
    k, spark = p.knobs, p.rows.sparkSession
    tasks, sizes = [], {}
    held = p.sample["fold"].value_counts().to_dict() if k.fit_rows else dict(p.rows.filter("fold is not null").groupBy("fold").count().collect())  # one row a fold
    for i in range(k.folds):
        n = int(sum(held.get(o, 0) for o in _others(i, k.folds)))
        for share, size in zip(k.curve, splitting.subset_sizes(n, list(k.curve))):
            if size:
                sizes[f"{share}|{i}"] = size
                tasks.append({"task_id": f"{share}|{i}", "family": family, "params": _capped(params, k), "seed": k.seed, "where": ["fold", _others(i, k.folds)], "first": size, "own": True})
    models = lane.fit_tasks(spark, p.sample, tasks)
    part = F.split("task_id", r"\|")
    v = lane.metrics_of(lane.score_sums(p.rows.filter("fold is not null"), models, "fold", only={t["task_id"]: t["task_id"].split("|")[1] for t in tasks}), ["task_id"]).withColumnRenamed("R2", "v")
    own = spark.createDataFrame([(m["task_id"], sizes[m["task_id"]], m["own"]) for m in models], "task_id string, size int, t double")
    return v.join(own, "task_id").groupBy(part[0].cast("double").alias("share")).agg(
        F.max("size").alias("Train_Size"), F.avg("t").alias("Train_R2_Mean"), F.stddev_samp("t").alias("Train_R2_SD"), F.avg("v").alias("Validation_R2_Mean"), F.stddev_samp("v").alias("Validation_R2_SD")
    ).drop("share")


def importances(spark, model: dict) -> DataFrame:
    names = M.matrix_names(M.loads(model["encoder"]))
    v = E.importances(E.from_bytes(model["model"]), len(names))
    return spark.createDataFrame([(n, float(x)) for n, x in zip(names, v)], "Feature string, Importance double")


def gate(comparison: DataFrame, stability_table: DataFrame, r2: float = 0.70, gap: float = 0.15) -> DataFrame:
    """One row: the chosen candidate, its figures and whether each threshold holds."""
    s = stability_table.agg(F.avg("Test_R2").alias("Seed_R2_Mean"), F.avg("Train_Test_R2_Gap").alias("Seed_Gap_Mean"))
    one = comparison.filter("Selected").select("Candidate", "Test_R2").crossJoin(F.broadcast(s))  # one row each
    return one.select("Candidate", "Test_R2", "Seed_R2_Mean", "Seed_Gap_Mean", stats.acceptance(F.col("Test_R2"), F.col("Seed_R2_Mean"), F.col("Seed_Gap_Mean"), r2, gap).alias("g")).select("Candidate", "Test_R2", "Seed_R2_Mean", "Seed_Gap_Mean", "g.*")


def distributed_boosting(df: DataFrame, trees: int = 20, depth: int = 3, seed: int = 42):
    """The lane for one large fit: exact encoding and boosting over all rows of the cluster, on sparse rows."""
    from spindrift.models import boosting
    from spindrift.operators.encode import FeatureEncoder

    enc = FeatureEncoder(D.NUMERIC_FEATURES, D.CATEGORICAL_FEATURES, D.BINARY_FEATURES).fit(df)
    ready = enc.transform_sparse(df).select("row_id", "features", F.col(f"`{D.TARGET}`").alias("label"))
    ready, names = cut(ready.filter("label is not null")), enc.names
    return boosting.fit(ready, len(enc.numeric), len(enc.binary), len(names), trees, depth, 0.1, 0.75, seed), ready, names


def encoded(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """((row_id, features, label) of the rows with a target, names): the exact encoding as sparse vectors of pyspark.ml, which
    hold as many entries as there are columns of the table, not categories."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    from spindrift.operators.encode import FeatureEncoder

    enc = FeatureEncoder(D.NUMERIC_FEATURES, D.CATEGORICAL_FEATURES, D.BINARY_FEATURES).fit(df)
    vector = F.udf(lambda f: SparseVector(f[0], f[1], f[2]), VectorUDT())
    ready = enc.transform_sparse(df, "__f").select("row_id", vector("__f").alias("features"), F.col(f"`{D.TARGET}`").alias("label"))
    return cut(ready.filter("label is not null")), enc.names


def linear(df: DataFrame, l2: float = 1.0, l1_share: float = 0.0, made: tuple[DataFrame, list[str]] | None = None):
    """Ridge (l1_share 0) or elastic net by pyspark.ml over all rows, on the exact encoding (made: that of an earlier call)."""
    from pyspark.ml.regression import LinearRegression

    ready, names = made or encoded(df)
    return LinearRegression(regParam=l2, elasticNetParam=l1_share, standardization=False).fit(ready), ready, names
