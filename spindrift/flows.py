"""Queries of the whole flows: curation, model evidence, attribution, search, projection.

Trees, draws, seeds, folds and iterations are the plans' defaults, the locked ones;
rows are never left out: fits use all rows of their training set, everything else all rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift import domain as D
from spindrift import sinks
from spindrift.models import lane
from spindrift.models import matrix as M
from spindrift.operators import stats
from spindrift.operators.encode import FeatureEncoder
from spindrift.operators.splitting import draw_grid
from spindrift.plans import curate as C
from spindrift.plans import explain, project, search
from spindrift.plans import train as T
from spindrift.session import cut, shared_folder
from spindrift.sources import records
from spindrift.tables import load

Q = Callable[[SparkSession, str], DataFrame]
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "dataset_all", "ni_model_primary", "split_manifest", "exclusion_log",
    "support_dim", "promoter_dim", "canonical_values", "split_targets", "mix_targets",
)
_ALL: dict[str, Q] = {}

_KNOBS = T.Knobs()
_GB = ("Gradient Boosting", D.LOCKED_PARAMS["Gradient Boosting"])


def flow(f: Q) -> Q:
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Q]:
    return dict(_ALL)


#: What several queries of one session share: the fits of one table are made once. Models and scores only, never rows.
_MADE: dict[tuple, object] = {}


def _once(spark: SparkSession, d: str, what: str, make: Callable[[], object]) -> object:
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def _curated(spark: SparkSession, d: str) -> C.Curated:
    return C.curate(load(spark, d, "dataset_all"))


def _primary(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "ni_model_primary")


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles are compared after rounding; minus zero is zero."""
    return df.select(*((F.round(F.col(f"`{f.name}`"), 6) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields))


@flow
def curate_primary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_curated(spark, d).primary)


@flow
def curate_comparison(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_curated(spark, d).comparison)


@flow
def curate_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return _curated(spark, d).exclusions


@flow
def curate_features(spark: SparkSession, d: str) -> DataFrame:
    """Keys, model features and replicate columns of the curated table."""
    p = _curated(spark, d).primary
    num = [c for c in (*D.NUMERIC_FEATURES, D.TARGET, "Catalyst_Label_Ni_Value", "Replicate_Target_Range") if c != "support_acid_base"]
    whole = ["row_id", "raw_row_id", *D.CATEGORICAL_FEATURES, "has_promoter", "prom_missing", "support_reducible", "support_acid_base", "Catalyst_Key", "Replicate_Count", "Original_Row_IDs"]
    return p.select(*whole, *((F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) for c in num))


@flow
def curate_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Raw records by where they ended up; the counts add up to the raw table."""
    c = _curated(spark, d)
    parts = [c.exclusions.groupBy(F.col("Reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n")), c.comparison.agg(F.lit("comparison").alias("outcome"), F.count(F.lit(1)).alias("n")), c.primary.agg(F.lit("primary").alias("outcome"), F.coalesce(F.sum("Replicate_Count"), F.lit(0)).alias("n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@flow
def curate_manifest(spark: SparkSession, d: str) -> DataFrame:
    return C.manifest(load(spark, d, "dataset_all"), _curated(spark, d))


@flow
def curate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each stage of the curation."""
    c, out = _curated(spark, d), None
    for name, df in (("raw", load(spark, d, "dataset_all")), ("all_clean", c.all_clean), ("comparison", c.comparison), ("primary", c.primary), ("collisions", c.collisions), ("exclusions", c.exclusions)):
        one = df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@flow
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The raw table written as CSV and read back: cells with line breaks, quotes and outer white space, null tokens."""
    raw, folder = load(spark, d, "dataset_all"), shared_folder(spark)
    sinks.write_tables({"dataset_all": raw.withColumn("raw_row_id", F.col("raw_row_id").cast("string"))}, folder, "csv")
    back = records.read_csv(spark, f"{folder}/dataset_all", raw.columns)
    return back.select(*(F.col(f"`{c}`").cast("long").alias(c) if c == "raw_row_id" else F.col(f"`{c}`") for c in ["raw_row_id", *D.TEXT_COLUMNS, *D.FLAG_COLUMNS, *D.VALID_RANGES]))


@flow
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A one-row summary written as a JSON document and read back."""
    path = f"{shared_folder(spark)}/summary.json"
    one = _primary(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("Source_File").alias("n_sources"), F.max("Reaction_Temp_C").alias("hottest"), F.max("Promoter_Metal").alias("last_promoter"))
    sinks.write_document(json.loads(sinks.to_document(one)), path)
    return records.read_json(spark, path, "n_rows long, n_sources long, hottest double, last_promoter string")


@flow
def report_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A report of the records of each split, one line each, read back as text."""
    path = f"{shared_folder(spark)}/report.md"
    lines = [f"- {r['Set']}: {r['n']}" for r in load(spark, d, "split_manifest").groupBy("Set").agg(F.count(F.lit(1)).alias("n")).orderBy("Set").collect()]  # one row a split
    sinks.write_report("Splits", lines, path)
    return spark.read.text(path).toDF("line")


@flow
def vector_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as a matrix and read back, in long form."""
    path = f"{shared_folder(spark)}/vectors"
    sinks.write_vectors(load(spark, d, "embeddings"), path, "vec_id", "embedding")
    v = records.read_vectors(spark, path, "vec_id", "embedding")
    return v.select("vec_id", F.posexplode("embedding").alias("component", "value")).withColumn("value", F.round("value", 5) + F.lit(0.0))


@flow
def gated_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Accepted results replace what stands, refused ones leave it: read back after one of each."""
    folder = shared_folder(spark)
    target, review = f"{folder}/promoted", f"{folder}/review.json"
    for name, accepted in (("nation", True), ("region", True), ("nation", False)):
        sinks.promote(lambda to, n=name: load(spark, d, n).write.mode("overwrite").parquet(to), target, accepted, {"refused": name}, review)
    kept = spark.read.parquet(target)
    return kept.select("r_regionkey", "r_name", F.lit(json.load(open(review))["refused"]).alias("refused"))


@flow
def table_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Row count and order-free fingerprint of every table."""
    out = None
    for t in TABLES:
        one = records.table_hash(load(spark, d, t)).withColumn("table_name", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


@flow
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    return records.file_hash(spark, f"{d}/promoter_dim.parquet").select("sha256")


@flow
def random_box(spark: SparkSession, d: str) -> DataFrame:
    """2,500 seeded points in the box of the adaptive bounds."""
    b = stats.adaptive_bounds(_primary(spark, d), {c: D.VALID_RANGES[c] for c in D.SEARCH_COLUMNS}).collect()  # one row a column
    return records.random_box(spark, 2500, {r.Parameter: (r.Lower, r.Upper) for r in b})


@flow
def grid_draws(spark: SparkSession, d: str) -> DataFrame:
    """Fifty points of each search grid, drawn without repetition."""
    rows = [(f, i, str(sorted(p.items()))) for f, s in D.SEARCH_SPACES.items() for i, p in enumerate(draw_grid(s, 50))]
    return spark.createDataFrame(rows, "family string, variant int, params string")


@flow
def encoded_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The model matrix, fitted on training rows and applied to all; sparse, as most entries are zeros of categories."""
    p = T.prepare(_primary(spark, d), _KNOBS)
    enc = FeatureEncoder(D.NUMERIC_FEATURES, D.CATEGORICAL_FEATURES, D.BINARY_FEATURES).fit(p.rows.filter("Set = 'Train'"))
    return enc.transform_sparse(p.rows).select("row_id", "Set", "features.*")


def _prepared(spark: SparkSession, d: str) -> T.Prepared:
    return _once(spark, d, "prepared", lambda: T.prepare(_primary(spark, d), _KNOBS))


def _validated(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all candidates: one row for each fit."""
    rows, schema = _once(spark, d, "cv", lambda: (lambda df: (df.collect(), df.schema))(T.cross_validate(_prepared(spark, d))))
    return spark.createDataFrame(rows, schema)


@flow
def model_cv(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d)


def _compared(spark: SparkSession, d: str) -> DataFrame:
    """From the scores of model_cv if the session has them; else from the validation side alone."""
    has = (spark.sparkContext.applicationId, d, "cv") in _MADE
    return _once(spark, d, "comparison", lambda: T.compare(_prepared(spark, d), _validated(spark, d) if has else T.validate(_prepared(spark, d)))[0])


@flow
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d)


def _fitted(spark: SparkSession, d: str):
    p = _prepared(spark, d)
    task = {"task_id": "gb", "family": _GB[0], "params": T._capped(_GB[1], _KNOBS), "seed": 42}
    return p, _once(spark, d, "gb", lambda: lane.fit_tasks(spark, p.sample, [task])[0])


def _stability(spark: SparkSession, d: str) -> DataFrame:
    rows, schema = _once(spark, d, "stability", lambda: (lambda df: (df.collect(), df.schema))(T.stability(_primary(spark, d), *_GB, _KNOBS)))  # one row a seed
    return spark.createDataFrame(rows, schema)


@flow
def model_gbt_predict(spark: SparkSession, d: str) -> DataFrame:
    """Hold-out table: actual, predicted and residual of every row."""
    return T.holdout(*_fitted(spark, d))


@flow
def model_importances(spark: SparkSession, d: str) -> DataFrame:
    return T.importances(spark, _fitted(spark, d)[1])


@flow
def model_stability(spark: SparkSession, d: str) -> DataFrame:
    return _stability(spark, d)


@flow
def model_stability_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary(_stability(spark, d), ["Train_R2", "Test_R2", "Test_MAE", "Test_RMSE", "Train_Test_R2_Gap"])


@flow
def model_learning_curve(spark: SparkSession, d: str) -> DataFrame:
    return T.learning_curve(_prepared(spark, d), *_GB)


@flow
def model_gate(spark: SparkSession, d: str) -> DataFrame:
    with ThreadPoolExecutor(1) as pool:  # the seeds fill what the fits leave free
        seeds = pool.submit(_stability, spark, d)
        return T.gate(_compared(spark, d), seeds.result())


@flow
def model_distributed_boosting(spark: SparkSession, d: str) -> DataFrame:
    """Boosting on every row of the primary table."""
    model, ready, _ = T.distributed_boosting(_primary(spark, d))
    return model.transform(ready).select("row_id", F.col("label").alias("Actual"), F.col("prediction").alias("Predicted"))


@flow
def model_linear(spark: SparkSession, d: str) -> DataFrame:
    """Ridge and elastic net on every row of the primary table: metrics of both."""
    out, made = None, T.encoded(_primary(spark, d))
    for name, share in (("Ridge", 0.0), ("ElasticNet", 0.5)):
        model, ready, _ = T.linear(_primary(spark, d), 0.5, share, made)
        m = stats.regression_metrics(model.transform(ready).withColumn("Model", F.lit(name)), "label", "prediction", ["Model"])
        out = m if out is None else out.unionByName(m)
    return out


@flow
def treeshap_additivity(spark: SparkSession, d: str) -> DataFrame:
    """Shapley sums of every row against its prediction; error stays at rounding size."""
    p, m = _fitted(spark, d)
    a = explain.attributions(p.rows, m, explain.shown(m))
    total = F.aggregate("shap", F.lit(0.0), lambda x, y: x + y)
    return a.select("row_id", "prediction", (F.col("base") + total).alias("explained"), (F.abs(F.col("prediction") - F.col("base") - total) < 1e-6).alias("additive"))


def _long(spark: SparkSession, d: str):
    p, m = _fitted(spark, d)
    names, own = M.matrix_names(M.loads(m["encoder"])), explain.shown(m)
    long = explain.long_form(explain.attributions(p.rows, m, own), [names[i] for i in own])
    return p, long, [n for i, n in enumerate(names) if i not in set(own)]


@flow
def shap_ranking(spark: SparkSession, d: str) -> DataFrame:
    _, long, zeros = _long(spark, d)
    return explain.ranking(long, zeros)


@flow
def shap_top_sources(spark: SparkSession, d: str) -> DataFrame:
    return explain.top_sources(_long(spark, d)[1])


@flow
def shap_dependence(spark: SparkSession, d: str) -> DataFrame:
    p, long, _ = _long(spark, d)
    return explain.dependence_sources(long, p.rows)


@flow
def shap_wide(spark: SparkSession, d: str) -> DataFrame:
    p, m = _fitted(spark, d)
    own, enc = explain.shown(m), M.loads(m["encoder"])
    return explain.wide_audit(explain.attributions(p.rows, m, own), M.matrix_names(enc), own, explain.columns_of(enc))


@flow
def ablation_cv(spark: SparkSession, d: str) -> DataFrame:
    return explain.ablation(_prepared(spark, d), *_GB)


def _searched(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of the search: a fixed number, whatever the table's size."""

    def make() -> DataFrame:
        p, m = _fitted(spark, d)
        return cut(search.search(spark, search.build_space(p.rows), m))

    return _once(spark, d, "search", make)


@flow
def eligible_families(spark: SparkSession, d: str) -> DataFrame:
    return search.eligible_families(_primary(spark, d))


@flow
def operating_assumptions(spark: SparkSession, d: str) -> DataFrame:
    a = search.assumptions(_primary(spark, d))
    return spark.createDataFrame([tuple(a.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in a.items()))


@flow
def pso_search(spark: SparkSession, d: str) -> DataFrame:
    """Swarm and random candidates (2,500 for each temperature and track), ranked."""
    return search.ranked(_searched(spark, d))


@flow
def pso_top(spark: SparkSession, d: str) -> DataFrame:
    return search.top_candidates(_searched(spark, d))


@flow
def pso_summary(spark: SparkSession, d: str) -> DataFrame:
    return search.temperature_summary(_searched(spark, d))


@flow
def pso_family_frequency(spark: SparkSession, d: str) -> DataFrame:
    return search.family_frequency(search.top_candidates(_searched(spark, d)))


@flow
def tsne_2d(spark: SparkSession, d: str) -> DataFrame:
    """Projection of every embedding: a bounded sample exactly, the rest among its neighbours."""
    return project.project(load(spark, d, "embeddings"), "vec_id", "embedding")


@flow
def tsne_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Projection of the encoded matrix joined one to one with split and predictions."""
    p, m = _fitted(spark, d)
    enc = FeatureEncoder(D.NUMERIC_FEATURES, D.CATEGORICAL_FEATURES, D.BINARY_FEATURES).fit(p.rows.filter("Set = 'Train'"))
    coords = cut(project.project(enc.transform_sparse(p.rows), "row_id", "features"))  # each is read several times
    pred = cut(T.holdout(p, m))
    return project.projection_table(coords, pred.select("row_id", "Set"), pred.select("row_id", "Actual", "Predicted", "Residual", "Abs_Residual"))


@flow
def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    """Principal components of every embedding by pyspark.ml."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = load(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return PCA(k=2, inputCol="v", outputCol="p").fit(e).transform(e).select("vec_id", *(F.round(vector_to_array("p")[i], 6).alias(f"pc{i + 1}") for i in range(2)))
