"""Attribution, rankings, plot sources and leave-one-feature-out ablation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift import domain as D
from spindrift.functions.rules import relabel
from spindrift.models import estimators as E
from spindrift.models import lane, shapley
from spindrift.models import matrix as M
from spindrift.plans import train as T

#: Most values of one batch of attributions.
CELLS = 250_000
_LABELS = D.LABEL_PREFIXES + D.LABEL_NAMES


def shown(model: dict) -> list[int]:
    """Features whose values and Shapley values are made for every row: numbers, flags, categories that the trees ask for, and the
    first ten names of the others, which can rank among ten. The Shapley values of the remaining categories are zero for every row."""
    names, used = M.matrix_names(M.loads(model["encoder"])), {int(i) for i in shapley.asked(E.from_bytes(model["model"]))}
    used |= {i for i, n in enumerate(names) if not n.startswith("cat__")}
    return sorted(used | {i for _, i in sorted((n, i) for i, n in enumerate(names) if i not in used)[:10]})


def attributions(df: DataFrame, model: dict, only: list[int] | None = None) -> DataFrame:
    """(row_id, values, shap, prediction, base, codes): encoded features (all, or those of the numbers `only`) and their exact Shapley values
    of every row; codes: the number of the feature that each categorical column holds, or -1."""
    shared = df.sparkSession.sparkContext.broadcast((model["model"], model["encoder"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted, enc = E.from_bytes(shared.value[0]), M.loads(shared.value[1])
        base, used = shapley.base_value(fitted), shapley.asked(fitted)
        want = np.arange(len(M.matrix_names(enc))) if only is None else np.array(only, np.int64)
        step = max(16, CELLS // max(1, len(want)))
        for whole in batches:
            for begin in range(0, len(whole), step):
                pdf = lane._usable(whole.iloc[begin : begin + step].copy())
                x = M.apply_coded(enc, pdf)
                shap, of = np.zeros((len(x), len(want))), np.searchsorted(want, used)
                shap[:, of] = shapley.shap_values(fitted, x)
                yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy(), "values": list(np.ascontiguousarray(x.columns(want))), "shap": list(shap), "prediction": E.predict(fitted, x), "base": base, "codes": list(np.ascontiguousarray(x.codes.T))})

    src = df.select("row_id", *(F.col(f"`{c}`") for c in T.FEATURES))
    return src.mapInPandas(run, "row_id bigint, values array<double>, shap array<double>, prediction double, base double, codes array<int>")


def long_form(att: DataFrame, names: list[str]) -> DataFrame:
    """(row_id, Feature, Value, SHAP_Value)."""
    table = att.sparkSession.createDataFrame(list(enumerate(names)), "i int, Feature string")
    z = att.select("row_id", F.posexplode(F.arrays_zip("values", "shap")).alias("i", "x"))
    return z.join(F.broadcast(table), "i").select("row_id", "Feature", F.col("x.values").alias("Value"), F.col("x.shap").alias("SHAP_Value"))  # one row a feature


def ranking(long: DataFrame, zeros: list[str] | None = None) -> DataFrame:
    """zeros: features that are not in long, as their Shapley values are zero for every row."""
    r = long.groupBy("Feature").agg(F.avg(F.abs("SHAP_Value")).alias("Mean_Abs_SHAP"))
    if zeros:
        more = long.sparkSession.createDataFrame([(n,) for n in zeros], "Feature string")
        r = r.unionByName(more.withColumn("Mean_Abs_SHAP", F.when(F.lit(not long.isEmpty()), F.lit(0.0))).filter("Mean_Abs_SHAP is not null"))
    return r.withColumn("Feature_Label", relabel(F.col("Feature"), _LABELS))


def top_sources(long: DataFrame, n: int = 10) -> DataFrame:
    """(row_id, Feature, Feature_Label, Rank, Value, SHAP_Value, Colour) of the n highest-ranked features; Colour
    scales Value into 0..1 inside its feature, 0 where it is constant."""
    top = ranking(long).orderBy(F.desc("Mean_Abs_SHAP"), "Feature").limit(n).collect()
    table = long.sparkSession.createDataFrame([(r.Feature, r.Feature_Label, i + 1) for i, r in enumerate(top)], "Feature string, Feature_Label string, Rank int")
    j = long.join(F.broadcast(table), "Feature")  # n rows
    span = j.groupBy("Feature").agg(F.min("Value").alias("lo"), F.max("Value").alias("hi"))
    colour = F.when(F.col("hi") > F.col("lo"), (F.col("Value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return j.join(F.broadcast(span), "Feature").select("row_id", "Feature", "Feature_Label", "Rank", "Value", "SHAP_Value", colour.alias("Colour"))


def dependence_sources(long: DataFrame, df: DataFrame, n: int = 6) -> DataFrame:
    """Raw values beside Shapley values of the n highest-ranked numeric features."""
    top = ranking(long.filter(F.col("Feature").startswith("num__") & ~F.col("Feature").contains("missingindicator"))).orderBy(F.desc("Mean_Abs_SHAP"), "Feature").limit(n).collect()
    raw = [r.Feature.removeprefix("num__") for r in top]
    if not raw:
        return long.limit(0).select("row_id", "Feature", F.col("Value").alias("Feature_Value"), "SHAP_Value")
    values = df.select("row_id", F.explode(F.array(*(F.struct(F.lit(f"num__{c}").alias("Feature"), F.col(f"`{c}`").cast("double").alias("Feature_Value")) for c in raw))).alias("x")).select("row_id", "x.*")
    return long.join(values, ["row_id", "Feature"]).select("row_id", F.regexp_replace("Feature", "^num__", "").alias("Feature"), "Feature_Value", "SHAP_Value")


def distinct_names(names: list[str]) -> list[str]:
    """names as columns of one table, which differ by more than the case of letters: of several that do not, the first in the
    list stays and the others get a number, " (2)" upwards."""
    out, used, lower = [], set(), {n.lower() for n in names}
    for n in names:
        own, k = n, 1
        while own.lower() in used or k > 1 and own.lower() in lower:
            k += 1
            own = f"{n} ({k})"
        used.add(own.lower())
        out.append(own)
    return out


def wide_audit(att: DataFrame, names: list[str], own: list[int] | None = None, column: list[int] | None = None) -> DataFrame:
    """One column for the value and one for the Shapley value of each feature, named as distinct_names has it. own: the features that att
    has values of (None: all); the others are categories whose Shapley values are zero, of the categorical columns that `column` numbers."""
    at = {i: k for k, i in enumerate(range(len(names)) if own is None else own)}
    cols = []
    for i, n in enumerate(distinct_names(names)):
        n = n.replace("`", "``")
        value, shap = (f"get(values, {at[i]})", f"get(shap, {at[i]})") if i in at else (f"if(get(codes, {column[i]}) = {i}, 1D, 0D)", "0D")
        cols += [f"{value} AS `Value::{n}`", f"{shap} AS `SHAP::{n}`"]
    return att.selectExpr("row_id", *cols)


def columns_of(encoder: dict) -> list[int]:
    """Of each feature of the matrix, the number of its categorical column, or -1."""
    return [int(max(-1, -1 - s)) for s in M.apply_coded(encoder, pd.DataFrame({c: pd.Series(dtype=t) for k, t in (("numeric", float), ("categorical", object), ("binary", float)) for c, *_ in encoder[k]})).slot]


def ablation(p: T.Prepared, family: str, params: dict, drop: list[str] | None = None) -> DataFrame:
    """(Feature, Feature_Label, baseline and reduced CV R2 with SD, change): one fit for each feature and fold."""
    k, spark = p.knobs, p.rows.sparkSession
    names = [""] + (drop if drop is not None else T.FEATURES)
    tasks = [
        {"task_id": f"{f}|{i}", "family": family, "params": T._capped(params, k), "seed": k.seed, "drop": f or None, "where": ["fold", T._others(i, k.folds)]}
        for f in names for i in range(k.folds)
    ]
    part = F.split("task_id", r"\|")
    sums = lane.score_sums(p.rows.filter("fold is not null"), lane.fit_tasks(spark, p.sample, tasks), "fold", only={t["task_id"]: t["task_id"].split("|")[1] for t in tasks})
    m = lane.metrics_of(sums, ["task_id"]).groupBy(part[0].alias("Feature")).agg(F.avg("R2").alias("m"), F.stddev_samp("R2").alias("s"))
    base = m.filter("Feature = ''").select(F.col("m").alias("bm"), F.col("s").alias("bs"))
    out = m.filter("Feature <> ''").crossJoin(F.broadcast(base))  # one row
    return out.select(
        "Feature", relabel(F.col("Feature"), _LABELS).alias("Feature_Label"), F.col("bm").alias("Baseline_CV_R2"), F.col("bs").alias("Baseline_CV_R2_SD"), F.col("m").alias("Reduced_CV_R2"),
        F.col("s").alias("Reduced_CV_R2_SD"), (F.col("m") - F.col("bm")).alias("Delta_CV_R2_After_Removal"),
    )
