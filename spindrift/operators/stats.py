"""Summaries: metrics, bounds, modes, rates, model selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.quantiles import quantiles


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, R2, MAE, RMSE) in one aggregate from sums; R2 is null where the actual values are constant."""
    y, p = _q(actual), _q(predicted)
    sse, n = F.sum((y - p) * (y - p)), F.count(y)
    return df.filter(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        n.alias("n"), (1 - sse / F.nullif(F.var_pop(y) * n, F.lit(0.0))).alias("R2"), F.avg(F.abs(y - p)).alias("MAE"), F.sqrt(sse / n).alias("RMSE")
    )


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(Metric, Mean, SD, Median, Min, Max) of each column: sample SD, exact median."""
    mid = quantiles(df, {c: _q(c) for c in columns}, [0.5])
    aggs = []
    for i, c in enumerate(columns):
        v = _q(c).cast("double")
        aggs += [F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"b{i}"), F.min(v).alias(f"d{i}"), F.max(v).alias(f"e{i}")]
    one = df.agg(*aggs).first()
    rows = [(c, one[f"a{i}"], one[f"b{i}"], mid[c][0], one[f"d{i}"], one[f"e{i}"]) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "Metric string, Mean double, SD double, Median double, Min double, Max double")


def mode_or(c: Column, fallback) -> Column:
    """Most frequent value, the smallest on ties; fallback if there is none."""
    return F.coalesce(F.mode(c, deterministic=True), F.lit(fallback))


def median_or(c: Column, fallback: float) -> Column:
    return F.coalesce(F.median(c), F.lit(float(fallback)))


def adaptive_bounds(df: DataFrame, physical: Mapping[str, tuple[float, float]], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(Parameter, Lower, Upper, Physical_Lower, Physical_Upper) of each column.

    Two or more distinct values: quantiles inside the physical bounds; one: ten percent around it; none:
    the physical bounds. Bounds that would not be apart are spread.
    """
    got = quantiles(df, {c: _q(c) for c in physical}, [0.0, low, high, 1.0])
    rows = []
    for c, (pl, ph) in physical.items():
        least, q_low, q_high, most = got[c]
        if least is None:
            lower, upper = pl, ph
        elif least == most:
            lower, upper = max(pl, least * 0.9), min(ph, least * 1.1 + 1e-6)
        else:
            lower, upper = max(pl, q_low), min(ph, q_high)
        if upper <= lower:
            upper = min(ph, lower + max(1.0, abs(lower) * 0.1))
        rows.append((c, float(lower), float(upper), float(pl), float(ph)))
    return df.sparkSession.createDataFrame(rows, "Parameter string, Lower double, Upper double, Physical_Lower double, Physical_Upper double")


def select_model(comparison: DataFrame, window: float = 0.02) -> DataFrame:
    """The chosen row: among candidates within `window` of the best CV R2, the smallest gap, then SD, then
    complexity, then the largest CV R2. The table has one row for each candidate."""
    best = comparison.agg(F.max("CV_R2_Mean").alias("__best"))
    pool = comparison.crossJoin(F.broadcast(best)).filter(F.col("CV_R2_Mean") >= F.col("__best") - window).drop("__best")  # one row
    return pool.orderBy("CV_Gap_Mean", "CV_R2_SD", "Complexity_Rank", F.desc("CV_R2_Mean"), "Candidate").limit(1)


def acceptance(test_r2: Column, seed_r2_mean: Column, seed_gap_mean: Column, r2: float = 0.70, gap: float = 0.15) -> Column:
    """Three flags and their conjunction as a struct."""
    a, b, c = test_r2 >= r2, seed_r2_mean >= r2, seed_gap_mean <= gap
    return F.struct(a.alias("test_r2_ok"), b.alias("seed_r2_ok"), c.alias("seed_gap_ok"), (a & b & c).alias("accepted"))


def families(df: DataFrame, keys: Sequence[str], promoter: str) -> DataFrame:
    """(keys..., Family, Track, Dataset_Count): frequency of each combination, null read as Unknown."""
    cols = [F.coalesce(_q(k), F.lit("Unknown")).alias(k) for k in keys]
    n = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("Dataset_Count"))
    return n.withColumn("Family", F.concat_ws(" | ", *(_q(k) for k in keys))).withColumn("Track", F.when(F.lower(_q(promoter)) == "unknown", "unpromoted").otherwise("promoted"))
