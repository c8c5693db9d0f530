"""Exact feature encoding: fit on one set of rows, transform any other.

Medians and quartiles are exact, the standard deviation is the population's, constant columns are
centred only, frequent categories get one column each in alphabetical order, the rest of a column share
one, unseen values get none. The fitted state is a few numbers for each feature and a table of
the categories with the number of their column, which transform joins: categories have no limit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.lookup import MAX_BROADCAST_ROWS
from spindrift.operators.quantiles import quantiles
from spindrift.session import cut


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _one_at(place: Column, width: int) -> Column:
    """width zeros with a one at place (from 0), if it is not negative; made of whole arrays, not element by element."""
    zero = F.lit(0.0)
    return F.when(place < 0, F.array_repeat(zero, width)).otherwise(F.concat(F.array_repeat(zero, place), F.array(F.lit(1.0)), F.array_repeat(zero, F.lit(width - 1) - place)))


@dataclass
class FeatureEncoder:
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    binary: list[str] = field(default_factory=list)
    min_frequency: int = 5
    scale: str = "standard"  # standard, robust or none
    indicators: bool = False
    state: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "FeatureEncoder":
        """A few aggregates, each for all features of a kind. Nulls are imputed by
        the median, the word Unknown, or the mode (0 where a column is all null)."""
        one = df.agg(F.count(F.lit(1)).alias("rows"), *(F.mode(_q(c).cast("double"), deterministic=True).alias(f"b{i}") for i, c in enumerate(self.binary)), *(F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(self.numeric))).first()
        mids = quantiles(df, {c: _q(c) for c in self.numeric}, [0.5])
        medians = [mids[c][0] if mids[c][0] is not None else 0.0 for c in self.numeric]
        modes = [one[f"b{i}"] if one[f"b{i}"] is not None else 0.0 for i in range(len(self.binary))]
        filled = [F.coalesce(_q(c).cast("double"), F.lit(m)) for c, m in zip(self.numeric, medians)]
        center, spread = [0.0] * len(filled), [1.0] * len(filled)
        found: list[tuple] = []
        if self.scale == "standard" and filled:
            got = df.agg(*(x for i, v in enumerate(filled) for x in (F.avg(v).alias(f"a{i}"), F.stddev_pop(v).alias(f"s{i}")))).first()
            found = [(got[f"a{i}"], got[f"s{i}"]) for i in range(len(filled))]
        elif self.scale == "robust":
            q = quantiles(df, dict(zip(self.numeric, filled)), [0.25, 0.5, 0.75])
            found = [(m, None if m is None else hi - lo) for lo, m, hi in (q[c] for c in self.numeric)]
        for i, (c, s) in enumerate(found):
            center[i] = c if c is not None else 0.0
            # a spread of rounding size is a constant column
            spread[i] = s if s is not None and s > 1e-12 * max(1.0, abs(center[i])) else 1.0
        cats: dict[str, tuple[list[str], bool]] = {}
        if self.categorical:
            long = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.coalesce(_q(c).cast("string"), F.lit("Unknown")).alias("v")) for i, c in enumerate(self.categorical)))).alias("x")).select("x.*")
            n = cut(long.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")))
            often = n.filter(F.col("n") >= self.min_frequency)
            few = n.filter(F.col("n") < self.min_frequency)
            rare = {r.i for r in few.select("i").distinct().collect()}
            for i, c in enumerate(self.categorical):
                cats[c] = ([], i in rare)
            for r in often.orderBy("i", "v").collect():
                cats[self.categorical[r.i]][0].append(r.v)
        missing = [c for i, c in enumerate(self.numeric) if self.indicators and one[f"n{i}"] < one["rows"]]
        self.state = {"median": medians, "center": center, "spread": spread, "mode": modes, "categories": cats, "missing": missing}
        if self.categorical:
            # values below the frequency limit are kept too, so that unseen ones can be told apart
            places = [(i, v, k) for i, c in enumerate(self.categorical) for k, v in enumerate(cats[c][0])]
            ends = df.sparkSession.createDataFrame([(i, len(cats[c][0])) for i, c in enumerate(self.categorical)], "i int, k int")
            self.state["codes"] = df.sparkSession.createDataFrame(places, "i int, v string, k int").unionByName(few.join(F.broadcast(ends), "i").select("i", "v", "k"))
        return self

    @property
    def names(self) -> list[str]:
        out = [f"num__{c}" for c in self.numeric] + [f"num__missingindicator_{c}" for c in self.state["missing"]]
        for c in self.categorical:
            often, has_rare = self.state["categories"][c]
            out += [f"cat__{c}_{v}" for v in often] + ([f"cat__{c}_infrequent"] if has_rare else [])
        return out + [f"bin__{c}" for c in self.binary]

    def _numbers(self) -> list[Column]:
        s = self.state
        out = [(F.coalesce(_q(c).cast("double"), F.lit(m)) - F.lit(a)) / F.lit(b) for c, m, a, b in zip(self.numeric, s["median"], s["center"], s["spread"])]
        return out + [_q(c).isNull().cast("double") for c in s["missing"]]

    def _flags(self) -> list[Column]:
        return [F.coalesce(_q(c).cast("double"), F.lit(m)) for c, m in zip(self.binary, self.state["mode"])]

    def columns(self) -> list[Column]:
        """The features as columns; categories need transform."""
        if self.categorical:
            raise ValueError("categories are encoded by transform")
        return self._numbers() + self._flags()

    def _placed(self, df: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
        """df with column __k<i>, the place of each categorical value inside its feature (null if unseen), and (i, width) of
        the features that have columns."""
        widths = []
        for i, c in enumerate(self.categorical):
            often, has_rare = self.state["categories"][c]
            if not (width := len(often) + has_rare):
                continue
            codes = self.state["codes"].filter(F.col("i") == i).select(F.col("v").alias(f"__v{i}"), F.col("k").alias(f"__k{i}"))  # distinct values
            if codes.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
                codes = F.broadcast(codes)
            df = df.join(codes, F.coalesce(_q(c).cast("string"), F.lit("Unknown")) == F.col(f"__v{i}"), "left")
            widths.append((i, width))
        return df, widths

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        kept = [c for c in df.columns if c != out]
        df, widths = self._placed(df)
        ones = [_one_at(F.coalesce(F.col(f"__k{i}"), F.lit(-1)), width) for i, width in widths]
        none = F.array().cast("array<double>")
        parts = [F.array(*self._numbers()).cast("array<double>"), *ones, F.array(*self._flags()).cast("array<double>")]
        return df.select(*(_q(c) for c in kept), F.concat(none, *parts).alias(out))

    def transform_sparse(self, df: DataFrame, out: str = "features") -> DataFrame:
        """As transform, but out is a struct (size, indices, values) of the entries that may differ from zero: its size does
        not grow with the number of categories."""
        kept = [c for c in df.columns if c != out]
        df, widths = self._placed(df)
        entries, at = [], 0
        for v in self._numbers():
            entries.append(F.struct(F.lit(at).alias("i"), v.alias("v")))
            at += 1
        for i, width in widths:
            entries.append(F.when(F.col(f"__k{i}").isNotNull(), F.struct((F.col(f"__k{i}") + at).alias("i"), F.lit(1.0).alias("v"))))
            at += width
        for v in self._flags():
            entries.append(F.struct(F.lit(at).alias("i"), v.alias("v")))
            at += 1
        held = F.filter(F.array(*entries), lambda x: x.isNotNull()) if entries else F.array().cast("array<struct<i:int,v:double>>")
        vector = F.transform(F.array(held), lambda h: F.struct(F.lit(at).alias("size"), h["i"].alias("indices"), h["v"].alias("values")))[0]
        return df.select(*(_q(c) for c in kept), vector.alias(out))

    def transform_long(self, df: DataFrame, row_id: str) -> DataFrame:
        """(row_id, feature): the name of each category column that holds a one, a row each; no row is made as wide as the
        number of categories."""
        ends, rare = [len(self.state["categories"][c][0]) for c in self.categorical], [f"cat__{c}_infrequent" for c in self.categorical]
        cells = F.array(*(F.struct(F.lit(i).alias("i"), F.coalesce(_q(c).cast("string"), F.lit("Unknown")).alias("v")) for i, c in enumerate(self.categorical)))
        named = lambda texts: F.array(*(F.lit(x) for x in texts))[F.col("i")]
        codes = self.state["codes"]
        small = codes.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
        codes = codes.select("i", "v", F.when(F.col("k") == named(ends), named(rare)).otherwise(F.concat(named([f"cat__{c}_" for c in self.categorical]), "v")).alias("feature"))
        return df.select(row_id, F.explode(cells).alias("x")).select(row_id, "x.*").join(F.broadcast(codes) if small else codes, ["i", "v"]).select(row_id, "feature")
