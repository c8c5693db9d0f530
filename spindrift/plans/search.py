"""Search for high-scoring candidates inside the measured domain: particle swarm and random draws."""

from __future__ import annotations

import hashlib
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift import domain as D
from spindrift.models import estimators as E
from spindrift.models import lane
from spindrift.models import matrix as M
from spindrift.operators import neighbours, ranking, stats
from spindrift.operators.quantiles import quantiles
from spindrift.session import cut
from spindrift.sources import records

#: Most domain rows that are sent to the search tasks (beyond, distances are taken from the table, in blocks), most
#: families sent to them, rows of one task of the threshold, and most rows of a cell.
LOCAL_ROWS, MAX_FAMILIES, BLOCK, LEAF = 250_000, 100_000, 2_048, 128
_PROPS = ("prom_electronegativity", "prom_ionic_radius", "prom_atomic_mass", "prom_first_ionization")


class Cells:
    """Rows dealt into cells of at most LEAF near ones, with the box of each. A query measures its distance to the boxes and
    looks only into cells that can hold one of its nearest rows: the same neighbours as from all rows."""

    def __init__(self, rows: np.ndarray):
        todo, cells = [np.arange(len(rows))] if len(rows) else [], []
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                cells.append(own)
                continue
            v = rows[own]
            o = own[np.argpartition(v[:, v.var(0).argmax()], len(own) // 2)]
            todo += [o[: len(own) // 2], o[len(own) // 2 :]]
        self.id = np.concatenate(cells) if cells else np.zeros(0, np.int64)  # row numbers, cell by cell
        self.rows = rows[self.id]
        self.size = (self.rows * self.rows).sum(1)
        self.ends = np.cumsum([0] + [len(c) for c in cells])
        self.low, self.high = (np.array([f(rows[c], 0) for c in cells]).reshape(len(cells), rows.shape[1]) for f in (np.min, np.max))

    def mean_nearest(self, x: np.ndarray, k: int, ids: np.ndarray | None = None) -> np.ndarray:
        """Mean distance of each x to its k nearest rows; ids: the row number of each x, none of which is its own neighbour."""
        out = np.full(len(x), np.inf)
        m = min(k, len(self.id) - (ids is not None))
        if m <= 0:
            return out
        step = max(1, min(LEAF, 4_000_000 // len(self.low)))
        for at in range(0, len(x), step):
            q, own = x[at : at + step], None if ids is None else ids[at : at + step]
            away = np.zeros((len(q), len(self.low)))
            for j in range(x.shape[1]):
                away += np.maximum(np.maximum(self.low[:, j] - q[:, j, None], q[:, j, None] - self.high[:, j]), 0.0) ** 2
            size = (q * q).sum(1)
            slack = 1e-9 * (size + self.size.max())  # of the matrix product
            best = np.full((len(q), m), np.inf)
            least = away.min(0)
            for c in np.lexsort((away.sum(0), least)):  # cells that may hold a near row of some query, nearest first
                edge = best[:, -1]
                asks = np.nonzero(away[:, c] <= edge)[0]
                if not len(asks):
                    if least[c] > edge.max():
                        break
                    continue
                held = slice(self.ends[c], self.ends[c + 1])
                d = (size[asks, None] + self.size[held]) - 2 * q[asks] @ self.rows[held].T
                r, n = np.nonzero(d <= (edge + slack)[asks, None])
                if own is not None:
                    other = own[asks[r]] != self.id[held][n]
                    r, n = r[other], n[other]
                if not len(r):
                    continue
                d = ((q[asks[r]] - self.rows[held][n]) ** 2).sum(1)  # without cancellation between near rows
                got, first = np.unique(r, return_index=True)
                wide = np.full((len(got), np.diff(np.append(first, len(r))).max()), np.inf)
                seg = np.searchsorted(got, r)
                wide[seg, np.arange(len(r)) - first[seg]] = d
                best[asks[got]] = np.sort(np.concatenate([best[asks[got]], wide], axis=1), axis=1)[:, :m]
            out[at : at + step] = np.sqrt(best).mean(1)
        return out


@dataclass
class Space:
    """Everything a search needs. The domain is all rows: in anchors, or in table where they are too many to send."""

    low: np.ndarray
    high: np.ndarray
    fixed: dict
    families: dict[str, pd.DataFrame]
    anchors: np.ndarray | None  # scaled domain rows
    center: np.ndarray
    spread: np.ndarray
    medians: np.ndarray
    threshold: float
    promoters: dict
    supports: dict
    table: DataFrame | None = None  # (id, v): scaled domain rows
    cells: Cells | None = None  # of the anchors, made at first use


def assumptions(df: DataFrame) -> dict:
    """Fixed operating point: medians and modes, with fallbacks for empty columns."""
    med = {"S_C_Ratio": 2.0, "TOS_h": 10.0, "Pressure_bar": 1.0, "GHSV_log": 0.0, "WHSV_log": 0.0}
    return df.agg(
        *(stats.median_or(F.col(c), v).alias(c) for c, v in med.items()),
        *(stats.mode_or(F.col(c), "Unknown").alias(c) for c in ("Precursor_Family", "Support_Prep_Method")),
    ).first().asDict()


def eligible_families(df: DataFrame, least: int = 10) -> DataFrame:
    """Observed (support, promoter, method) families with at least `least` records, else the five largest, of each track."""
    f = stats.families(df, ["Support", "Promoter_Metal", "Metal_Loading_Method"], "Promoter_Metal").withColumnRenamed("Promoter_Metal", "Promoter_Key")
    out = None
    for track in ("promoted", "unpromoted"):
        one = ranking.largest_by_count(f.filter(F.col("Track") == track), "Dataset_Count", ["Family"], least)
        out = one if out is None else out.unionByName(one)
    return out


def mean_knn(anchors: np.ndarray, x: np.ndarray, k: int, own_at: int | None = None) -> np.ndarray:
    """own_at: x are the anchors from there on, none of which is a neighbour of itself."""
    return Cells(anchors).mean_nearest(x, k, None if own_at is None else own_at + np.arange(len(x)))


def _own_distances(spark, anchors: np.ndarray) -> np.ndarray:
    """Mean 5-NN distance of every anchor to the others, in blocks spread over the tasks, in no stated order."""
    shared = spark.sparkContext.broadcast(cells := Cells(anchors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in b["at"]:
                t = slice(int(at), int(at) + BLOCK)  # in the order of the cells, so that rows asked together are near each other
                yield pd.DataFrame({"d": shared.value.mean_nearest(shared.value.rows[t], 5, shared.value.id[t])})

    starts = spark.createDataFrame([(i,) for i in range(0, len(cells.id), BLOCK)] or [(0,)], "at int")
    tasks = min(-(-len(anchors) // BLOCK), 4 * spark.sparkContext.defaultParallelism) or 1
    return starts.repartition(tasks, "at").mapInPandas(run, "d double").toPandas()["d"].to_numpy(float)


def build_space(df: DataFrame, local_rows: int = LOCAL_ROWS, least: int = 10) -> Space:
    """Bounds, operating point and domain from all rows; the domain is median imputed and robustly scaled, its
    threshold the 95th percentile of its own mean 5-NN distances. local_rows decides only where distances
    are computed: in the search tasks or, for a larger table, by operators.neighbours."""
    spark = df.sparkSession
    b = stats.adaptive_bounds(df, {c: D.VALID_RANGES[c] for c in D.SEARCH_COLUMNS}).collect()  # one row a column
    by = {r.Parameter: r for r in b}
    fam = eligible_families(df, least)
    if fam.limit(MAX_FAMILIES + 1).count() > MAX_FAMILIES:
        raise ValueError(f"more than {MAX_FAMILIES} eligible families")
    fam = fam.orderBy("Track", F.desc("Dataset_Count"), "Family").toPandas()
    raw = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in D.DOMAIN_COLUMNS}
    med = np.array([m or 0.0 for (m,) in quantiles(df, raw, [0.5]).values()])
    filled = {c: F.coalesce(v, F.lit(float(m))) for (c, v), m in zip(raw.items(), med)}
    q = [v if v[0] is not None else [0.0] * 3 for v in quantiles(df, filled, [0.25, 0.5, 0.75]).values()]
    q1, q2, q3 = np.array(q).T
    spread = np.where(q3 - q1 > 1e-12, q3 - q1, 1.0)
    scaled = F.array(*((v - F.lit(float(m))) / F.lit(float(w)) for v, m, w in zip(filled.values(), q2, spread)))
    table = cut(df.select(F.monotonically_increasing_id().alias("id"), scaled.alias("v")))
    if table.limit(local_rows + 1).count() <= local_rows:
        anchors = table.select(*(F.col("v")[i].alias(f"v{i}") for i in range(len(med)))).toPandas().to_numpy(float)
        own = _own_distances(spark, anchors)
        own = own[np.isfinite(own)]
        threshold, table = float(np.quantile(own, 0.95)) if len(own) else 0.0, None
    else:
        own = cut(neighbours.mean_distance(neighbours.nearest(table, table, "id", "v", 5)))
        anchors, threshold = None, quantiles(own, {"d": F.col("mean_distance")}, [0.95])["d"][0] or 0.0
    return Space(
        np.array([by[c].Lower for c in D.SEARCH_COLUMNS]), np.array([by[c].Upper for c in D.SEARCH_COLUMNS]), assumptions(df),
        {t: fam[fam["Track"] == t].reset_index(drop=True) for t in ("promoted", "unpromoted")}, anchors, q2, spread, med, threshold,
        {r[0]: r[1:] for r in records.promoters(spark).collect()}, {r[0]: r[1:] for r in records.supports(spark).collect()}, table,
    )


def distances(s: Space, x: np.ndarray) -> np.ndarray:
    """Mean distance of each scaled vector to its five nearest of all domain rows."""
    if s.table is None:
        s.cells = s.cells or Cells(s.anchors)
        return s.cells.mean_nearest(x, 5)
    asked = s.table.sparkSession.createDataFrame([(-1 - i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")  # no id of the table
    got = neighbours.mean_distance(neighbours.nearest(s.table, asked, "id", "v", 5)).collect()  # one row a candidate
    out = np.full(len(x), np.inf)
    for r in got:
        out[-1 - r.query_id] = r.mean_distance
    return out


def build_frame(s: Space, pos: np.ndarray, temp: float, track: str) -> pd.DataFrame:
    """Candidates of positions (continuous columns, then the family's number) at a fixed operating point."""
    fam = s.families[track]
    pick = fam.iloc[np.clip(np.rint(pos[:, -1]).astype(int), 0, len(fam) - 1)].reset_index(drop=True)
    out = pd.DataFrame(pos[:, :-1], columns=D.SEARCH_COLUMNS)
    if track == "unpromoted":
        out["Promoter_Loading_wt%"] = 0.0
    out = out.assign(Reaction_Temp_C=temp, **s.fixed)
    out["calc_reduc_temp_diff"] = out["Calcination_Temp_C"] - out["Reduction_Temp_C"]
    out["total_treatment_time_h"] = out["Calcination_Time_h"] + out["Reduction_Time_h"] + out["Dry_Time_h"]
    out["Support"], out["Metal_Loading_Method"] = pick["Support"], pick["Metal_Loading_Method"]
    out["Promoter_Metal"] = pick["Promoter_Key"].where(pick["Promoter_Key"] != "Unknown", None)
    out["has_promoter"] = float(track == "promoted")
    props = [s.promoters.get(p, (np.nan,) * 4) for p in out["Promoter_Metal"]]
    for i, c in enumerate(_PROPS):
        out[c] = [p[i] for p in props]
    out["prom_missing"] = out[_PROPS[0]].isna().astype(float)
    sup = [s.supports.get(x, ("unknown", 0, 0)) for x in out["Support"]]
    out["support_type"], out["support_acid_base"], out["support_reducible"] = ([x[i] for x in sup] for i in range(3))
    out["Family"], out["Dataset_Count"], out["Track"] = pick["Family"], pick["Dataset_Count"], track
    return out


def scaled(s: Space, frame: pd.DataFrame) -> np.ndarray:
    x = frame[D.DOMAIN_COLUMNS].to_numpy(float)
    return (np.where(np.isnan(x), s.medians, x) - s.center) / s.spread


def evaluate(s: Space, frame: pd.DataFrame, model: dict, encoder: dict, dist: np.ndarray) -> pd.DataFrame:
    """The frame with prediction, domain distance, flags and penalised score."""
    raw = E.predict(model, M.apply_coded(encoder, lane._usable(frame)))
    within, beyond = dist <= s.threshold, (raw < 0) | (raw > 100)
    v, span = frame[D.SEARCH_COLUMNS].to_numpy(float), np.maximum(s.high - s.low, 1e-9)
    near = ((v - s.low) / span <= 0.02).any(1) | ((s.high - v) / span <= 0.02).any(1)
    return frame.assign(
        Raw_Prediction=raw, Predicted_Conversion=np.clip(raw, 0, 100), AD_Mean_5NN_Distance=dist, Within_AD=within, Out_of_Physical_Range=beyond, Boundary_Flag=near,
        Optimization_Score=raw - 100.0 * ~within - 200.0 * beyond,
    )


def box(s: Space, track: str) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.append(s.low, 0.0), np.append(s.high, max(0.0, len(s.families[track]) - 1.0))
    if track == "unpromoted":
        i = D.SEARCH_COLUMNS.index("Promoter_Loading_wt%")
        low[i] = high[i] = 0.0
    return low, high


#: A search in steps: yields scaled vectors, is sent their distances, returns the frame and its trace.
Steps = Generator[np.ndarray, np.ndarray, tuple[pd.DataFrame, list[float]]]


def _swarm(s: Space, model: dict, encoder: dict, temp: float, track: str, particles: int, iterations: int, seed: int) -> Steps:
    rng = np.random.default_rng(seed)
    low, high = box(s, track)
    pos = low + (high - low) * rng.random((particles, len(low)))
    vel, best, best_score, trace = np.zeros_like(pos), pos.copy(), np.full(particles, -np.inf), []
    for _ in range(iterations):
        frame = build_frame(s, pos, temp, track)
        score = evaluate(s, frame, model, encoder, (yield scaled(s, frame)))["Optimization_Score"].to_numpy()
        up = score > best_score
        best[up], best_score[up] = pos[up], score[up]
        lead = best[best_score.argmax()]
        trace.append(float(best_score.max()))
        pull = 1.45 * rng.random(pos.shape) * (best - pos) + 1.45 * rng.random(pos.shape) * (lead - pos)
        vel = 0.72 * vel + pull
        pos = np.clip(pos + vel, low, high)
    frame = build_frame(s, best, temp, track)
    return evaluate(s, frame, model, encoder, (yield scaled(s, frame))), trace


def _draws(s: Space, model: dict, encoder: dict, temp: float, track: str, n: int, seed: int) -> Steps:
    low, high = box(s, track)
    frame = build_frame(s, low + (high - low) * np.random.default_rng(seed).random((n, len(low))), temp, track)
    return evaluate(s, frame, model, encoder, (yield scaled(s, frame))), []


def _run(s: Space, searches: list[Steps]) -> list[tuple[pd.DataFrame, list[float]]]:
    """Results of searches that go in step: the vectors of one step of all are measured together."""
    done: list = [None] * len(searches)
    asked = {i: next(g) for i, g in enumerate(searches)}
    while asked:
        got, at, more = distances(s, np.concatenate(list(asked.values()))), 0, {}
        for i, x in asked.items():
            try:
                more[i] = searches[i].send(got[at : at + len(x)])
            except StopIteration as end:
                done[i] = end.value
            at += len(x)
        asked = more
    return done


def swarm(s: Space, model: dict, encoder: dict, temp: float, track: str, particles: int, iterations: int, seed: int) -> tuple[pd.DataFrame, list[float]]:
    """Best positions of all particles, evaluated, and the best score after each iteration (never falling)."""
    return _run(s, [_swarm(s, model, encoder, temp, track, particles, iterations, seed)])[0]


_OUT = [*D.SEARCH_COLUMNS, "Reaction_Temp_C", "Family", "Dataset_Count", "Track", "Raw_Prediction", "Predicted_Conversion", "AD_Mean_5NN_Distance", "Within_AD", "Out_of_Physical_Range", "Boundary_Flag", "Optimization_Score"]
_TYPES = {"Family": "string", "Track": "string", "Dataset_Count": "bigint", "Within_AD": "boolean", "Out_of_Physical_Range": "boolean", "Boundary_Flag": "boolean"}
_SCHEMA = ", ".join(f"`{c}` {_TYPES.get(c, 'double')}" for c in _OUT)


def seed_of(*key) -> int:
    return int.from_bytes(hashlib.md5("|".join(map(str, key)).encode()).digest()[:8], "big")


def search(spark, s: Space, model: dict, temperatures: list[float] | None = None, particles: int = 35, iterations: int = 110, draws: int = 2500, seed: int = 42, chunk: int = 500) -> DataFrame:
    """All candidates of the swarm (one task for each temperature and track) and of the random draws (in chunks),
    with Search and draw number. Every task has a seed of its own, so results do not depend on how tasks are
    spread. A track without families gives no rows."""
    temps = temperatures or D.SEARCH_TEMPERATURES
    tracks = [t for t in ("promoted", "unpromoted") if len(s.families[t])]
    jobs = [("Swarm", t, k, 0, particles) for t in temps for k in tracks]
    jobs += [("Random", t, k, at, min(chunk, draws - at)) for t in temps for k in tracks for at in range(0, draws, chunk)]

    def steps(space: Space, data: dict, enc: dict, kind: str, temp: float, track: str, at: int, n: int) -> Steps:
        own = seed_of(seed, kind, temp, track, at)
        return _swarm(space, data, enc, temp, track, n, iterations, own) if kind == "Swarm" else _draws(space, data, enc, temp, track, n, own)

    def labelled(out: pd.DataFrame, kind: str, at: int) -> pd.DataFrame:
        return out[_OUT].assign(Search=kind, draw=at + np.arange(len(out)))

    schema = f"{_SCHEMA}, Search string, draw bigint"
    if s.table is not None:  # all searches in step, so that the table is read once a step
        if not jobs:
            return spark.createDataFrame([], schema)
        data, enc = E.from_bytes(model["model"]), M.loads(model["encoder"])
        done = _run(s, [steps(s, data, enc, *j) for j in jobs])
        return spark.createDataFrame(pd.concat([labelled(out, j[0], j[3]) for j, (out, _) in zip(jobs, done)]), schema)
    shared = spark.sparkContext.broadcast((s, model["model"], model["encoder"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, data, enc = shared.value[0], E.from_bytes(shared.value[1]), M.loads(shared.value[2])
        for b in batches:
            for j in b.itertuples(index=False):
                out, _ = _run(space, [steps(space, data, enc, j.kind, j.temp, j.track, j.at, j.n)])[0]
                yield labelled(out, j.kind, j.at)

    table = spark.createDataFrame([(i, *j) for i, j in enumerate(jobs)], "i int, kind string, temp double, track string, at int, n int")
    return table.repartition(min(len(jobs), 4 * spark.sparkContext.defaultParallelism) or 1, "i").mapInPandas(run, schema)


def ranked(found: DataFrame) -> DataFrame:
    """Rank inside each search and temperature, over both tracks together."""
    from pyspark.sql import Window

    w = Window.partitionBy("Search", "Reaction_Temp_C").orderBy(F.desc("Optimization_Score"), "Track", "draw")  # particles + draws of one temperature
    return found.withColumn("Rank", F.row_number().over(w))


def valid(found: DataFrame) -> DataFrame:
    return found.filter("Within_AD and not Out_of_Physical_Range")


def top_candidates(found: DataFrame, k: int = 10) -> DataFrame:
    return ranking.top_k(valid(found).filter("Search = 'Swarm'"), "Reaction_Temp_C", [F.desc("Optimization_Score"), F.col("Track"), F.col("draw")], k, "Place")


def temperature_summary(found: DataFrame) -> DataFrame:
    return valid(found).filter("Search = 'Swarm'").groupBy("Reaction_Temp_C").agg(
        F.max("Predicted_Conversion").alias("Best_Predicted_Conversion"), F.median("Predicted_Conversion").alias("Median_Predicted_Conversion"),
        F.count(F.lit(1)).alias("Valid_Candidates"), F.avg(F.col("Boundary_Flag").cast("int")).alias("Boundary_Flag_Rate"),
    )


def family_frequency(top: DataFrame) -> DataFrame:
    temps = F.array_join(F.transform(F.array_sort(F.collect_set("Reaction_Temp_C")), lambda x: x.cast("string")), ", ")
    return top.groupBy("Family", "Track").agg(F.count(F.lit(1)).alias("Top_Count"), temps.alias("Temperatures"), F.max("Predicted_Conversion").alias("Best_Prediction"))
