"""Many small fits as independent tasks, judged on all rows.

Fits use all rows of their training set, which lie in the shared folder and are read once, with categories as numbers, by
every worker, so that the driver never holds them; every fit is one row of a task table. Scoring is distributed: each batch of the whole
table is scored by every model and leaves only sums. So fits and metrics cover all rows; a fit and its rows have to
find room in one task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift import domain as D
from spindrift.models import estimators as E
from spindrift.models import matrix as M
from spindrift.models import native
from spindrift.operators.splitting import draw
from spindrift.session import ensure_checkpoint_dir

#: Bytes of unpacked models that a scoring task keeps from one batch of rows to the next.
KEPT_BYTES = 48 << 20
#: Rows that score_sums joins from batches, so that a model is unpacked once for all of them.
SCORED_ROWS = 30_000
#: Most rows that judge_tasks sends to the tasks.
SENT_ROWS = 500_000
#: Most jobs of judge_tasks at a time.
JOBS = 8


@dataclass
class Kept:
    """Rows in drawn order, in a folder that all executors share."""

    uri: str
    n: int

    def __len__(self) -> int:
        return self.n

    def read(self) -> pd.DataFrame:
        fs, path = (pa.fs.LocalFileSystem(), "/" + self.uri.removeprefix("file:").lstrip("/")) if self.uri.startswith(("file:", "/")) else pa.fs.FileSystem.from_uri(self.uri)
        files = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(path)) if f.path.endswith(".parquet"))
        parts = [pq.ParquetFile(fs.open_input_file(f), read_dictionary=D.CATEGORICAL_FEATURES).read() for f in files]
        return _usable(pa.concat_tables(parts).unify_dictionaries().to_pandas(split_blocks=True, self_destruct=True))


def kept_rows(df: DataFrame, row_id: str, columns: list[str], seed: int = 42) -> Kept:
    """All rows in drawn order."""
    ensure_checkpoint_dir(df.sparkSession)
    uri = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    rows = df.select(*(F.col(f"`{c}`") for c in (row_id, *columns)), draw(seed, row_id).alias("__h")).orderBy("__h", row_id)
    rows.drop("__h").write.parquet(uri)  # files are numbered in the order of the rows
    return Kept(uri, df.sparkSession.read.parquet(uri).count())


def _rows_of(sample: pd.DataFrame | Kept) -> pd.DataFrame:
    return sample.read() if isinstance(sample, Kept) else sample


def _to_send(sample: pd.DataFrame | Kept) -> pd.DataFrame | Kept:
    return sample if isinstance(sample, Kept) else _usable(sample.copy())


def bounded_sample(df: DataFrame, row_id: str, columns: list[str], limit: int, seed: int = 42) -> pd.DataFrame:
    """At most `limit` rows in drawn order, for callers that ask for so many."""
    keep = [row_id, *columns]
    return df.select(*(F.col(f"`{c}`") for c in keep), draw(seed, row_id).alias("__h")).orderBy("__h", row_id).limit(limit).drop("__h").toPandas()


def training_rows(df: DataFrame, row_id: str, columns: list[str], limit: int | None, seed: int) -> pd.DataFrame | Kept:
    """All rows, in the shared folder; only the first `limit` of the drawn order where the caller sets one."""
    return kept_rows(df, row_id, columns, seed) if limit is None else bounded_sample(df, row_id, columns, limit, seed)


def features(drop: str | None = None) -> tuple[list[str], list[str], list[str]]:
    return tuple([c for c in cols if c != drop] for cols in (D.NUMERIC_FEATURES, D.CATEGORICAL_FEATURES, D.BINARY_FEATURES))


def _usable(pdf: pd.DataFrame) -> pd.DataFrame:
    for c in (*D.NUMERIC_FEATURES, *D.BINARY_FEATURES):
        if c in pdf:
            pdf[c] = pd.to_numeric(pdf[c], errors="coerce").astype(float)
    return pdf


def _r2(y: np.ndarray, p: np.ndarray) -> float:
    total = float(((y - y.mean()) ** 2).sum())
    return float(1 - ((y - p) ** 2).sum() / total) if total > 0 else float("nan")


def fit_tasks(spark, sample: pd.DataFrame | Kept, tasks: list[dict], target: str = D.TARGET) -> list[dict]:
    """tasks: dicts with task_id, family, params, seed, and optionally drop (a feature), where (column, values): the
    sample rows used, and first (at most so many of them). Returns task_id, model bytes, encoder text and, where own is asked for, R2 on the very rows of the fit."""
    shared = spark.sparkContext.broadcast(_to_send(sample))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for spec in b["spec"]:
                t = json.loads(spec)
                pdf = _rows_of(shared.value)
                if t.get("where"):
                    pdf = pdf[pdf[t["where"][0]].isin(t["where"][1])]
                if t.get("first"):
                    pdf = pdf.iloc[: t["first"]]
                enc = M.fit_matrix(pdf, *features(t.get("drop")), indicators=bool(t.get("indicators")))
                x, y = M.apply_coded(enc, pdf), pdf[target].to_numpy(float)
                del pdf
                model = E.fit(t["family"], x, y, t["params"], t.get("seed", 42))
                native.release()
                own = _r2(y, E.predict(model, x)) if t.get("own") else None
                yield pd.DataFrame({"task_id": [t["task_id"]], "model": [E.to_bytes(model)], "encoder": [M.dumps(enc)], "own": pd.Series([own], dtype=float)})

    if not tasks:
        return []
    table = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(tasks)], "i int, spec string")
    # a task for each fit: slow ones do not hold up others
    rows = table.repartitionById(len(tasks), "i").select("spec").mapInPandas(run, "task_id string, model binary, encoder string, own double").collect()  # callers bound the number of models held at a time
    if len(rows) != len(tasks):  # a driver short of memory may end the transfer early without an error
        raise RuntimeError(f"{len(rows)} of {len(tasks)} models came back")
    return [{"task_id": r.task_id, "model": bytes(r.model), "encoder": r.encoder, "own": r.own} for r in rows]


def _judged(tasks: list[dict], sample: pd.DataFrame, rows: dict[str, pd.DataFrame], target: str) -> Iterator[tuple]:
    """Fits the tasks (of one `where`, all SVR or none) and scores the rows of each group by them: (task_id, group, n, sy, syy, sse, sae)
    of each model and group. One model is held at a time, and of many trees some at a time."""
    column, values = tasks[0]["where"]
    pdf = sample[sample[column].isin(values)]
    enc = M.fit_matrix(pdf, *features())
    x, y = M.apply_coded(enc, pdf), pdf[target].to_numpy(float)
    del pdf
    blocks = [(g, M.apply_coded(enc, own), own[target].to_numpy(float)) for g, own in rows.items()]
    fits = (E.fit(t["family"], x, y, t["params"], t.get("seed", 42)) for t in tasks)
    if tasks[0]["family"] == "SVR":
        kernels = E.Kernels(fits)
        found = ((i, g, z, p) for g, own, z in blocks for i, p in enumerate(kernels.predict(own).T))
    else:
        found = ((i, g, z, p) for i, t in enumerate(tasks) for (g, _, z), p in zip(blocks, E.fit_predict(t["family"], x, y, t["params"], t.get("seed", 42), [own for _, own, _ in blocks])))
    for i, g, z, p in found:
        e = z - p
        yield tasks[i]["task_id"], g, len(z), *map(float, (z.sum(), (z**2).sum(), (e**2).sum(), np.abs(e).sum()))


def judge_tasks(spark, rows: DataFrame | None, sample: pd.DataFrame | Kept, batches: list[list[dict]], group: str, target: str = D.TARGET, every: bool = False) -> list[tuple]:
    """(task_id, group, n, sy, syy, sse, sae) of every task, judged on the rows whose group is its `on` (every: on the rows of each group).
    A batch (one `where` and `on`) is fitted and scored in one task, so its models go nowhere. rows: at most SENT_ROWS, sent to the
    tasks; None: the sample, which then holds all rows."""
    sc, cols = spark.sparkContext, sum(features(), [])
    shared, sent = sc.broadcast(_to_send(sample)), {}
    if rows is not None:
        src = rows.select(F.col(f"`{target}`").cast("double").alias(target), F.col(f"`{group}`").cast("string").alias("__g"), *(F.col(f"`{c}`") for c in cols)).filter(F.col(f"`{target}`").isNotNull())
        names = sorted({r[0] for r in src.select("__g").distinct().collect()} if every else {b[0]["on"] for b in batches})
        sent = {g: sc.broadcast(_usable(src.filter(F.col("__g") == g).drop("__g").toPandas())) for g in names}  # one after another: the driver holds one
    schema, whole = f"task_id string, `{group}` string, n bigint, sy double, syy double, sse double, sae double", rows is None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            for spec in b["spec"]:
                tasks, pdf = json.loads(spec), _rows_of(shared.value)
                if whole:
                    own = {g: pdf[pdf[group] == g] for g in (sorted(pdf[group].dropna().unique()) if every else [tasks[0]["on"]])}
                else:
                    own = {g: v.value for g, v in sent.items() if every or g == tasks[0]["on"]}
                yield pd.DataFrame(_judged(tasks, pdf, own, target), columns=["task_id", group, "n", "sy", "syy", "sse", "sae"])

    def judged(own: list[list[dict]]) -> list[tuple]:
        table = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(own)], "i int, spec string")
        return [tuple(r) for r in table.repartitionById(len(own), "i").select("spec").mapInPandas(run, schema).collect()]  # one row a model and group

    # small jobs: what else the session runs gets its turn between them
    each = -(-sc.defaultParallelism // JOBS)
    with ThreadPoolExecutor(min(sc.defaultParallelism, JOBS)) as pool:
        found = [r for part in pool.map(judged, (batches[i : i + each] for i in range(0, len(batches), each))) for r in part]
    for x in (shared, *sent.values()):
        x.unpersist()
    return found


def score(df: DataFrame, models: list[dict], keep: list[str], out: str = "Predicted") -> DataFrame:
    """(keep..., task_id, out): every model's prediction of every row."""
    shared = df.sparkSession.sparkContext.broadcast([(m["task_id"], m["model"], m["encoder"]) for m in models])
    cols = [*D.NUMERIC_FEATURES, *D.CATEGORICAL_FEATURES, *D.BINARY_FEATURES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = [(t, E.from_bytes(m), M.loads(e)) for t, m, e in shared.value]
        for pdf in batches:
            pdf = _usable(pdf)
            for task, model, enc in ready:
                yield pdf[[f"__k{i}" for i in range(len(keep))]].assign(__t=task, __p=E.predict(model, M.apply_coded(enc, pdf)))

    src = df.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keep)), *(F.col(f"`{c}`") for c in cols))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[: len(keep)])
    return src.mapInPandas(run, f"{schema}, __t string, __p double").toDF(*keep, "task_id", out)


def _joined(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The same rows in the same order, in batches of at most `most` rows (or as they come, if larger)."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if held and sum(map(len, held)) + len(b) > most:
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(b)
    if held:
        yield pd.concat(held, ignore_index=True)


def score_sums(df: DataFrame, models: list[dict], group: str, target: str = D.TARGET, only: dict[str, str] | None = None) -> DataFrame:
    """(task_id, group, n, sy, syy, sse, sae) of every model on every value of the group column, over all rows.
    Each batch leaves one row of sums for each model and group value. only: the one group value, for each task_id, that
    its model is judged on; rows of others are not scored by it."""
    shared = df.sparkSession.sparkContext.broadcast([(m["task_id"], m["model"], m["encoder"]) for m in models])
    cols = [*D.NUMERIC_FEATURES, *D.CATEGORICAL_FEATURES, *D.BINARY_FEATURES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, list[tuple[str, bytes]]] = {}
        for task, model, enc in shared.value:
            by.setdefault(enc, []).append((task, model))
        kept, room = {}, KEPT_BYTES

        def ready(task: str, data: bytes) -> dict:
            nonlocal room
            if task in kept:
                return kept[task]
            model = E.from_bytes(data)
            size = sum(np.asarray(v).nbytes for v in model.values())
            if size <= room:
                kept[task], room = model, room - size
            return model

        kernels: dict[str, tuple[list[str], E.Kernels]] = {}
        for enc, own in by.items() if only is None else ():
            svr = [(t, m) for t, m in own if E.kind_of(m) == "kernel"]
            if len(svr) > 1:
                kernels[enc] = [t for t, _ in svr], E.Kernels([E.from_bytes(m) for _, m in svr])
        for pdf in _joined(batches, SCORED_ROWS):
            pdf = _usable(pdf)
            rows, y_all, groups = [], pdf["__y"].to_numpy(float), pdf.groupby("__g", sort=False).indices

            def add(task: str, g: str, y: np.ndarray, e: np.ndarray) -> None:
                rows.append((task, g, len(y), y.sum(), (y**2).sum(), (e**2).sum(), np.abs(e).sum()))

            for text, own in by.items():
                enc, parts = M.loads(text), {}
                for g, at in groups.items() if only is not None else ():
                    if any(only[task] == g for task, _ in own):
                        parts[g] = M.apply_coded(enc, pdf.iloc[at])
                x = M.apply_coded(enc, pdf) if only is None else None
                together, k = kernels.get(text, ([], None))
                if k is not None:
                    p = k.predict(x)
                    for i, task in enumerate(together):
                        for g, at in groups.items():
                            add(task, g, y_all[at], (y_all - p[:, i])[at])
                for task, data in own:
                    if task in together:
                        continue
                    if only is not None:
                        if only[task] in parts:
                            y = y_all[groups[only[task]]]
                            add(task, only[task], y, y - E.predict(ready(task, data), parts[only[task]]))
                        continue
                    e = y_all - E.predict(ready(task, data), x)
                    for g, at in groups.items():
                        add(task, g, y_all[at], e[at])
            yield pd.DataFrame(rows, columns=["task_id", "g", "n", "sy", "syy", "sse", "sae"])

    src = df.select(F.col(f"`{target}`").cast("double").alias("__y"), F.col(f"`{group}`").cast("string").alias("__g"), *(F.col(f"`{c}`") for c in cols))
    sums = src.filter("__y is not null").mapInPandas(run, "task_id string, g string, n bigint, sy double, syy double, sse double, sae double")
    return sums.groupBy("task_id", F.col("g").alias(group)).agg(*(F.sum(c).alias(c) for c in ("n", "sy", "syy", "sse", "sae")))


def metrics_of(sums: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, R2, MAE, RMSE) from added-up sums; R2 is null where the target is constant."""
    t = sums.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "sy", "syy", "sse", "sae")))
    total = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r2 = F.when(total > 1e-9, 1 - F.col("sse") / total)
    return t.select(*by, "n", r2.alias("R2"), (F.col("sae") / F.col("n")).alias("MAE"), F.sqrt(F.col("sse") / F.col("n")).alias("RMSE"))
