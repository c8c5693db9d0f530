import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift import domain as D
from spindrift import sinks
from spindrift.plans import curate as C
from spindrift.plans import project, search
from spindrift.plans import train as T
from spindrift.models import estimators as E
from spindrift.models import lane
from spindrift.models import matrix as M
from spindrift.sources import records
from spindrift.streaming.rules import guarded_stream
from spindrift.tables import load

COLUMNS = [*D.TEXT_COLUMNS, *D.FLAG_COLUMNS, *D.VALID_RANGES, *(f"extra_{i:02d}" for i in range(1, 29))]
GOOD = {"Source_File": "s.pdf", "Canonical_Catalyst_ID": "c1", "Catalyst": "Ni10/Al2O3", "Active_Metal": "Ni", "Support": "Al2O3", "Ni_Loading_wt%": "10", "Calcination_Temp_C": "500", "Reduction_Temp_C": "600", "Reaction_Temp_C": "400", "MeOH_Conversion_%": "50"}


def raw(spark, *rows):
    schema = "raw_row_id long, " + ", ".join(f"`{c}` string" for c in COLUMNS)
    return spark.createDataFrame([(i, *((GOOD | r).get(c) for c in COLUMNS)) for i, r in enumerate(rows)], schema)


def test_curation_branches(spark):
    c = C.curate(raw(
        spark, {}, {"MeOH_Conversion_%": "54"}, {"Active_Metal": "Cu"}, {"Reaction_Temp_C": None, "Canonical_Catalyst_ID": None}, {"MeOH_Conversion_%": "120"},
        {"Calcination_Temp_C": "nan", "Reduction_Temp_C": "5000"}, {"is_literature_comparison": "TRUE"}, {"Catalyst": "Ni20/MgO", "MeOH_Conversion_%": "1"}, {"Catalyst": "Ni20/MgO", "MeOH_Conversion_%": "6.1"},
        {"Catalyst": "Ni5/ZnO", "Promoter_Metal": "Ni, Cu; Zn", "Promoter_Loading_wt%": "2"}, {"Catalyst": "1d\nNi/CeO2", "Ni_Loading_wt%": "1d", "MeOH_Conversion_%": "7"},
    ))
    log = {r.raw_row_id: r.Reason for r in c.exclusions.collect()}
    assert log == {2: "not_row_level_nickel_catalyst", 4: "missing_or_invalid_target_or_reaction_temperature", 5: "more_than_two_core_synthesis_fields_missing",
                   7: "unresolved_condition_collision", 8: "unresolved_condition_collision"}
    p = {r.raw_row_id: r for r in c.primary.collect()}
    assert set(p) == {0, 9, 10} and p[0].Original_Row_IDs == "0;1;3" and p[0].Replicate_Count == 3 and p[0]["MeOH_Conversion_%"] == 50.0
    assert p[9].Promoter_Metal == "Cu,Zn" and p[9].prom_electronegativity == 1.9 and p[9].has_promoter == 1 and p[0]["Promoter_Loading_wt%"] == 0.0
    assert p[10]["Ni_Loading_wt%"] is None and sorted(r.row_id for r in p.values()) == [0, 1, 2]
    assert [r.raw_row_id for r in c.comparison.collect()] == [6]
    assert c.collisions.count() == 2
    assert C.curate(raw(spark, {}).limit(0)).primary.count() == 0


def test_curation_keeps_account(spark, small):
    r = load(spark, small, "dataset_all")
    c = C.curate(r)
    assert c.primary.agg(F.sum("Replicate_Count")).first()[0] + c.comparison.count() + c.exclusions.count() == r.count()
    ids = c.exclusions.select("raw_row_id").unionByName(c.comparison.select("raw_row_id")).unionByName(
        c.primary.select(F.explode(F.coalesce(F.split("Original_Row_IDs", ";"), F.array(F.col("raw_row_id").cast("string")))).alias("raw_row_id")).select(F.col("raw_row_id").cast("long")))
    assert ids.distinct().count() == ids.count() == r.count()


def test_training_and_search(spark, small):
    df = load(spark, small, "ni_model_primary")
    p = T.prepare(df, T.Knobs(families=("Gradient Boosting", "SVR"), trees=10, draws=2, folds=3, fit_rows=150, seeds=(1, 2)))
    n = df.count()
    assert p.rows.count() == n and len(p.sample) <= 150
    comp, final = T.compare(p, T.cross_validate(p))
    rows = comp.collect()
    assert len(rows) == 2 and sum(r.Selected for r in rows) == 1 and min(r.CV_Rank for r in rows) == 1
    h = T.holdout(p, final["Gradient Boosting"]).collect()
    assert len(h) == n and all(abs(r.Residual - (r.Predicted - r.Actual)) < 1e-9 for r in h)
    st = T.stability(df, "Gradient Boosting", D.LOCKED_PARAMS["Gradient Boosting"], p.knobs)
    assert all(r.Train_n + r.Test_n == n for r in st.collect())
    assert set(T.gate(comp, st).columns) >= {"accepted", "seed_gap_ok"}
    space = search.build_space(p.rows, 100)
    m = final["Gradient Boosting"]
    out, trace = search.swarm(space, E.from_bytes(m["model"]), M.loads(m["encoder"]), 400.0, "unpromoted", 8, 12, 1)
    assert trace == sorted(trace) and (out["Promoter_Loading_wt%"] == 0).all()
    v = out[D.SEARCH_COLUMNS].drop(columns="Promoter_Loading_wt%").to_numpy()
    keep = [i for i, c in enumerate(D.SEARCH_COLUMNS) if c != "Promoter_Loading_wt%"]
    assert (v >= space.low[keep] - 1e-9).all() and (v <= space.high[keep] + 1e-9).all()
    a = search.search(spark, space, m, [300.0], particles=5, iterations=3, draws=30)
    assert a.count() == 70 and sorted(map(str, a.collect())) == sorted(map(str, a.repartition(3).collect()))


def test_projection_flow_has_the_default_sizes(spark, small, monkeypatch):
    from spindrift import flows

    seen = []
    monkeypatch.setattr(project, "project", lambda *a, **k: seen.append((a[1:], k)))
    flows.tsne_2d(spark, small)
    assert seen == [(("vec_id", "embedding"), {})]


def test_every_search_task_has_its_seed():
    keys = [(42, k, t, r, at) for k in ("Swarm", "Random") for t in D.SEARCH_TEMPERATURES for r in ("promoted", "unpromoted") for at in range(0, 2500, 500)]
    assert len({search.seed_of(*k) for k in keys}) == len(keys)


def test_flows_do_the_locked_job(spark, small, monkeypatch):
    from spindrift import flows
    from spindrift.plans import explain

    seen = {}
    monkeypatch.setattr(flows, "_MADE", {})
    monkeypatch.setattr(search, "search", lambda *a, **k: seen.update(search=k) or spark.range(1))
    monkeypatch.setattr(search, "build_space", lambda *a, **k: None)
    monkeypatch.setattr(explain, "ablation", lambda p, *a: seen.update(ablation=p.knobs))
    flows._searched(spark, small)
    flows.ablation_cv(spark, small)
    assert flows._KNOBS == seen["ablation"] == T.Knobs() and seen["search"] == {}
    gb = E.from_bytes(flows._fitted(spark, small)[1]["model"])
    assert len(E.trees_of(gb)) == D.LOCKED_PARAMS["Gradient Boosting"]["n_estimators"]


def test_search_domain_is_every_row(spark, small):
    df = load(spark, small, "ni_model_primary")
    v = df.select(*(F.col(f"`{c}`").cast("double") for c in D.DOMAIN_COLUMNS)).toPandas().to_numpy(float)
    v = np.where(np.isnan(v), np.nan_to_num(np.nanmedian(v, axis=0)), v)
    q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75], axis=0)
    v = (v - q2) / np.where(q3 - q1 > 1e-12, q3 - q1, 1.0)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.quantile(np.sort(d, axis=1)[:, :5].mean(1), 0.95)
    sent, kept = search.build_space(df), search.build_space(df, 100)
    assert len(sent.anchors) == kept.table.count() == df.count() and sent.table is kept.anchors is None
    assert np.allclose([sent.threshold, kept.threshold], want)
    x = np.random.default_rng(1).normal(size=(20, v.shape[1]))
    near = np.sort(np.sqrt(((x[:, None] - v[None]) ** 2).sum(2)), axis=1)[:, :5].mean(1)
    assert np.allclose(search.distances(sent, x), near) and np.allclose(search.distances(kept, x), near)


def test_projection_covers_all(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(90)] + [(500, None)], "id long, v array<double>")
    r = project.project(df, "id", "v", 30, exact_rows=40).collect()
    assert len(r) == 90 and all(np.isfinite([x.TSNE1, x.TSNE2]).all() for x in r)
    assert project.project(df.limit(0), "id", "v", 30).count() == 0
    with pytest.raises(ValueError):
        s = spark.createDataFrame([(1,)], "row_id long")
        project.projection_table(spark.createDataFrame([(1,), (2,)], "row_id long"), s, s)


def test_csv_and_documents(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿a,b,c\n1,"x\n""y""",NA\nNa,None,2\n', encoding="utf-8")
    got = [tuple(r) for r in records.read_csv(spark, str(path), ["a", "b", "c"], "pos").orderBy("pos").collect()]
    assert got == [(0, "1", 'x\n"y"', None), (1, "Na", None, "2")]
    df = spark.createDataFrame([(1, "é", None)], "a int, b string, c double")
    sinks.write_single_csv(df, str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_bytes().startswith(b"\xef\xbb\xbfa,b,c")
    assert json.loads(sinks.to_document(df)) == {"a": 1, "b": "é", "c": None}
    sinks.write_tables({"t": df}, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/t")).count() == 1
    (tmp_path / "d.json").write_text('{"k": {"v": 1}}')
    assert records.read_json(spark, str(tmp_path / "d.json")).first().k.v == 1
    import hashlib

    assert records.file_hash(spark, str(path)).first().sha256 == hashlib.sha256(path.read_bytes()).hexdigest()
    done = lambda d: os.makedirs(d)
    assert not sinks.promote(done, str(tmp_path / "art"), False, {"status": "review"}, str(tmp_path / "r.json")) and (tmp_path / "r.json").exists()
    assert sinks.promote(done, str(tmp_path / "art"), True, {}, str(tmp_path / "r.json")) and not (tmp_path / "r.json").exists() and (tmp_path / "art").exists()
    log = sinks.RunLog()
    log.mark("x")
    assert log.table(spark).count() == 1


def test_fingerprint_and_box(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    a, b = records.table_hash(df).first(), records.table_hash(df.repartition(9)).first()
    assert a == b and a.n_rows == 100 and records.table_hash(df.limit(0)).first().n_rows == 0
    x = records.random_box(spark, 2000, {"a": (0, 1), "b": (5, 5)}, 7).toPandas()
    assert x.a.between(0, 1).all() and (x.b == 5).all() and abs(x.a.mean() - 0.5) < 0.05


def test_stream_equals_batch(spark, small, tmp_path):
    src = load(spark, small, "dataset_all")
    src.write.parquet(str(tmp_path / "in"))
    q = guarded_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).select("raw_row_id", "Reason").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert q.awaitTermination(120)
    stream = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert stream == sorted(map(tuple, guarded_stream(src).select("raw_row_id", "Reason").collect()))


def test_fit_lane_is_bounded(spark, small):
    df = load(spark, small, "ni_model_primary")
    s = lane.bounded_sample(df, "row_id", [D.TARGET], 20)
    assert len(s) == 20 and list(s["row_id"]) == list(lane.bounded_sample(df.repartition(5), "row_id", [D.TARGET], 20)["row_id"])
    assert lane.fit_tasks(spark, s, []) == []


def test_models_are_judged_on_their_own_fold_alone(spark, small):
    p = T.prepare(load(spark, small, "ni_model_primary"), T.Knobs(trees=5, folds=3, fit_rows=100))
    tasks = [{"task_id": f"m|{i}", "family": "Gradient Boosting", "params": D.LOCKED_PARAMS["Gradient Boosting"] | {"n_estimators": 5}, "where": ["fold", T._others(i, 3)]} for i in range(3)]
    models, rows = lane.fit_tasks(spark, p.sample, tasks), p.rows.filter("fold is not null")
    key = lambda df: sorted((r.task_id, r.fold, r.n, round(r.sse, 6)) for r in df.collect())
    own = key(lane.score_sums(rows, models, "fold", only={f"m|{i}": str(i) for i in range(3)}))
    assert len(own) == 3 and own == [r for r in key(lane.score_sums(rows, models, "fold")) if r[0].split("|")[1] == r[1]]


def test_wide_names_differ_by_more_than_case(spark, tmp_path):
    from spindrift.plans import explain

    assert explain.distinct_names(["a_Ni(NO₃)₂", "a_ni(no₃)₂", "b", "B (2)", "B"]) == ["a_Ni(NO₃)₂", "a_ni(no₃)₂ (2)", "b", "B (2)", "B (3)"]
    att = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 4.0])], "row_id long, values array<double>, shap array<double>")
    explain.wide_audit(att, ["cat__Ni", "cat__NI"]).write.parquet(str(tmp_path / "wide"))
    assert spark.read.parquet(str(tmp_path / "wide")).first()[1:] == (1.0, 3.0, 2.0, 4.0)


def test_neighbours_from_cells_are_those_of_all_rows():
    import time

    rng = np.random.default_rng(0)
    rows = np.repeat(rng.normal(size=(400, 6)) * 20, 25, axis=0) + rng.normal(size=(10_000, 6)) * 0.1
    rows[5000:5400] = rows[5000]  # repeated rows
    away = rng.normal(size=(50, 6)) * 30
    cells = search.Cells(rows)

    def brute(x, ids):
        d = ((x[:, None] - rows[None]) ** 2).sum(2)
        if ids is not None:
            d[np.arange(len(x)), ids] = np.inf
        return np.sqrt(np.sort(d, axis=1)[:, :5]).mean(1)

    ids = np.arange(4900, 5100)
    assert np.allclose(cells.mean_nearest(rows[ids], 5, ids), brute(rows[ids], ids), atol=1e-12) and np.allclose(cells.mean_nearest(away, 5), brute(away, None))
    assert np.allclose(search.mean_knn(rows, rows[ids], 5, own_at=4900), brute(rows[ids], ids))
    assert np.isinf(search.Cells(rows[:1]).mean_nearest(rows[:1], 5, np.array([0]))).all() and np.isinf(search.Cells(rows[:0]).mean_nearest(away, 5)).all()
    assert np.allclose(search.Cells(rows[:3]).mean_nearest(rows[:3], 5, np.arange(3)), [np.sqrt(((rows[:3] - r) ** 2).sum(1)).sum() / 2 for r in rows[:3]])
    began = time.thread_time()
    cells.mean_nearest(cells.rows[:1024], 5, cells.id[:1024])
    took, began = time.thread_time() - began, time.thread_time()
    brute(rows[:64], None)
    assert took < 16 * 0.5 * (time.thread_time() - began)


def test_projection_of_sparse_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 6)) * (rng.random((90, 6)) < 0.6)
    x[:, 0] = rng.normal(size=90)
    x[60:, 1] = 3.0
    dense = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    held = [(i, (6, np.nonzero(v)[0].tolist(), v[v != 0].tolist())) for i, v in enumerate(x)]
    sparse = spark.createDataFrame(held, "id long, v struct<size: int, indices: array<int>, values: array<double>>")
    ask = lambda df: np.array([r[1:] for r in sorted(project.project(df, "id", "v", 5, exact_rows=40).collect())])
    assert ask(dense).shape == (90, 2) and np.allclose(ask(dense), ask(sparse), atol=1e-6)
    # a place that no sample row holds counts by its length, and takes no room
    wide = spark.createDataFrame([(i, (10**9, [*a, 10**9 - 1], [*b, 1.0])) for i, (_, a, b) in held], sparse.schema)
    assert np.isfinite(ask(wide)).all() and project.project(sparse.limit(0), "id", "v", 5).count() == 0


def _repeated_rows(spark, small):
    """The primary table with 300 more promoters of six rows each."""
    df = load(spark, small, "ni_model_primary")
    more = df.limit(6).crossJoin(spark.range(300).withColumnRenamed("id", "__n"))
    return df.unionByName(more.withColumn("Promoter_Metal", F.concat(F.lit("M"), F.col("__n").cast("string"))).withColumn("row_id", F.col("row_id") + 10**6 * (1 + F.col("__n"))).drop("__n"))


def test_linear_rows_do_not_widen_with_categories(spark, small):
    ready, names = T.encoded(_repeated_rows(spark, small))
    assert len(names) > 330 and max(len(r.features.indices) for r in ready.collect()) <= len(T.FEATURES)
    assert ready.first().features.size == len(names)


def test_boosting_on_sparse_rows_is_exact(spark, small):
    from spindrift.models import boosting

    df = _repeated_rows(spark, small)
    model, ready, names = T.distributed_boosting(df, trees=3)
    got = model.transform(ready).toPandas()
    assert len(got) == df.count() and len(model.trees) == 3 and np.isfinite(got["prediction"]).all()
    assert ((got.label - got.prediction) ** 2).sum() < 0.9 * ((got.label - got.label.mean()) ** 2).sum()
    # a tree on all rows against the best splits of the same bins by brute force
    one = boosting.fit(ready, len(D.NUMERIC_FEATURES), len(D.BINARY_FEATURES), len(names), trees=1, depth=2, share=1.0)
    rows = ready.collect()
    x = np.array([np.bincount(r.features["indices"], r.features["values"], len(names)) for r in rows])
    y, cuts = np.array([r.label for r in rows]), dict(zip(one.lay.dense, one.lay.edges))
    t, error = one.trees[0], lambda v: ((v - v.mean()) ** 2).sum() if len(v) else 0.0

    def least(own):
        sides = (x[own, f] <= c for f in range(len(names)) for c in cuts.get(f, [0.5]))
        return min(error(y[own][s]) + error(y[own][~s]) for s in sides)

    root = x[:, t.feature[1]] <= t.threshold[1]
    assert abs(error(y[root]) + error(y[~root]) - least(np.ones(len(y), bool))) < 1e-6 * error(y)
    for i, own in ((2, root), (3, ~root)):
        s = x[:, t.feature[i]] <= t.threshold[i]
        assert abs(error(y[own & s]) + error(y[own & ~s]) - least(own)) < 1e-6 * error(y)
        assert np.isclose(t.value[2 * i], y[own & s].mean()) and np.isclose(t.value[2 * i + 1], y[own & ~s].mean())
    flat = {r.row_id: r.prediction for r in one.transform(ready).collect()}
    assert np.isclose(flat[rows[0].row_id], t.value[(4 if x[0, t.feature[2]] <= t.threshold[2] else 5) if root[0] else (6 if x[0, t.feature[3]] <= t.threshold[3] else 7)])
    assert one.transform(ready.limit(0)).count() == 0


def test_batches_of_the_cross_validation_hold_every_model_and_stay_small():
    k = T.Knobs()
    tasks = [{"task_id": f"{c['family']}|{c['variant']}", "family": c["family"], "params": c["params"]} for c in T.candidates(k)]
    got = T._batches(tasks, 5000)
    assert sorted(t["task_id"] for b in got for t in b) == sorted(t["task_id"] for t in tasks)
    assert all(len(b) <= T.HELD and sum(T._mb(t, 5000) for t in b) < 2 * T.HELD_MB for b in got)


def test_cross_validation_judges_every_model(spark, small):
    p = T.prepare(load(spark, small, "ni_model_primary"), T.Knobs(trees=4, draws=3, folds=2, fit_rows=100))
    got = T.cross_validate(p).toPandas()
    assert len(got) == 2 * len(T.candidates(p.knobs)) and got["Validation_R2"].notna().all()
    one = next(c for c in T.candidates(p.knobs) if c["family"] == "SVR")
    task = {"task_id": "a", "family": "SVR", "params": one["params"], "seed": p.knobs.seed, "where": ["fold", ["1"]]}
    m = lane.metrics_of(lane.score_sums(p.rows.filter("fold = 0"), lane.fit_tasks(spark, p.sample, [task]), "fold"), ["task_id"]).first()
    row = got[(got.family == "SVR") & (got.variant == one["variant"]) & (got.fold == 0)].iloc[0]
    assert abs(m.R2 - row.Validation_R2) < 1e-9 and abs(m.MAE - row.Validation_MAE) < 1e-9


def test_lost_models_are_an_error(spark, small, monkeypatch):
    p = T.prepare(load(spark, small, "ni_model_primary"), T.Knobs(fit_rows=60))
    task = {"task_id": "a", "family": "SVR", "params": {"C": 1.0, "epsilon": 0.5, "gamma": 0.1}}
    monkeypatch.setattr(type(p.rows), "collect", lambda self: [])
    with pytest.raises(RuntimeError, match="0 of 1 models"):
        lane.fit_tasks(spark, p.sample, [task])

def test_gate_scores_each_model_on_its_own_fold(spark, small, monkeypatch):
    from spindrift import flows

    k = T.Knobs(trees=4, draws=3, folds=2, fit_rows=100, seeds=(1, 2))
    p = T.prepare(load(spark, small, "ni_model_primary"), k)
    key, cols = ["family", "variant", "fold"], ["Validation_R2", "Validation_MAE", "Validation_RMSE"]
    whole = T.cross_validate(p)
    want = whole.toPandas().set_index(key).sort_index()
    own = T.validate(p)
    got = own.toPandas().set_index(key).sort_index()
    assert list(got.index) == list(want.index) and np.allclose(got[cols], want[cols], rtol=1e-9, atol=1e-9)
    a, b = (T.compare(p, cv)[0].drop("Best_Params").toPandas().set_index("Candidate").sort_index() for cv in (whole, own))
    assert list(a.columns) == list(b.columns) and np.allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-9)
    monkeypatch.setattr(lane, "SENT_ROWS", 0)  # the rows stay, the models go to them
    got = T.validate(p).toPandas().set_index(key).sort_index()
    assert list(got.index) == list(want.index) and np.allclose(got[cols], want[cols], rtol=1e-9, atol=1e-9)
    monkeypatch.setattr(flows, "_MADE", {})
    monkeypatch.setattr(flows, "_KNOBS", k)
    monkeypatch.setattr(T, "cross_validate", lambda p: pytest.fail("every model scores all rows"))
    assert flows.model_gate(spark, small).count() == 1


def test_kernels_of_many_rows_are_taken_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    x, most, rbf = rng.random((2500, 4)), [], E._rbf
    m = {"kind": "kernel", "base": 0.5, "gamma": 0.3, "vectors": rng.random((40, 4)), "coef": rng.random(40)}
    want = rbf(x, m["vectors"], m["gamma"]) @ m["coef"] + m["base"]
    monkeypatch.setattr(E, "_rbf", lambda a, b, g: most.append(len(a)) or rbf(a, b, g))
    assert np.allclose(E.predict(m, x), want, rtol=1e-12) and max(most) <= 512 and len(E.predict(m, x[:0])) == 0


@pytest.fixture(scope="module")
def wide_table(spark, small, tmp_path_factory):
    """A folder whose primary table has 7,400 rows: more training rows than any fit was once allowed."""
    d = tmp_path_factory.mktemp("rows")
    df = load(spark, small, "ni_model_primary")
    more = df.crossJoin(spark.range(40).withColumnRenamed("id", "__n")).withColumn("row_id", F.col("row_id") + 10**6 * F.col("__n"))
    more = more.withColumn(D.TARGET, F.col(f"`{D.TARGET}`") + F.col("__n") / 40).withColumn("Promoter_Metal", F.when(F.col("__n") % 2 == 0, F.col("Promoter_Metal")).otherwise(F.concat(F.lit("M"), F.col("__n").cast("string"))))
    more.drop("__n").write.parquet(str(d / "ni_model_primary.parquet"))
    return str(d)


def _root_cover(model):
    return E.from_bytes(model["model"])["cover"][0]


def test_fits_of_the_flows_use_all_training_rows(spark, wide_table):
    """F6 F7 F8 F9 F10: the model of search, attribution and projection. Each tree sees three of four rows."""
    from spindrift import flows

    p, m = flows._fitted(spark, wide_table)
    n = p.rows.filter("Set = 'Train'").count()
    assert n > 5500 and len(p.sample) == n and _root_cover(m) == int(0.75 * n)


@pytest.mark.parametrize("name", ["pso_summary", "pso_top"])
def test_the_search_has_the_model_of_all_training_rows(spark, wide_table, monkeypatch, name):
    """F7 F8"""
    from spindrift import flows

    seen, n = [], flows._prepared(spark, wide_table).rows.filter("Set = 'Train'").count()
    monkeypatch.setattr(search, "build_space", lambda rows: None)
    monkeypatch.setattr(search, "search", lambda spark, space, model: seen.append(model) or (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        flows.queries()[name](spark, wide_table)
    assert n > 5500 and _root_cover(seen[0]) == int(0.75 * n)


def test_wide_shapley_table_has_every_category(spark, wide_table):
    """with the model of all training rows; categories that no tree asks for are told from their codes alone."""
    from spindrift import flows
    from spindrift.plans import explain

    p, m = flows._fitted(spark, wide_table)
    names, own = M.matrix_names(M.loads(m["encoder"])), explain.shown(m)
    assert len(own) < len(names) and _root_cover(m) == int(0.75 * p.rows.filter("Set = 'Train'").count())
    rows = p.rows.limit(50)
    some = flows.explain.wide_audit(explain.attributions(rows, m, own), names, own, explain.columns_of(M.loads(m["encoder"]))).toPandas().sort_values("row_id")
    whole = explain.wide_audit(explain.attributions(rows, m), names).toPandas().sort_values("row_id")
    assert list(some.columns) == list(whole.columns) and len(whole.columns) == 1 + 2 * len(names) and np.array_equal(some.to_numpy(float), whole.to_numpy(float))


def test_learning_curve_goes_up_to_all_rows(spark, wide_table):
    """F5"""
    p = T.prepare(load(spark, wide_table, "ni_model_primary"), T.Knobs(trees=2, curve=(0.5, 1.0)))
    got = [r.Train_Size for r in T.learning_curve(p, "Gradient Boosting", D.LOCKED_PARAMS["Gradient Boosting"]).orderBy("Train_Size").collect()]
    n = p.rows.filter("fold is not null").count()
    assert max(got) >= n * 4 // 5 > 4000 and len(got) == 2


def _covers(monkeypatch):
    """Root covers of all models that lane.fit_tasks makes."""
    made, fit = {}, lane.fit_tasks
    monkeypatch.setattr(lane, "fit_tasks", lambda *a, **k: (lambda ms: made.update({m["task_id"]: _root_cover(m) for m in ms}) or ms)(fit(*a, **k)))
    return made


def test_ablation_fits_use_all_rows_of_the_other_folds(spark, wide_table, monkeypatch):
    """F1"""
    from spindrift.plans import explain

    p = T.prepare(load(spark, wide_table, "ni_model_primary"), T.Knobs(trees=2))
    made, folds = _covers(monkeypatch), dict(p.rows.filter("fold is not null").groupBy("fold").count().collect())
    assert explain.ablation(p, "Gradient Boosting", D.LOCKED_PARAMS["Gradient Boosting"], ["Support"]).count() == 1
    n = sum(folds.values())
    assert n > 5500 and made == {f"{f}|{i}": int(0.75 * (n - folds[str(i)])) for f in ("", "Support") for i in range(5)}


def test_cross_validation_fits_use_all_rows_of_the_other_folds(spark, wide_table):
    """F2 F3: every model is that of all rows, and judged on all rows."""
    p = T.prepare(load(spark, wide_table, "ni_model_primary"), T.Knobs(families=("Gradient Boosting", "Bagging"), trees=2, draws=1, folds=10))
    got, own = (f(p).toPandas().set_index(["family", "fold"]) for f in (T.cross_validate, T.validate))
    rows = p.sample.read()
    c = {x["family"]: x for x in T.candidates(p.knobs)}
    for family in c:
        fit, at = rows[rows["fold"] != "3"], rows[rows["fold"] == "3"]
        enc = M.fit_matrix(fit, *lane.features())
        x, y = M.apply_coded(enc, fit), fit[D.TARGET].to_numpy(float)
        m = E.fit(family, x, y, c[family]["params"], 42)
        assert len(y) > 5100 and len(got) == len(own) == 20
        for side, pdf in (("Train_R2", fit), ("Validation_R2", at)):
            assert abs(got.loc[(family, 3), side] - lane._r2(pdf[D.TARGET].to_numpy(float), E.predict(m, M.apply_coded(enc, pdf)))) < 1e-9
        assert abs(own.loc[(family, 3), "Validation_R2"] - got.loc[(family, 3), "Validation_R2"]) < 1e-9


def test_seeds_of_the_gate_use_all_training_rows(spark, wide_table, monkeypatch):
    """F4"""
    made = _covers(monkeypatch)
    rows = T.stability(load(spark, wide_table, "ni_model_primary"), "Gradient Boosting", D.LOCKED_PARAMS["Gradient Boosting"], T.Knobs(trees=2, seeds=(1, 2))).collect()
    assert made == {str(r.Split_Seed): int(0.75 * r.Train_n) for r in rows} and min(r.Train_n for r in rows) > 5500
