"""Storage, the batch build, and the model, on small gzip files."""

import gzip
import shutil

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from acuity import schemas
from acuity.operators import forest, model
from acuity.plans import build
from acuity.plans.store import CohortStore
from acuity.schemas import STAY, TARGET
from acuity.sources import cache, storage

N = 300
FOREST = dict(numTrees=10, maxDepth=4)


def write(folder, name, lines):
    header = ",".join(["extra", *schemas.RAW_COLUMNS[name]])
    with gzip.open(folder / schemas.RAW_FILES[name], "wt") as f:
        f.write("\n".join([header, *(f"z,{x}" for x in lines)]) + "\n")


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    """Stays 0..299; the severity score decides who dies."""
    folder, rng = tmp_path_factory.mktemp("raw"), np.random.default_rng(0)
    severity = rng.uniform(10, 110, N).round(1)
    units = ["MICU", "SICU", "", "CCU"]
    write(folder, "patient", [
        f"{i},{i},{'> 89' if i % 10 == 0 else 20 + i % 60},{'Male' if i % 2 else ''},,170,80,"
        f"{units[i % 4]},ER,Alive,{'Expired' if s > 80 else 'Alive'},Sepsis,600,-5"
        for i, s in enumerate(severity)
    ])
    write(folder, "vitals", [
        f"{i},{t * 5.0},{80 + t + s / 10:.1f},{'' if t % 3 else 20},{96 - t},120,70,37.0,"
        for i, s in enumerate(severity) for t in range(6)
    ])
    write(folder, "labs", [f"{i},{i}.0,{n},{v},t" for i in range(N)
                           for n, v in (("Sodium", 140), ("wbc", "<5"), ("alt", 3), ("glucose", ""))])
    write(folder, "diagnosis", [f"{i},1,d{i % 3},{i}.5,Primary" for i in range(N)])
    write(folder, "treatment", [f"{i},2,t{i % 2}" for i in range(N)])
    write(folder, "apache", [f"{i},{s},{s / 120:.3f},ALIVE,No" for i, s in enumerate(severity)])
    return str(folder)


@pytest.fixture(scope="module")
def out(tmp_path_factory):
    return str(tmp_path_factory.mktemp("out"))


@pytest.fixture(scope="module")
def built(spark, raw, out):
    return build.run(spark, raw, out, partitions=4, **FOREST)


def test_clean_tables_have_fixed_schemas(built):
    for name, schema in schemas.CLEAN_SCHEMAS.items():
        assert [(f.name, f.dataType) for f in built.clean[name].schema] == [
            (f.name, f.dataType) for f in schema
        ]
    assert {n: df.count() for n, df in built.clean.items()} == {
        "patient": N, "vitals": 6 * N, "labs": 3 * N, "diagnosis": N, "treatment": N, "apache": N,
    }


def test_features(built):
    assert built.features.count() == N
    row = built.features.filter(f"{STAY} = 10").first()
    assert row["age"] == 90 and row["gender"] == "Unknown" and row["lab_sodium"] == 140
    assert row["sao2_min"] == 91 and row["lab_wbc"] is None


def test_serving_tables(spark, built, out):
    for name, columns in schemas.SERVING_COLUMNS.items():
        got = storage.load_serving(spark, name, f"{out}/serving")
        extra = ["ml_risk_score", "ml_prediction"] if name == "patients" else []
        assert got.columns == [*columns, *extra]
    types = dict(storage.load_serving(spark, "patients", f"{out}/serving").dtypes)
    assert (types["ml_risk_score"], types["ml_prediction"]) == ("double", "int")


def test_training(built):
    done = built.training
    assert done.auc.first()["auc"] > 0.9
    summary = done.summary.first()
    assert summary["rows"] == N and 0.2 < summary["positive_rate"] < 0.4
    report = {r["class"]: r for r in done.report.collect()}
    assert report["accuracy"]["f1"] > 0.85 and report["accuracy"]["support"] in (60, 61)
    assert done.model.features == schemas.FEATURES


def test_second_run_uses_what_is_stored(spark, built, raw, out, monkeypatch):
    monkeypatch.setattr(build, "scan_table", lambda *a, **k: pytest.fail("scanned again"))
    again = build.run(spark, raw, out)
    assert again.training is None and again.features.count() == N


def test_scoring_and_write_back(spark, built, out):
    loaded = model.load(spark, f"{out}/model")
    patients = storage.load_serving(spark, "patients", f"{out}/serving")
    scored = model.score(patients, loaded)
    live = model.score(patients, built.training.model)
    assert scored.exceptAll(live).isEmpty() and loaded.features == schemas.FEATURES
    assert loaded.medians == pytest.approx(built.training.model.medians)
    assert loaded.scale.keys() == set(schemas.FEATURES)

    path = build.score_all(spark, out)
    stored = spark.read.parquet(path)
    assert stored.columns == patients.columns and stored.count() == N
    assert stored.filter("ml_risk_score is null or ml_prediction is null").isEmpty()
    both = stored.join(scored.select(STAY, "risk_score"), STAY)
    assert both.filter("ml_risk_score <> risk_score").isEmpty()


def test_store(spark, built, out):
    store = CohortStore(spark, out)
    stats = store.stats().first()
    assert stats["total_patients"] == N and stats["model_ready"] is True
    assert [r[STAY] for r in store.patients(3, 2).collect()] == [2, 3, 4]
    assert store.patients(500, search="micu").count() == N // 4
    assert store.patients(500, high_risk_only=True).count() > 50
    assert store.patient(7).first()[STAY] == 7
    with pytest.raises(LookupError):
        store.patient(N)
    assert store.vitals(7).count() == 6 and store.vitals([7, 8], max_points=2).count() == 4
    assert store.labs(7).count() == 3 and store.diagnosis(7).count() == 1
    assert store.treatments([7, 9]).count() == 2
    row = store.predict(7).first()
    assert 0 <= row["risk_score"] <= 1 and row["risk_label"] in ("LOW", "MODERATE", "HIGH")
    assert store.top_features().count() == 5
    ahead = store.forecast(7, steps=3).collect()
    # Respiration has two values only.
    assert len(ahead) == 4 * 3 and {r["observationoffset"] for r in ahead} == {30.0, 35.0, 40.0}
    assert store.forecast_line(7, steps=3).count() == 4 * 4 and store.history(7).count() == 6
    assert store.unit_breakdown().count() == 4 and store.mortality_by_age().count() == 4
    assert store.top_diagnoses(2).count() == 2 and store.severity_box().count() == 2
    assert store.lab_summary(7).count() == 3 and store.frequent_labs(7).count() == 3
    for missing in (store.predict, store.forecast, store.forecast_line):
        with pytest.raises(LookupError):
            missing(N)
    assert store.predict([7, N]).count() == 1
    with pytest.raises(LookupError):
        CohortStore(spark, f"{out}/clean").predict(7)


def test_scores_match_labels(built):
    scored = model.score(built.features, built.training.model, digits=None)
    wrong = F.when(F.col("risk_score") >= 0.7, F.col("risk_label") != "HIGH").when(
        F.col("risk_score") >= 0.4, F.col("risk_label") != "MODERATE"
    ).otherwise(F.col("risk_label") != "LOW")
    assert scored.filter(wrong).isEmpty()
    assert scored.filter((F.col("risk_score") > 0.5) != (F.col("prediction") == 1)).isEmpty()


@pytest.mark.parametrize("missing", ["median", "zero"])
def test_missing_features(spark, built, missing):
    """Scoring fills what is missing, as if the rows had the medians or zeros in place."""
    fitted = built.training.model
    rows = spark.createDataFrame(
        [(i, float(10 + i)) for i in range(100)], f"{STAY} long, apachescore double"
    )
    values = {
        c: fitted.medians[c] if missing == "median" else 0.0
        for c in fitted.features if not c.endswith("_enc") and c != "apachescore"
    }
    explicit = rows.withColumns({c: F.lit(v) for c, v in values.items()})
    keep = [STAY, "risk_score", "risk_label", "prediction"]
    got = model.score(rows, fitted, missing=missing, digits=None).select(keep)
    want = model.score(explicit, fitted, digits=None).select(keep)
    assert got.count() == 100 and got.exceptAll(want).isEmpty()
    assert values["age"] == (0.0 if missing == "zero" else fitted.medians["age"])


def test_importances(spark, built):
    every = model.importances(spark, built.training.model).collect()
    assert len(every) == len(schemas.FEATURES)
    assert sum(r["importance"] for r in every) == pytest.approx(1)
    top = model.top_features(spark, built.training.model).collect()
    assert len(top) == 5 and top == every[:5]
    assert {"apachescore", "predictedhospitalmortality"} & {r["feature"] for r in top[:2]}


def test_stored_nodes_give_scores_and_importances(spark, built, tmp_path):
    """The fitted forest against its node table: walked by another engine, and as one expression."""
    noisy = built.features.withColumn(TARGET, F.when(F.col(STAY) % 5 == 0, 1 - F.col(TARGET)).otherwise(F.col(TARGET)))
    fitted, out = model.train(noisy, **FOREST).model, str(tmp_path)
    model.save(spark, fitted, f"{out}/model")
    nodes = model.load_nodes(spark, f"{out}/model")
    assert nodes.columns == forest.NODE_COLUMNS and nodes.select("tree").distinct().count() == 10
    want = {r[STAY]: r["risk_score"] for r in model.score(built.features, fitted, digits=None).collect()}
    assert len(set(want.values())) > 5
    compiled = model.score_by_nodes(built.features, model.load(spark, f"{out}/model"), nodes)
    assert {r[STAY]: r["risk_score"] for r in compiled.collect()} == pytest.approx(want, abs=1e-12)

    con = duckdb.connect()
    inputs = model.filled_inputs(built.features, fitted)
    rows = inputs.select(STAY, *[F.col(f"_in_{c}").alias(c) for c in fitted.features]).toPandas()
    con.register("seen", rows)
    con.register("nodes", nodes.toPandas())
    walked = con.execute(forest.walk_sql("seen", "nodes", STAY, fitted.features)).fetchall()
    assert dict(walked) == pytest.approx(want, abs=1e-12)

    importances = {r["feature"]: r["importance"] for r in model.importances(spark, fitted).collect()}
    gains = con.execute("""
        with g as (select tree, feature, sum(gain * weight) as g from nodes
                   where feature is not null group by tree, feature),
        s as (select feature, g / sum(g) over (partition by tree) as s from g)
        select feature, sum(s) / sum(sum(s)) over () from s group by feature""").fetchall()
    by_nodes = {r["feature"]: r["importance"] for r in forest.importances(nodes).collect()}
    assert by_nodes == pytest.approx(dict(gains)) == {k: pytest.approx(v) for k, v in importances.items() if v}


def test_rows_keep_their_places_in_the_trees(built):
    """Passes over the training rows do not walk the trees again, and the forest is the one that walking grows."""
    kept = model.train(built.features, **FOREST).model.stages.stages[-1]
    walked = model.train(built.features, **FOREST, cacheNodeIds=False).model.stages.stages[-1]
    assert kept.getCacheNodeIds() and not walked.getCacheNodeIds()
    trees = lambda fitted: [t.toDebugString.split("\n", 1)[1] for t in fitted.trees]
    assert trees(kept) == trees(walked)


def test_a_forest_of_single_leaves(spark):
    nodes = spark.createDataFrame(
        [(t, 0, None, None, None, None, None, 5.0, s) for t, s in ((0, 0.25), (1, 0.75))],
        "tree int, node int, feature string, threshold double, left_node int, right_node int, gain double,"
        "weight double, share double")
    got = spark.range(3).select(forest.score_column(nodes, {}).alias("s")).collect()
    assert [r["s"] for r in got] == [0.5] * 3 and forest.importances(nodes).isEmpty()


def test_medians_from_the_whole_table(built):
    whole = model.train(built.features, medians_from="whole", **FOREST).model.medians
    want = built.features.agg(F.median("apachescore")).first()[0]
    assert whole["apachescore"] == pytest.approx(want)


def test_retrain_and_restricted_load(spark, built, raw, out):
    assert model.is_trained(spark, f"{out}/model")
    assert not model.is_trained(spark, f"{out}/nowhere")
    stays = spark.createDataFrame([(3,), (5,)], f"{STAY} long")
    part = build.clean_table(spark, raw, out, "vitals", stays=stays)
    assert part.count() == 12
    listed = build.clean_table(spark, raw, out, "vitals", stays=[3, 5, 5])
    assert listed.count() == 12


def test_read_through(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def make(n):
        def run():
            calls.append(n)
            return spark.range(n)

        return run

    assert cache.read_through(spark, path, make(3)).count() == 3
    assert cache.read_through(spark, path, make(4)).count() == 3
    assert cache.read_through(spark, path, make(5), refresh=True).count() == 5
    assert cache.read_through(spark, path, make(6), dedupe=True).count() == 6
    assert cache.read_through(spark, path, make(7), dedupe=True).count() == 6
    assert cache.read_through(spark, path, make(8)).count() == 8
    assert calls == [3, 5, 6, 8]


def test_changed_source_is_noticed(spark, tmp_path):
    source, path = tmp_path / "raw", str(tmp_path / "t")
    source.mkdir()
    (source / "a.txt").write_text("one\n")
    read = lambda: cache.read_through(
        spark, path, lambda: spark.read.text(str(source)), sources=[str(source)])
    first = read()
    before = cache.version(spark, path)
    assert read().count() == 1 and cache.version(spark, path) == before
    (source / "b.txt").write_text("two\n")
    assert read().count() == 2 and cache.version(spark, path) != before
    assert first.count() == 1  # a reader of the old version keeps it
    assert cache.drop_old(spark, path) == [before] and read().count() == 2
    with pytest.raises(Exception, match="not exist"):
        cache.read_through(spark, path, lambda: spark.range(1), sources=[f"{source}/none"])


def test_build_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    cache.read_through(spark, path, lambda: spark.range(3))
    for at in ("build", "commit", "manifest"):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            if at != "build":
                def torn(spark, path, *more):
                    if at == "manifest":  # cut off while the manifest is written
                        (tmp_path / "t" / "manifest-000000000007.json").write_text('{"number": 7, "da')
                    raise RuntimeError

                m.setattr(cache, "commit", torn)

            def make():
                if at == "build":
                    raise RuntimeError
                return spark.range(9)

            cache.read_through(spark, path, make, refresh=True)
        assert cache.read_through(spark, path, lambda: pytest.fail("built again")).count() == 3
    assert cache.read_through(spark, path, lambda: spark.range(4), refresh=True).count() == 4
    assert cache.current(spark, path).number == 8 and len(cache.drop_old(spark, path)) == 3
    assert cache.read_through(spark, path, lambda: pytest.fail("built again")).count() == 4


def test_commits_at_once_get_numbers_of_their_own(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    cache.read_through(spark, path, lambda: spark.range(1))
    monkeypatch.setattr(cache, "_numbers", lambda *a: [])  # as if the other had not been there yet
    assert cache.commit(spark, path, "data-x", {}, {}).number == 2


def test_features_follow_a_changed_raw_file(spark, raw, tmp_path):
    folder, out = tmp_path / "raw", str(tmp_path / "out")
    shutil.copytree(raw, folder)
    build.run(spark, str(folder), out, **FOREST)
    versions = {n: cache.version(spark, f"{out}/clean/{n}") for n in schemas.RAW_FILES}
    write(folder, "apache", [f"{i},{200 + i},0.5,ALIVE,No" for i in range(N)])
    again = build.run(spark, str(folder), out)
    changed = {n for n, v in versions.items() if cache.version(spark, f"{out}/clean/{n}") != v}
    assert changed == {"apache"} and again.features.agg(F.min("apachescore")).first()[0] == 200


def test_catalog_table(spark):
    df = spark.createDataFrame([(1, 60.0, "x")], f"{STAY} long, age double, other string")
    storage.save_serving(df, "patients")
    storage.save_serving(df, "patients")
    got = storage.load_serving(spark, "patients")
    assert got.columns == [STAY, "age", "ml_risk_score", "ml_prediction"] and got.count() == 1
    spark.sql("drop table patients")


def test_keyed_layout_spreads_a_hot_stay(spark, tmp_path):
    """Files hold ranges of the key; copies of one row do not end up in one file."""
    rows = spark.range(4000).select(
        F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50).cast("long").alias(STAY),
        F.lit(1.0).alias("observationoffset"),
    )
    rows = storage.stage(rows)
    path = str(tmp_path / "keyed")
    storage.write_keyed(rows, path, [STAY, "observationoffset"], files=8)
    stored = spark.read.parquet(path)
    assert stored.count() == 4000
    name = F.input_file_name()
    sizes = stored.groupBy(name.alias("f")).agg(F.count("*").alias("n"), F.min(STAY), F.max(STAY))
    assert max(r["n"] for r in sizes.collect()) < 1200
    assert stored.filter(f"{STAY} = 7").select(name).distinct().count() >= 3


def test_scratch_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert storage.scratch_path(spark, "x").startswith(folder)
    assert storage.scratch_path(spark, "x") != storage.scratch_path(spark, "x")


def test_drop_scratch(spark, monkeypatch):
    monkeypatch.setattr(storage, "_scratch", [])
    kept = storage.scratch_path(spark, "a")
    storage.stage(spark.range(3))
    paths = list(storage._scratch)
    assert len(paths) == 2 and storage.exists(spark, paths[1]) and not storage.exists(spark, kept)
    storage.drop_scratch(spark)
    assert storage._scratch == [] and not storage.exists(spark, paths[1])


def test_scratch_falls_back_to_the_warehouse(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "store://w/"}.get(key, default)

    class Session:
        conf = Conf()

    monkeypatch.setattr(storage, "_scratch", [])
    assert storage.scratch_path(Session(), "x").startswith("store://w/acuity-scratch/acuity-x-")


def test_new_cohort_drops_old_scores(spark, raw, tmp_path):
    from acuity.plans.store import CohortStore

    out = str(tmp_path / "out")
    build.run(spark, raw, out, **FOREST)
    build.score_all(spark, out)
    store = CohortStore(spark, out)
    assert store.table("patients").filter("ml_risk_score is not null").count() > 0
    build.run(spark, raw, out, refresh=True, **FOREST)
    again = store.table("patients")
    assert again.filter("ml_risk_score is not null").count() == 0
    assert again.count() == store.stats().first()["total_patients"]


def test_target_column(built):
    assert dict(built.features.dtypes)[TARGET] == "int"
