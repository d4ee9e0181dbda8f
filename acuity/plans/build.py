"""The batch build: raw files to clean tables, features, serving tables and a model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from acuity import schemas
from acuity.operators import features as feature_ops
from acuity.operators import model as model_ops
from acuity.operators.clean import CLEANERS
from acuity.sources import cache, storage
from acuity.sources.raw import scan_table

# Serving table of each clean table.
SERVED = {"vitals": "vitals", "labs": "labs", "diagnosis": "diagnosis", "treatment": "treatments"}
_FEATURE_TABLES = ["patient", "apache", "vitals", "labs"]


@dataclass
class Build:
    clean: dict[str, DataFrame]
    features: DataFrame
    training: model_ops.Training | None


def clean_table(
    spark: SparkSession, raw_dir: str, out_dir: str, name: str, *,
    refresh: bool = False, stays=None, **scan,
) -> DataFrame:
    """A clean table, from its stored copy if there is one and the raw file is still the same.

    Restricted to ``stays``, it is always read from the raw file and not stored.
    """
    if stays is not None:
        return CLEANERS[name](scan_table(spark, raw_dir, name, **scan), stays)

    def build() -> DataFrame:
        return CLEANERS[name](scan_table(spark, raw_dir, name, **scan))

    source = f"{raw_dir.rstrip('/')}/{schemas.RAW_FILES[name]}"
    return cache.read_through(
        spark, f"{out_dir}/clean/{name}", build, sources=[source], refresh=refresh,
        bloom=schemas.STAY,
    )


def run(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    *,
    refresh: bool = False,
    retrain: bool = False,
    partitions: int | None = None,
    apache_dedupe: bool = False,
    files: int | None = None,
    train: bool = True,
    **training,
) -> Build:
    """Build everything under ``out_dir``; what is stored already is not built again.

    A table stored with other parameters, or from other raw files, is built again, and with
    it what depends on it. Serving tables are always
    overwritten, and scores stored for the patients before are dropped. A stored model is
    kept unless ``retrain``; with ``train`` false none is made.
    """
    scan = {"partitions": partitions}
    clean = {
        name: clean_table(spark, raw_dir, out_dir, name, refresh=refresh, **scan)
        for name in schemas.RAW_FILES
    }
    inputs = {name: cache.version(spark, f"{out_dir}/clean/{name}") for name in _FEATURE_TABLES}
    table = cache.read_through(
        spark,
        f"{out_dir}/ml_dataset",
        lambda: feature_ops.feature_table(
            clean["patient"], clean["apache"], clean["vitals"], clean["labs"],
            apache_dedupe=apache_dedupe,
        ),
        refresh=refresh,
        apache_dedupe=apache_dedupe,
        inputs=inputs,
    )
    serving = f"{out_dir}/serving"
    # Scores belong to the cohort they were made for; the new one starts without.
    storage.remove(spark, f"{serving}/patients_scored")
    storage.save_serving(table, "patients", serving, files=files)
    for name, target in SERVED.items():
        storage.save_serving(clean[name], target, serving, files=files)

    done = None
    if train and (retrain or not model_ops.is_trained(spark, f"{out_dir}/model")):
        done = model_ops.train(table, **training)
        model_ops.save(spark, done.model, f"{out_dir}/model")
    return Build(clean, table, done)


def score_all(spark: SparkSession, out_dir: str, *, missing: str = "median") -> str:
    """Score the stored patients and store them with their scores; returns the new path."""
    patients = storage.load_serving(spark, "patients", f"{out_dir}/serving")
    model = model_ops.load(spark, f"{out_dir}/model")
    scores = model_ops.score(patients, model, missing=missing).select(
        schemas.STAY, "risk_score", "prediction"
    )
    path = f"{out_dir}/serving/patients_scored"
    scored = storage.stage(feature_ops.write_back_scores(patients, scores), "scored")
    storage.write_keyed(scored, path, [schemas.STAY])
    return path
