"""The questions a caller asks of a finished build, each answered as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acuity import schemas
from acuity.functions import scalars as S
from acuity.operators import analytics, cohort, model, series
from acuity.operators.clean import restrict_to_stays
from acuity.operators.cohort import Stays
from acuity.schemas import STAY
from acuity.sources import storage


@dataclass
class CohortStore:
    """Reads the serving tables and the model under ``out_dir``.

    Where a method takes ``stays`` it takes one stay, a list, a DataFrame, or None for all.
    """

    spark: SparkSession
    out_dir: str

    def table(self, name: str) -> DataFrame:
        """A serving table; patients with their scores once these are stored."""
        root = f"{self.out_dir}/serving"
        if name == "patients" and storage.is_stored(self.spark, f"{root}/patients_scored"):
            name = "patients_scored"
        return storage.load_serving(self.spark, name, root)

    def _rows(self, name: str, stays: Stays) -> DataFrame:
        """Rows of the given stays; a single stay without rows is an error."""
        rows = restrict_to_stays(self.table(name), stays)
        if isinstance(stays, int) and rows.isEmpty():
            raise LookupError(f"stay {stays} has no rows in {name}")
        return rows

    def stats(self) -> DataFrame:
        ready = model.is_trained(self.spark, f"{self.out_dir}/model")
        return analytics.cohort_stats(self.table("patients")).withColumn(
            "model_ready", F.lit(ready)
        )

    def patients(self, limit: int = schemas.PAGE_ROWS, offset: int = 0,
                 search: str | None = None, high_risk_only: bool = False) -> DataFrame:
        return S.finite(
            cohort.search_page(self.table("patients"), search, high_risk_only, limit, offset)
        )

    def patient(self, stay: int) -> DataFrame:
        return S.finite(cohort.patient(self.table("patients"), stay))

    def vitals(self, stays: Stays = None, max_points: int = schemas.MAX_POINTS) -> DataFrame:
        thinned = series.downsample(restrict_to_stays(self.table("vitals"), stays), max_points)
        return cohort.vitals_of(S.finite(thinned))

    def labs(self, stays: Stays = None) -> DataFrame:
        return cohort.labs_of(S.finite(self.table("labs")), stays)

    def diagnosis(self, stays: Stays = None) -> DataFrame:
        return cohort.diagnoses_of(self.table("diagnosis"), stays)

    def treatments(self, stays: Stays = None) -> DataFrame:
        return cohort.treatments_of(self.table("treatments"), stays)

    def predict(self, stays: Stays = None) -> DataFrame:
        """Score, label and class per patient row; an untrained model is an error."""
        path = f"{self.out_dir}/model"
        if not model.is_trained(self.spark, path):
            raise LookupError("no model is stored; run the build first")
        rows = self._rows("patients", stays)
        return model.score(rows, model.load(self.spark, path)).select(
            STAY, "risk_score", "risk_label", "prediction"
        )

    def top_features(self) -> DataFrame:
        return model.top_features(self.spark, model.load(self.spark, f"{self.out_dir}/model"))

    def forecast(self, stays: Stays = None, steps: int = 6, seed: int | None = None) -> DataFrame:
        return series.forecast(self._rows("vitals", stays), steps, seed=seed)

    def forecast_line(self, stays: Stays = None, steps: int = 6, seed: int | None = None
                      ) -> DataFrame:
        return series.forecast_line(self._rows("vitals", stays), steps, seed=seed)

    def history(self, stays: Stays = None) -> DataFrame:
        return series.history(restrict_to_stays(self.table("vitals"), stays))

    def search_counts(self, limit: int = schemas.PAGE_ROWS, offset: int = 0,
                      search: str | None = None, high_risk_only: bool = False) -> DataFrame:
        return cohort.search_counts(self.table("patients"), search, high_risk_only, limit, offset)

    def display_rows(self) -> DataFrame:
        return cohort.display_rows(self.table("patients"))

    def lab_lines(self, names: list[str], stays: Stays = None) -> DataFrame:
        return cohort.lab_lines(S.finite(self.table("labs")), names, stays)

    def vital_line(self, vital: str, stays: Stays = None) -> DataFrame:
        rows = restrict_to_stays(self.table("vitals"), stays)
        return series.long_form(S.finite(rows), [vital])

    def unit_share(self) -> DataFrame:
        return analytics.unit_share(self.table("patients"))

    def top_units(self, n: int = schemas.TOP_UNITS) -> DataFrame:
        return analytics.top_units(self.table("patients"), n)

    def unit_breakdown(self) -> DataFrame:
        return analytics.unit_breakdown(self.table("patients"))

    def mortality_by_age(self) -> DataFrame:
        return analytics.mortality_by_age(self.table("patients"))

    def top_diagnoses(self, limit: int = schemas.TOP_DIAGNOSES) -> DataFrame:
        return analytics.top_diagnoses(self.table("diagnosis"), limit)

    def severity_box(self) -> DataFrame:
        return analytics.box_summary(self.table("patients"))

    def lab_summary(self, stays: Stays = None) -> DataFrame:
        return analytics.lab_summary(restrict_to_stays(self.table("labs"), stays))

    def frequent_labs(self, stays: Stays = None) -> DataFrame:
        return analytics.frequent_labs(restrict_to_stays(self.table("labs"), stays))
