"""The star-schema test tables seen as the six raw tables.

Customers are patients, events are vital signs, orders are severity results, and order lines
are labs, diagnoses and treatments. All rows of the source tables are used. Missing values,
unknown texts and odd keys are worked in so that the cleaning rules have something to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acuity.operators import clean
from acuity.operators.features import feature_table as build_features
from acuity.operators.skew import key_shares, left_join
from acuity.schemas import STAY


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Minutes since the start of 2024, without going through the session's time zone.
_MINUTES = """
  cast((unix_date(to_date(ts)) - unix_date(date'2024-01-01')) * 86400000000L
       + hour(ts) * 3600000000L + minute(ts) * 60000000L
       + cast(extract(second from ts) * 1000000 as bigint) as double) / 60000000D
"""


def raw_patients(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        f"c_custkey as {STAY}",
        """case when c_custkey % 50 = 7 then null when c_custkey % 47 = 3 then 'n/a'
                when (c_custkey * 31) % 100 > 89 then '> 89'
                else cast((c_custkey * 31) % 100 as string) end as age""",
        """case c_custkey % 4 when 0 then 'Male' when 1 then 'Female'
                when 2 then 'male' else null end as gender""",
        "case when c_nationkey < 3 then null else cast(c_nationkey as string) end as ethnicity",
        """case when c_custkey % 9 = 0 then null
                else cast(150 + c_custkey % 50 as double) end as admissionheight""",
        "50D + c_acctbal / 200D as admissionweight",
        """case when c_custkey % 6 = 0 then null
                else cast((c_custkey * 17) % 1001 as double) / 1000D end as ml_risk_score""",
        "c_mktsegment as unittype",
        """case when c_custkey % 29 = 0 then null when c_acctbal < 500 then 'Expired'
                when c_acctbal < 1000 then 'EXPIRED' else 'Alive' end as hospitaldischargestatus""",
    )


def raw_vitals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        f"user_id as {STAY}",
        f"{_MINUTES} as observationoffset",
        "case when event_id % 11 = 0 then null else value + 40D end as heartrate",
        "case when event_id % 17 = 0 then null else 12D + value / 20D end as respiration",
        "case when event_id % 13 = 0 then null else 100D - value / 4D end as sao2",
        "90D + value / 3D as systemicsystolic",
        "case when event_id % 9 = 0 then null else 55D + value / 5D end as systemicdiastolic",
        "case when event_id % 7 = 0 then null else 37D + (value - 50D) / 20D end as temperature",
        "case when event_type = 'error' then value / 10D else null end as cvp",
    )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def _lines_and_parts(spark: SparkSession, folder: str) -> DataFrame:
    lines, parts = _lines(spark, folder), table(spark, folder, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey)


def raw_labs(spark: SparkSession, folder: str) -> DataFrame:
    return _lines_and_parts(spark, folder).selectExpr(
        f"o_custkey as {STAY}",
        "cast(l_linenumber * 1440 as double) as labresultoffset",
        """case p_type when 'MEDIUM' then 'creatinine' when 'STANDARD' then 'glucose'
                when 'LARGE' then 'potassium' when 'PROMO' then 'Sodium'
                when 'SMALL' then 'lactate' else 'alt' end as labname""",
        """case when l_partkey % 97 = 0 then '<5' when l_partkey % 89 = 0 then null
                else cast(l_quantity as string) end as labresult""",
    )


def raw_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    return _lines_and_parts(spark, folder).selectExpr(
        f"""concat(cast(o_custkey as string), case l_linenumber when 6 then '.7'
                   when 7 then 'x' else '' end) as {STAY}""",
        "cast(l_linenumber * 60 as double) as diagnosisoffset",
        "p_brand as diagnosisstring",
        "cast(100 + p_size as string) as icd9code",
        "case when l_linenumber = 1 then 'Primary' else 'Secondary' end as diagnosispriority",
    )


def raw_treatment(spark: SparkSession, folder: str) -> DataFrame:
    return _lines_and_parts(spark, folder).selectExpr(
        f"o_custkey as {STAY}",
        "cast(l_linenumber * 30 as double) as treatmentoffset",
        "p_name as treatmentstring",
    )


def raw_apache(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        f"""case o_orderpriority when '5-LOW' then 'unknown'
                else cast(o_custkey as string) end as {STAY}""",
        "o_totalprice / 5000D as apachescore",
        """case when o_orderstatus = 'P' then null
                else 1D / (1D + exp(-(o_totalprice / 5000D - 60D) / 15D))
                end as predictedhospitalmortality""",
    )


def patients(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_patients(raw_patients(spark, folder))


def vitals(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_vitals(raw_vitals(spark, folder))


def labs(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_labs(raw_labs(spark, folder))


def diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_diagnosis(raw_diagnosis(spark, folder))


def treatment(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_treatment(raw_treatment(spark, folder))


def apache(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_apache(raw_apache(spark, folder))


def scored_patients(spark: SparkSession, folder: str) -> DataFrame:
    """Patients with their severity results; several results repeat a patient."""
    left, right = patients(spark, folder), apache(spark, folder)
    return left_join(left, right, STAY, key_shares(left, right, STAY))


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return build_features(
        patients(spark, folder), apache(spark, folder),
        vitals(spark, folder), labs(spark, folder),
    )


#: The raw tables by the names of their files.
RAW = {
    "patient": raw_patients, "vitals": raw_vitals, "labs": raw_labs, "diagnosis": raw_diagnosis,
    "treatment": raw_treatment, "apache": raw_apache,
}
