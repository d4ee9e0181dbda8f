"""Column lists, types and cut points of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

STAY = "patientunitstayid"


def _table(*, longs=(), strings=(), doubles=(), order) -> T.StructType:
    kinds = {c: T.LongType() for c in longs}
    kinds.update({c: T.StringType() for c in strings})
    kinds.update({c: T.DoubleType() for c in doubles})
    return T.StructType([T.StructField(c, kinds[c]) for c in order])


# Raw file names, the columns read from each, and their order.
RAW_FILES = {
    "patient": "patient.csv.gz",
    "vitals": "vitalPeriodic.csv.gz",
    "labs": "lab.csv.gz",
    "diagnosis": "diagnosis.csv.gz",
    "treatment": "treatment.csv.gz",
    "apache": "apachePatientResult.csv.gz",
}

PATIENT_COLUMNS = [
    STAY, "patienthealthsystemstayid", "age", "gender", "ethnicity",
    "admissionheight", "admissionweight", "unittype", "unitadmitsource",
    "unitdischargestatus", "hospitaldischargestatus", "apacheadmissiondx",
    "unitdischargeoffset", "hospitaladmitoffset",
]
VITAL_SIGNS = [
    "heartrate", "respiration", "sao2", "systemicsystolic",
    "systemicdiastolic", "temperature", "cvp",
]
VITALS_COLUMNS = [STAY, "observationoffset", *VITAL_SIGNS]
LABS_COLUMNS = [STAY, "labresultoffset", "labname", "labresult", "labresulttext"]
DIAGNOSIS_COLUMNS = [
    STAY, "diagnosisoffset", "diagnosisstring", "icd9code", "diagnosispriority",
]
TREATMENT_COLUMNS = [STAY, "treatmentoffset", "treatmentstring"]
APACHE_COLUMNS = [
    STAY, "apachescore", "predictedhospitalmortality",
    "actualhospitalmortality", "preoperation",
]

RAW_COLUMNS = {
    "patient": PATIENT_COLUMNS,
    "vitals": VITALS_COLUMNS,
    "labs": LABS_COLUMNS,
    "diagnosis": DIAGNOSIS_COLUMNS,
    "treatment": TREATMENT_COLUMNS,
    "apache": APACHE_COLUMNS,
}

PATIENT = T.StructType(
    _table(
        longs=[STAY, "patienthealthsystemstayid"],
        strings=[
            "gender", "ethnicity", "unittype", "unitadmitsource",
            "unitdischargestatus", "hospitaldischargestatus", "apacheadmissiondx",
        ],
        doubles=[
            "age", "admissionheight", "admissionweight",
            "unitdischargeoffset", "hospitaladmitoffset",
        ],
        order=PATIENT_COLUMNS,
    ).fields
    + [T.StructField("hospital_mortality", T.IntegerType())]
)
VITALS = _table(
    longs=[STAY], doubles=["observationoffset", *VITAL_SIGNS], order=VITALS_COLUMNS
)
LABS = _table(
    longs=[STAY], strings=["labname", "labresulttext"],
    doubles=["labresultoffset", "labresult"], order=LABS_COLUMNS,
)
DIAGNOSIS = _table(
    longs=[STAY], strings=["diagnosisstring", "icd9code", "diagnosispriority"],
    doubles=["diagnosisoffset"], order=DIAGNOSIS_COLUMNS,
)
TREATMENT = _table(
    longs=[STAY], strings=["treatmentstring"],
    doubles=["treatmentoffset"], order=TREATMENT_COLUMNS,
)
APACHE = _table(
    longs=[STAY], strings=["actualhospitalmortality", "preoperation"],
    doubles=["apachescore", "predictedhospitalmortality"], order=APACHE_COLUMNS,
)
CLEAN_SCHEMAS = {
    "patient": PATIENT, "vitals": VITALS, "labs": LABS,
    "diagnosis": DIAGNOSIS, "treatment": TREATMENT, "apache": APACHE,
}

# Inclusive plausible ranges; a row outside any of them is dropped.
VITAL_RANGES = {"heartrate": (0.0, 300.0), "sao2": (50.0, 100.0), "temperature": (25.0, 45.0)}

# Labs that become feature columns, matched without regard to case.
KEY_LABS = ["creatinine", "glucose", "potassium", "sodium", "lactate", "hemoglobin", "wbc"]

VITAL_AGGREGATES = [
    "hr_mean", "hr_std", "sao2_mean", "sao2_min",
    "resp_mean", "sbp_mean", "dbp_mean", "temp_mean",
]

# Columns of the serving tables.
SERVING_COLUMNS = {
    "patients": [
        STAY, "age", "gender", "ethnicity", "admissionheight", "admissionweight",
        "unittype", "unitadmitsource", "unitdischargestatus", "hospitaldischargestatus",
        "hospital_mortality", "apachescore", "predictedhospitalmortality",
        "unitdischargeoffset", *VITAL_AGGREGATES,
    ],
    "vitals": VITALS_COLUMNS,
    "labs": [STAY, "labresultoffset", "labname", "labresult"],
    "diagnosis": DIAGNOSIS_COLUMNS,
    "treatments": TREATMENT_COLUMNS,
}
SERVING_TIME = {
    "patients": None, "vitals": "observationoffset", "labs": "labresultoffset",
    "diagnosis": "diagnosisoffset", "treatments": "treatmentoffset",
}

# Model inputs in order, and the target.
FEATURES = [
    "age", "admissionheight", "admissionweight", "apachescore",
    "predictedhospitalmortality", *VITAL_AGGREGATES, "gender_enc", "unittype_enc",
]
TARGET = "hospital_mortality"

# Right-closed age groups as (above, up to, label).
AGE_GROUPS = [
    (0, 18, "<18"), (18, 40, "18-40"), (40, 60, "40-60"), (60, 75, "60-75"), (75, 120, "75+"),
]

# Risk cut points and texts.
HIGH_RISK, MODERATE_RISK = 0.7, 0.4
FLAG_RISK, FLAG_APACHE = 0.5, 60.0

# Forecast settings. Five vitals, one step every five minutes.
FORECAST_VITALS = ["heartrate", "respiration", "sao2", "systemicsystolic", "temperature"]
FORECAST_SPAN = 5
FORECAST_STD_ROWS = 10
FORECAST_TREND_ROWS = 5
FORECAST_TREND_SHARE = 0.3
FORECAST_NOISE_SHARE = 0.2
FORECAST_MIN_ROWS = 3
STEP_MINUTES = 5.0
HISTORY_ROWS = 50
MAX_POINTS = 200

# Result sizes of the reports.
PAGE_ROWS, MAX_PAGE_ROWS = 100, 500
TOP_UNITS, TOP_DIAGNOSES, TOP_LABS, DEFAULT_LABS, TOP_FEATURES = 10, 15, 8, 4, 5

# Texts that count as missing when a delimited file is read.
MISSING_TOKENS = [
    "", "NA", "N/A", "n/a", "NaN", "nan", "-NaN", "-nan", "NULL", "null", "None", "<NA>",
    "#N/A", "#NA", "#N/A N/A", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
]

# Columns of the search result.
DISPLAY_COLUMNS = [
    STAY, "age", "gender", "unittype", "apachescore", "hospital_mortality", "ml_risk_score",
]
