"""Projected scans of delimited files with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acuity import schemas
from acuity.functions.scalars import blank_to_null


def scan_csv(
    spark: SparkSession,
    path: str,
    columns: list[str],
    *,
    multiline: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Read ``columns`` of a delimited file (or folder of files) as text.

    Columns are picked by header name, never by position, and missing-value texts become
    null. A missing file or column raises ``AnalysisException``. Fields may hold line breaks
    in quotes, so a file is one split, as a gzip file is anyway; ``multiline=False`` splits
    plain files that have none. Where there are fewer splits than the cluster has task slots,
    their rows are spread over ``partitions`` tasks (as many as slots without it).
    """
    rows = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
        .select(*columns)
    )
    if partitions is None and (multiline or path.rstrip("/").endswith(".gz")):
        slots = spark.sparkContext.defaultParallelism
        partitions = slots if len(rows.inputFiles()) < slots else None
    if partitions is not None:
        rows = rows.repartition(partitions)
    return rows.select(*[blank_to_null(F.col(c)).alias(c) for c in columns])


def scan_table(spark: SparkSession, folder: str, name: str, **options) -> DataFrame:
    """Scan one of the six raw tables under ``folder`` with its fixed column list."""
    path = f"{folder.rstrip('/')}/{schemas.RAW_FILES[name]}"
    return scan_csv(spark, path, schemas.RAW_COLUMNS[name], **options)
