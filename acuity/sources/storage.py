"""Stored tables: serving tables, keyed layout, buckets, shared scratch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from acuity import schemas


#: Rows of one key that a single task may have to hold.
HOT_ROWS = 2_000_000


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path objects for ``path``."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    system, target = file_system(spark, path)
    return system.exists(target)


def is_stored(spark: SparkSession, path: str) -> bool:
    """A table counts as stored once its write has been committed."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table, if it is there."""
    system, target = file_system(spark, path)
    system.delete(target, True)


def serving_projection(df: DataFrame, table: str) -> DataFrame:
    """Those serving columns that exist; patients also get two empty score columns."""
    out = df.select(*[c for c in schemas.SERVING_COLUMNS[table] if c in df.columns])
    if table == "patients":
        out = out.withColumns(
            {
                "ml_risk_score": F.lit(None).cast("double"),
                "ml_prediction": F.lit(None).cast("int"),
            }
        )
    return out


def with_bloom(writer: DataFrameWriter, key: str, distinct: int = 20_000) -> DataFrameWriter:
    """The writer with a Bloom filter on ``key`` in every row group, for ``distinct`` values in one.

    It lets scans for single keys skip row groups also where the rows are not sorted by them.
    """
    return (
        writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct))
    )


def rows_scanned(df: DataFrame) -> int:
    """Rows that the scans of an executed DataFrame handed on, after skipping; call it after an action."""
    def leaves(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return leaves(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return leaves(plan.plan())
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        return [x for child in children for x in leaves(child)] if children else [plan]

    metrics = [x.metrics().get("numOutputRows") for x in leaves(df._jdf.queryExecution().executedPlan())]
    return sum(m.get().value() for m in metrics if m.isDefined())


def write_keyed(df: DataFrame, path: str, keys: list[str], *, files: int | None = None) -> None:
    """Store ``df`` range-partitioned and sorted by ``keys``.

    Row-group statistics then let a scan skip all but the groups of the wanted stay. The row
    number as last range key spreads a stay too large for one file over several, whatever
    its times; ``df`` should be a stored table, whose row numbers stay the same in a re-run.
    """
    cut = [*keys, "_acuity_row"]
    (
        df.withColumn("_acuity_row", F.monotonically_increasing_id())
        .repartitionByRange(*([files, *cut] if files else cut))
        .sortWithinPartitions(*keys)
        .drop("_acuity_row")
        .write.mode("overwrite")
        .parquet(path)
    )


def save_serving(
    df: DataFrame, table: str, root: str | None = None, *, files: int | None = None
) -> None:
    """Overwrite a serving table, under ``root`` or, without it, in the session catalog."""
    out = serving_projection(df, table)
    if root is None:
        out.write.mode("overwrite").saveAsTable(table)
        return
    keys = [c for c in (schemas.STAY, schemas.SERVING_TIME[table]) if c in out.columns]
    write_keyed(out, f"{root.rstrip('/')}/{table}", keys, files=files)


def save_bucketed(
    df: DataFrame, table: str, *, key: str = schemas.STAY, buckets: int = 64,
    path: str | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame | None:
    """Store ``df`` in the session's catalog, dealt into ``buckets`` by ``key`` and sorted in each.

    Aggregates and joins by the key then read tables with equal bucket counts side by side,
    without an exchange. A bucket is one task's work and nothing splits it later, so a table
    where one key has more than ``hot_rows`` rows is not stored and the answer is None:
    exchanges, which adaptive execution can split, serve it better.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > hot_rows)
    if not sizes.isEmpty():
        return None
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def write_ranged(df: DataFrame, path: str, *, key: str = schemas.STAY, width: int = 100_000,
                 only: bool = False) -> None:
    """Store ``df`` in folders of ``width`` consecutive keys each, column ``{key}_range``.

    With ``only`` the folders of other ranges than those in ``df`` stay as they are. Each range is
    written by as many tasks as adaptive execution finds it worth.
    """
    ranged = df.withColumn(f"{key}_range", F.floor(F.col(key) / width).cast("long"))
    (
        ranged.hint("rebalance", f"{key}_range").sortWithinPartitions(f"{key}_range", key)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if only else "static")
        .partitionBy(f"{key}_range").parquet(path)
    )


def ranges_of(df: DataFrame, *, key: str = schemas.STAY, width: int = 100_000) -> list[int]:
    """The key ranges that rows of ``df`` fall into: as many as :func:`write_ranged` has folders at most."""
    part = F.floor(F.col(key) / width).cast("long")
    found = df.filter(F.col(key).isNotNull()).select(part.alias("part")).distinct()
    return sorted(r["part"] for r in found.collect())


def load_serving(spark: SparkSession, table: str, root: str | None = None) -> DataFrame:
    return spark.table(table) if root is None else spark.read.parquet(f"{root.rstrip('/')}/{table}")


_scratch: list[str] = []
_scratch_tables: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share.

    The folder is the session's ``spark.checkpoint.dir`` or, where that is unset, a folder
    in the session's warehouse, which all executors must reach as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/acuity-scratch"
    path = f"{folder.rstrip('/')}/acuity-{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def scratch_table(name: str) -> str:
    """A new table name, dropped from the catalog by :func:`drop_scratch`."""
    _scratch_tables.append(f"acuity_{name}_{uuid.uuid4().hex}")
    return _scratch_tables[-1]


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this process wrote to the shared folder.

    Call it once the results are stored: a DataFrame that reads such a table is of no use
    afterwards.
    """
    while _scratch_tables:
        spark.sql(f"DROP TABLE IF EXISTS {_scratch_tables.pop()}")
    while _scratch:
        remove(spark, _scratch.pop())


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Fixes values that depend on row placement, cuts the lineage, and survives the loss of
    executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
