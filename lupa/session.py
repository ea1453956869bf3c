"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Dates are written and read in the proleptic Gregorian calendar, as stored.
SETTINGS = {
    "spark.sql.parquet.datetimeRebaseModeInRead": "CORRECTED",
    "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED",
    "spark.sql.parquet.int96RebaseModeInRead": "CORRECTED",
    "spark.sql.parquet.int96RebaseModeInWrite": "CORRECTED",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JVM does not compile methods beyond 8,000 bytes, as generated for some sixty columns; such stages run operator by operator
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # beyond 100 fields, as of encoded and scored invoices with both parties, joins would not be compiled at all
    "spark.sql.codegen.maxFields": "1000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "lupa", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def staging_dir(spark: SparkSession) -> str:
    """Folder all executors share, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lupa-"))
    return context.getCheckpointDir()


def application_dir(spark: SparkSession) -> str:
    return f"{staging_dir(spark).rstrip('/')}/lupa/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors. Everything an application stages is
    in one folder, ``lupa/<application id>``, which can be removed when it has ended.
    """
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
