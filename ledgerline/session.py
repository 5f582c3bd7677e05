"""Session settings the library relies on, and where it may write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Needed for right results whatever session the caller hands in.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}

# Runtime re-planning: coalesce small shuffles, split skewed joins and rebalances.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session that somebody else built."""
    for key, value in {**SEMANTIC_CONF, **PLAN_CONF}.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    app: str = "ledgerline", cores: int = 8, memory: str = "12g", folder: str = "/tmp/ledgerline"
) -> SparkSession:
    """A session for tests and the local benchmark; clusters bring their own.

    ``folder`` takes work tables where the session does not say ``spark.checkpoint.dir``.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**SEMANTIC_CONF, **PLAN_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", folder)
    return spark


def work_root(spark: SparkSession) -> str:
    """The folder of this application's work tables, in the shared folder of the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base.rstrip('/')}/ledgerline-{spark.sparkContext.applicationId}"


def drop_work(spark: SparkSession) -> None:
    """Remove this application's work tables; results that read them are gone as well."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def source_version(spark: SparkSession, folder: str) -> str:
    """Changes whenever a file under the folder does: paths, lengths and times of its files.

    A table may be a folder of files, which has no length and on some stores no time.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    files = []
    while listed.hasNext():
        f = listed.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return str(sorted(files))


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables a job writes on the way.

    It lies under ``spark.checkpoint.dir``, the shared folder every executor sees; without
    that setting there is no place that outlives a machine, so it is refused.
    """
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table once and go on from the copy.

    Used where a job reads an expensive intermediate several times: every read then costs
    a pruned Parquet scan, and a lost executor does not recompute the lineage before it.
    """
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
