"""Session set-up and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; extra keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("_", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only on a local master."""
    own = "plumbline.checkpoint.dir"
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(own, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # remembered on the session, so that every later call names the same folder
    spark.conf.set(own, tempfile.mkdtemp(prefix="plumbline-"))
    return spark.conf.get(own)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later steps neither recompute it nor see it change.

    Unlike an RDD checkpoint the table is columnar and has a known size, from which Spark decides whether a join
    may broadcast it.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """Like :func:`cut`, but dealt by ``column`` into as many buckets as a shuffle has partitions: later joins on it move the
    other side only, however large that is.
    """
    spark, name = df.sparkSession, f"plumbline_{uuid.uuid4().hex}"
    parts = partitions(spark)
    # dealt as the buckets are, so that a task writes one file
    writer = df.repartition(parts, column).write.bucketBy(parts, column).option("path", f"{checkpoint_dir(spark)}/tables/{name}")
    writer.saveAsTable(name, format="parquet")
    table = spark.table(name)
    # the entry is needed to learn the buckets, not to read them; the files stay
    spark.sql(f"DROP TABLE {name}")
    return table
