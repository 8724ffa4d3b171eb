"""Session helpers: configuration, table loading and lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "blockloom", master: str = "local[*]", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the given session is used instead."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of an input directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local master may do without: it gets a temporary one.  On a cluster a folder of one machine would lose
    data with that machine, so an unset one is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "blockloom-shared")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cuts_dir(spark: SparkSession) -> str:
    """Where the cuts of this application lie."""
    return f"{shared_dir(spark)}/blockloom-{spark.sparkContext.applicationId}"


def drop_cuts(spark: SparkSession) -> None:
    """Delete the cuts of this application; frames that read them are of no use afterwards."""
    _delete(spark, cuts_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_remembered: set[str] = set()


def _forget_at_exit(spark: SparkSession) -> None:
    """When the driver ends, the application's cuts are deleted, as far as its JVM still answers."""
    path = cuts_dir(spark)
    if path in _remembered:
        return
    _remembered.add(path)

    def forget() -> None:
        try:
            _delete(spark, path)
        except Exception:  # the JVM is gone: the cluster's own cleaning is left
            pass

    atexit.register(forget)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table into the shared folder and read it again.

    The result survives the loss of executors, is columnar and compressed, and is computed once however often it
    is used.  It is deleted by drop_cuts or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{cuts_dir(spark)}/cut-{uuid.uuid4().hex}"
    _forget_at_exit(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
