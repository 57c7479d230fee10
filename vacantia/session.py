"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.errors import PySparkAttributeError
from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and timestamps pinned to UTC."""
    builder = SparkSession.builder.appName("vacantia")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_ROOTS: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that they share local folders."""
    master = spark.conf.get("spark.master", "")
    return master.startswith("local") and not master.startswith("local-cluster")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session whose driver and executors are one process may leave it unset; it then
    gets a temporary folder, which is removed when the driver ends. Others raise.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.conf.get("spark.app.id", "local")
    if key not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[key] = tempfile.mkdtemp(prefix="vacantia-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[key], ignore_errors=True)
    return _LOCAL_ROOTS[key]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once a session, for functions that run there.

    Workers do not share the driver's path, not even on one machine, where only the environment
    is passed on. Sessions without a classic context (Connect) send it as an artifact.
    """
    key = spark.conf.get("spark.app.id", "local")
    if key in _SHIPPED:
        return
    folder = os.path.dirname(os.path.abspath(__file__))
    held = tempfile.mkdtemp(prefix="vacantia-")  # the driver serves the archive from here
    atexit.register(shutil.rmtree, held, ignore_errors=True)
    made = shutil.make_archive(os.path.join(held, "vacantia"), "zip", os.path.dirname(folder), os.path.basename(folder))
    try:
        spark.sparkContext.addPyFile(made)
    except PySparkAttributeError:  # a Connect session
        spark.addArtifacts(made, pyfile=True)
    _SHIPPED.add(key)


_SHIPPED: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
