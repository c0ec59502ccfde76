"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Needed for exact-name semantics when two headers differ in case only, and for
# stable timestamps; the rest are Spark defaults worth being explicit about.
SETTINGS = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "gridloom", **extra: str) -> SparkSession:
    """A session with the settings above. Master, memory and checkpoint folder come from the deployment."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` as the cluster names it.

    Where the setting is absent a temporary folder serves local sessions only; on
    a cluster a machine-local folder would lose data, so that is an error.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = os.environ.get("GRIDLOOM_LOCAL_SCRATCH")
    if not folder:
        folder = tempfile.mkdtemp(prefix="gridloom-")
        os.environ["GRIDLOOM_LOCAL_SCRATCH"] = folder
    return folder


def new_dataset_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
