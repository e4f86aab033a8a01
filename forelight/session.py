"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "spark.forelight.shipped"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python
    workers can import it wherever they run. It travels through Spark's own file
    server; no folder has to be shared."""
    if spark.conf.get(_SHIPPED, "") == spark.sparkContext.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # The archive stays: in local mode workers read it in place, on a cluster Spark serves it.
    path = os.path.join(tempfile.mkdtemp(prefix="forelight"), "forelight_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("forelight", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a single machine may do without it."""
    have = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not have and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return have or os.path.join(tempfile.gettempdir(), "forelight-checkpoints")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Let checkpoints go to the shared folder, unless they have one already."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
