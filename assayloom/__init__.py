"""Spark-native operators for feature-by-sample studies, the evidence around them, and their catalogue."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver was started from another folder.

    On a cluster the package is expected on every node's PYTHONPATH (or shipped with ``--py-files``);
    this only adds the driver's own checkout to the search path.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark
