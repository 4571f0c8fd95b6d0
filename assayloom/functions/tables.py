"""Tables that are written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir that this session writes to.

    Where the setting is missing, a local master gets a folder of its own; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-assayloom-"))
    return sc.getCheckpointDir()


def once(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, so that what reads it several times doesn't compute it again."""
    shared_folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: what ``once`` does, for large tables. Equal values of a column take little room and only columns that are asked for are read."""
    path = f"{shared_folder(df).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Parts of a study that ``with_study`` joins apart.
PARTS = 64


def with_study(features: DataFrame, small: DataFrame) -> DataFrame:
    """``features`` joined with ``small``, a row a study, by parts of each study, so that what follows isn't a task a study."""
    part = F.pmod(F.xxhash64("feature_id"), F.lit(PARTS)).cast("int")
    each = small.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return features.withColumn("__part", part).join(each, ["study_id", "__part"]).drop("__part")
