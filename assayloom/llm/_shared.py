"""What the operators share: tables, written intermediate results, and Arrow batches of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from assayloom import attach

#: Rows of an Arrow batch turned into Python objects at once.
SLICE = 64
ROWS, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 256
ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}


def small_batches(spark: SparkSession) -> SparkSession:
    """Texts go to Python in batches of BATCH rows unless the session says otherwise: memory beside the heap is small."""
    if spark.conf.get(ROWS) == "10000":
        spark.conf.set(ROWS, str(BATCH))
    return attach(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own if driver and executors are one process; else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_assayloom_folder", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = spark._assayloom_folder = tempfile.mkdtemp(prefix="spark-assayloom-")
    return at


def written(df: DataFrame, what: str, partitions: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    The files outlive lost executors, and both sides of a later join start from a scan, so adaptive
    execution may split skewed keys on either.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(docs: DataFrame, id_col: str | list[str], text_col: str, row: Callable[[str | None], tuple], fields: str) -> DataFrame:
    """``id_col`` (one column or several) and the columns ``fields`` (a DDL string) that ``row(text)`` gives, for every row; no shuffle.

    ``row`` sees the whole text, or None. Other columns of ``docs`` are pruned from the scan.
    """
    small_batches(docs.sparkSession)
    ids = [id_col] if isinstance(id_col, str) else id_col
    src = docs.select(*ids, text_col)
    kind = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in ids)
    names, kinds = zip(*((n, ARROW[k]) for n, k in (f.split() for f in fields.split(","))), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows = [row(t) for t in batch.column(len(ids)).to_pylist()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], *cols], [*ids, *names])

    return src.mapInArrow(run, f"{kind}, {fields}")
