"""What the operators of this subpackage share: tables, stored intermediate results, names."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Copies of one row are written out again in blocks of so many, to keep arrays short.
COPY_BLOCK = 65_536
#: Applications whose workers have this library.
_shipped: set[str] = set()
#: A table of at most so many rows, counted beforehand, may be broadcast.
SMALL_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give this library to the Python workers, once per application: the driver's file server sends it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, name = os.path.split(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="library-"), name)
    context.addPyFile(shutil.make_archive(archive, "zip", root, name))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or where unset one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there.

    Cuts the lineage as a checkpoint does, but keeps columns and statistics, so later passes read
    only what they need and a lost executor costs one task.  The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_with_session(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def gone_with_session(spark: SparkSession, path: str) -> None:
    """Remove the folder when the session ends."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if its counted ``rows`` are few; else the join shuffles."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def fresh(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores before it until no column has it, whatever the case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def before(value: Column, window) -> Column:
    """Sum of ``value`` over the rows before the current one."""
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def spread_copies(df: DataFrame, copies: Column, name: str) -> DataFrame:
    """Each row ``copies`` times, numbered 1, 2, ... in the column ``name``; arrays stay short."""
    one, block, total = F.lit(1).cast("bigint"), fresh("block", df.columns), fresh("total", df.columns)
    blocks = df.withColumn(total, copies.cast("bigint")).withColumn(
        block, F.explode(F.sequence(one, F.ceil(F.col(total) / COPY_BLOCK)))
    )
    first = (F.col(block) - 1) * COPY_BLOCK
    here = F.sequence(first + 1, F.least(F.col(total), first + COPY_BLOCK))
    return blocks.withColumn(name, F.explode(here)).drop(block, total)
