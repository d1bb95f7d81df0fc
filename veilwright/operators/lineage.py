"""Cutting lineage between the phases of a long plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, or where that is unset one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder, at once, and go on from there.

    The folder is the one the session names in ``spark.checkpoint.dir``, or where that is unset one
    in the warehouse: either is a folder all executors share.  Spark removes the files itself when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as a table of the shared folder, at once, and read it from there.

    Unlike a checkpoint the table keeps its size and its columns apart, so a later join knows how
    large it is and a later pass reads only what it needs.  The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
