"""Reading the input tables, and tables of our own in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarn.session import prepare, shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_written: list[str] = []


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage like checkpoint(), but keeps columns, so later reads take only what they need, and a lost
    executor costs no recomputation.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, for files of other forms; drop_scratch() deletes it too."""
    path = f"{shared_dir(spark)}/tarn-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Deletes the scratch tables written so far; results that have not been read yet need them. Returns how many."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
