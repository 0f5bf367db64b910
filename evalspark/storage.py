"""Where intermediate tables are written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or one in the warehouse; both are shared by all executors.

    On a cluster a warehouse on the machine's own disk is not: that is an error, as executors could not read each
    other's tables.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and warehouse.split(":")[0] in ("file", warehouse):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder: the warehouse {warehouse} is local to a machine")
        folder = f"{warehouse}/_evalspark"
    return folder.rstrip("/")


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session's application; results that still read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/evalspark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/evalspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts the lineage in a way that survives lost executors, and gives Spark the true
    size of the result for the joins that follow.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
