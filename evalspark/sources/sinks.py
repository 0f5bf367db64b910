"""Writing report tables, and reading those of finished runs."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from evalspark.functions.encoding import fingerprint

FORMATS = ("json", "parquet", "csv")
MANIFEST = "manifest"


def write_report(df: DataFrame, path: str, run_id: str, fmt: str = "json") -> None:
    """Write a table under its run id, replacing only what that run wrote before."""
    if fmt not in FORMATS:
        raise ValueError(f"format '{fmt}' is not one of {FORMATS}")
    if fmt == "csv":  # a line has no nested values: they become JSON text
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))]
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    writer = (
        df.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .format(fmt)
    )
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)


def save_bucketed(df: DataFrame, table: str, buckets: int, keys: tuple[str, ...] = ("id", "split")) -> None:
    """Save examples or predictions as a table bucketed by id and split.

    Two tables bucketed alike are joined, and the models' votes compared, without a
    shuffle: worth it for examples that many runs are evaluated against.
    """
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)


def write_reports(tables: dict[str, DataFrame], path: str, run_id: str, fmt: str = "json") -> None:
    """Write all tables of a run, and after them its manifest: of each table its name, format, rows and fingerprint.

    A run that was broken off has no manifest of its own, and ``read_reports`` refuses it.
    """
    for name, df in tables.items():
        write_report(df, f"{path}/{name}", run_id, fmt)
    entries = [
        fingerprint(_read(df.sparkSession, f"{path}/{name}", run_id, fmt, df.schema)).select(F.lit(name).alias("table"), F.lit(fmt).alias("format"), "n_rows", "fingerprint")
        for name, df in tables.items()
    ]
    if entries:
        write_report(reduce(DataFrame.unionAll, entries), f"{path}/{MANIFEST}", run_id, "parquet")


def _as_written(schema: StructType, fmt: str) -> StructType:
    """In CSV nested values are text."""
    if fmt != "csv":
        return schema
    return StructType([StructField(f.name, StringType() if isinstance(f.dataType, (ArrayType, MapType, StructType)) else f.dataType) for f in schema.fields])


def _read(spark: SparkSession, path: str, run_id: str, fmt: str, schema: StructType) -> DataFrame:
    reader = spark.read.format(fmt).schema(StructType([*_as_written(schema, fmt).fields, StructField("run_id", StringType())]))
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.load(path).where(F.col("run_id") == run_id).drop("run_id")


def read_reports(spark: SparkSession, path: str, run_id: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """The tables of a finished run, of the schemas they were written with (nested columns of CSV are JSON text).

    It is an error if the run has no manifest, or a table is not in it, or its rows are not those that were written.
    """
    try:
        manifest = spark.read.parquet(f"{path}/{MANIFEST}").where(F.col("run_id") == run_id).collect()  # a row per table
    except AnalysisException:
        manifest = []
    known = {r["table"]: r for r in manifest}
    missing = sorted(set(schemas) - set(known))
    if missing:
        raise ValueError(f"run '{run_id}' is not finished or has no table(s) {missing}")
    found = {name: _read(spark, f"{path}/{name}", run_id, known[name]["format"], schema) for name, schema in schemas.items()}
    for name, df in found.items():
        now = fingerprint(df).head()
        if (now["n_rows"], now["fingerprint"]) != (known[name]["n_rows"], known[name]["fingerprint"]):
            raise ValueError(f"table '{name}' of run '{run_id}' is not what was written: {now['n_rows']} rows, {known[name]['n_rows']} expected")
    return found
