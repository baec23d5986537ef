"""Tables of cases that are replaced as a whole or not at all.

A write makes a folder of rows of its own and a manifest, a table that says for each case which version of its rows counts. At the end
one small file under the next number points to the manifest; it appears by a rename, which a file system does or doesn't. Readers follow the
newest pointer. A job that dies earlier leaves rows that no manifest names. Of two writers at one time the second finds its number taken and
builds its manifest again on the other's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS, MANIFESTS, ROWS = "_pointers", "_manifests", "rows"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a maker of paths."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _pointers(spark: SparkSession, path: str) -> list[int]:
    system, at = _files(spark, path)
    folder = at(f"{path}/{POINTERS}")
    if not system.exists(folder):
        return []
    return sorted(int(x.getPath().getName()) for x in system.listStatus(folder) if x.getPath().getName().isdigit())


def _pointed(spark: SparkSession, path: str, number: int) -> str:
    return spark.read.text(f"{path}/{POINTERS}/{number}").first()[0]


def _point(spark: SparkSession, path: str, number: int, manifest: str) -> bool:
    """Makes the pointer of that number; False if another writer has it."""
    system, at = _files(spark, path)
    new = at(f"{path}/{POINTERS}/.{uuid.uuid4().hex}")
    out = system.create(new)
    out.write(manifest.encode())
    out.close()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(new, at(f"{path}/{POINTERS}/{number}"), rename)
    except Exception as error:
        if "FileAlreadyExistsException" not in str(error):
            raise
        system.delete(new, False)
        return False
    return True


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """case_id and version of what counts now; None before the first write."""
    numbers = _pointers(spark, path)
    return spark.read.parquet(f"{path}/{MANIFESTS}/{_pointed(spark, path, numbers[-1])}") if numbers else None


def replace_cases(df: DataFrame, path: str, *, cases: DataFrame | None = None, verify: Callable[[], None] | None = None) -> None:
    """Replaces the cases of df, and those in `cases` (case_id) even if df has no row of them; no others.

    `verify` is called when all rows are written and before they count; if it raises, the table stays as it was.
    """
    spark, version = df.sparkSession, f"v{uuid.uuid4().hex}"
    # the folder's name is a copy, so that case_id keeps its type
    df.withColumn("_case", F.col("case_id")).write.partitionBy("_case").parquet(f"{path}/{ROWS}/_version={version}")
    if verify:
        verify()
    written = spark.read.schema(df.select("case_id").schema).parquet(f"{path}/{ROWS}/_version={version}").select("case_id").distinct()
    touched = written if cases is None else written.union(cases.select("case_id")).distinct()
    while True:
        numbers = _pointers(spark, path)
        new = written.withColumn("version", F.lit(version))
        if numbers:
            now = spark.read.parquet(f"{path}/{MANIFESTS}/{_pointed(spark, path, numbers[-1])}")
            new = now.join(touched, "case_id", "left_anti").unionByName(new)
        name = uuid.uuid4().hex
        new.write.parquet(f"{path}/{MANIFESTS}/{name}")
        if _point(spark, path, numbers[-1] + 1 if numbers else 1, name):
            return


def read_cases(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows that count; before the first write an empty table of the schema, or an error without one."""
    held = manifest(spark, path)
    if held is None:
        if schema is None:
            raise ValueError(f"nothing has been written to {path}")
        return spark.createDataFrame([], schema)
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/{ROWS}")
    return rows.join(held.withColumnRenamed("version", "_version"), ["case_id", "_version"], "left_semi").drop("_version", "_case")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes rows and manifests that the newest `keep` pointers don't lead to. Not while another job writes."""
    system, at = _files(spark, path)
    numbers = _pointers(spark, path)
    names = [_pointed(spark, path, n) for n in numbers[-keep:]]
    versions = {r[0] for name in names for r in spark.read.parquet(f"{path}/{MANIFESTS}/{name}").select("version").distinct().collect()}
    for n in numbers[:-keep]:
        system.delete(at(f"{path}/{POINTERS}/{n}"), False)
    for folder, wanted in ((MANIFESTS, set(names)), (ROWS, {f"_version={v}" for v in versions})):
        for x in system.listStatus(at(f"{path}/{folder}")) if names else ():
            if x.getPath().getName() not in wanted:
                system.delete(x.getPath(), True)
