"""Product tables that are changed by buckets: each commit writes the buckets it touches anew, and a manifest names the live ones.

A manifest is a small table of (bucket, path), one version a commit. It is written last, by one task, so whoever reads the
table sees a commit whole or not at all; a job that fails leaves files that no manifest names, and these go with vacuum().
One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import merge_products

#: Buckets of a table: the rows of a manifest, and of paths that a read names.
BUCKETS = 64


def _manifest(spark: SparkSession, root: str) -> tuple[int, dict[int, str]]:
    """The last version (0: none) and the live folder of each bucket; at most BUCKETS rows come to the driver."""
    try:
        all_ = spark.read.schema("bucket int, folder string, v int").parquet(f"{root}/manifest")
    except AnalysisException:
        return 0, {}
    last = all_.agg(F.max("v")).first()[0]
    return (last, {r.bucket: r.folder for r in all_.where(F.col("v") == last).collect() if r.folder}) if last else (0, {})


def _live(spark: SparkSession, root: str, folders: dict[int, str], buckets: list[int] | None = None) -> DataFrame | None:
    paths = [f"{root}/data/{f}/_bucket={b}" for b, f in sorted(folders.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def read_products(spark: SparkSession, root: str) -> DataFrame | None:
    """The live rows, or None if the table was never written or holds nothing."""
    return _live(spark, root, _manifest(spark, root)[1])


def _bucket(keys: list[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _commit(spark: SparkSession, root: str, version: int, folders: dict[int, str], touched: list[int], rows: DataFrame | None) -> int:
    """Write the rows of the touched buckets, then a manifest that names them and all others as they were."""
    folder, filled = uuid.uuid4().hex, []
    if rows is not None:
        rows.write.partitionBy("_bucket").parquet(f"{root}/data/{folder}")
        filled = [r[0] for r in spark.read.parquet(f"{root}/data/{folder}").select("_bucket").distinct().collect()] if rows.columns else []
    live = {b: f for b, f in folders.items() if b not in touched} | {b: folder for b in filled}
    table = spark.createDataFrame([(b, f) for b, f in sorted(live.items())] or [(0, None)], "bucket int, folder string")
    table.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/v={version + 1}")
    return version + 1


def store_products(incoming: DataFrame, root: str, keys: list[str]) -> int:
    """Put rows into a table in place of all rows of the same keys, and give the new version.

    A key's old rows go whole, with the evidence that hangs on them, so nothing of a replaced attribute or version stays behind.
    Only buckets that a key of incoming falls into are read and written. Rows with a null among
    their keys equal no others: they are added, and never replaced or dropped.
    """
    spark = incoming.sparkSession
    version, folders = _manifest(spark, root)
    touched = [r[0] for r in incoming.select(_bucket(keys).alias("b")).distinct().collect()]
    old = _live(spark, root, folders, touched)
    named = incoming if old is None else merge_products(old.select(*incoming.columns), incoming, keys)
    return _commit(spark, root, version, folders, touched, named.withColumn("_bucket", _bucket(keys))) if touched else version


def drop_products(gone: DataFrame, root: str, keys: list[str]) -> int:
    """Take all rows of the keys in gone out of a table, and give the new version; unknown keys change nothing."""
    spark = gone.sparkSession
    version, folders = _manifest(spark, root)
    touched = [b for b in (r[0] for r in gone.select(_bucket(keys).alias("b")).distinct().collect()) if b in folders]
    if not touched:
        return version
    left = _live(spark, root, folders, touched).join(gone.select(*keys).distinct(), keys, "left_anti")
    return _commit(spark, root, version, folders, touched, left.withColumn("_bucket", _bucket(keys)))


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete data that none of the last `keep` versions names, and older manifests; gives the number of folders deleted.
    Not while others read older versions."""
    version, _ = _manifest(spark, root)
    if not version:
        return 0
    all_ = spark.read.schema("bucket int, folder string, v int").parquet(f"{root}/manifest")
    live = {(r.bucket, r.folder) for r in all_.where(F.col("v") > version - keep).select("bucket", "folder").distinct().collect()}
    old = [r[0] for r in all_.where(F.col("v") <= version - keep).select("v").distinct().collect()]
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    data = jvm_path(f"{root}/data")
    fs, n = data.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for folder in fs.listStatus(data):
        buckets = [b for b in fs.listStatus(folder.getPath()) if b.getPath().getName().startswith("_bucket=")]
        dead = [b for b in buckets if (int(b.getPath().getName().split("=")[1]), folder.getPath().getName()) not in live]
        for b in [folder] if len(dead) == len(buckets) else dead:
            n += bool(fs.delete(b.getPath(), True))
    for v in old:
        delete_folder(spark, f"{root}/manifest/v={v}")
    return n
