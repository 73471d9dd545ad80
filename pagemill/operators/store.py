"""Tasks and segments as tables: hash-diff upserts, history pages, fingerprints, orphans."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _place(spark, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/pagemill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder of spark.checkpoint.dir (where that is unset, below the warehouse) and read again, so
    that long plans end and lost executors cost nothing. The files stay until that folder is cleared."""
    path = _place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Stored tables of an operator's steps; one that is stored anew under its name takes the older one's place, whose files
    go once the new ones are written."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = _place(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def diff(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """(keys, action): insert, update (a compared column differs), delete or unchanged; one full outer join."""
    h = F.xxhash64(*[F.to_json(F.struct(*[F.col(c) for c in compared]))])
    old_, new_ = old.select(*keys, h.alias("old__")), new.select(*keys, h.alias("new__"))
    action = F.when(F.col("old__").isNull(), "insert").when(F.col("new__").isNull(), "delete").when(F.col("old__") != F.col("new__"), "update").otherwise("unchanged")
    return old_.join(new_, keys, "full_outer").select(*keys, action.alias("action"))


def apply_diff(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the upsert: the new state replaces the old one, in the stored table's columns."""
    return new.select(stored.columns)


def history_page(tasks: DataFrame, order: list, page: int, size: int = 5) -> DataFrame:
    """One page of rows in a total order; the page number is clamped to what there is."""
    count = max(1, -(-tasks.count() // size))
    return tasks.orderBy(*order).offset((min(max(1, page), count) - 1) * size).limit(size)


def fingerprint(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """(group, fingerprint): a hash over the rows' hashes in order; of each row only 32 bytes travel."""
    row = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), row.alias("h")))), lambda x: x["h"])
    return rows.groupBy(group).agg(F.sha2(F.array_join(parts, ","), 256).alias("fingerprint"))


def orphans(files: DataFrame, referenced: DataFrame, name: str) -> DataFrame:
    """Files that no task refers to, and the bytes that they hold."""
    return files.join(referenced.select(name).distinct(), name, "left_anti")


def remove_tasks(tasks: DataFrame, segments: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the tasks that go."""
    return tasks.join(gone, key, "left_anti"), segments.join(gone, key, "left_anti")


def save(spark, path: str, new: DataFrame, keys: list[str], partition: str) -> DataFrame:
    """Write a table's new state for the partitions that `new` holds and return what changed; other partitions stay.

    Partitions are replaced as a whole by Spark's commit, so that a failed write leaves the old state.
    """
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as e:  # no table yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = spark.createDataFrame([], new.schema)
    compared = [c for c in new.columns if c not in keys]
    touched = old.join(new.select(partition).distinct(), partition, "left_semi")
    summary = spark.createDataFrame(diff(touched, new, keys, compared).groupBy("action").count().collect(), "action string, count bigint")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return summary


def load(spark, path: str, schema, partition: str, key, order: str) -> DataFrame:
    """One partition of a saved table in order."""
    return spark.read.schema(schema).parquet(path).where(F.col(partition) == key).orderBy(order)


def manifest(tasks: DataFrame, without: list[str]) -> DataFrame:
    """One JSON document for each task, without the long lists."""
    return tasks.select("task_id", F.to_json(F.struct(*[F.col(c) for c in tasks.columns if c not in without])).alias("manifest"))


def read_manifests(spark, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """(valid tasks, broken documents) of JSON files, one document a file."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    cached = rows.withColumn("file", F.input_file_name())
    return cached.where("_corrupt_record is null").drop("_corrupt_record"), cached.where("_corrupt_record is not null").select("file", "_corrupt_record")


def unchanged(files: DataFrame, known: DataFrame) -> DataFrame:
    """(file, state): same by size and time, same by hash, or changed; the hash is compared only where size or time differ."""
    joined = files.alias("f").join(known.alias("k"), "file")
    quick = (F.col("f.size") == F.col("k.size")) & (F.col("f.mtime") == F.col("k.mtime"))
    return joined.select("file", F.when(quick, "same").when(F.col("f.hash") == F.col("k.hash"), "same_content").otherwise("changed").alias("state"))
