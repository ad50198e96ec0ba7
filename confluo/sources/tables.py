"""Readers: the driver's Parquet tables, and trees of files."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file below ``root``: slash paths relative to it, text as UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    full = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    relative = F.expr("substring(full, length(base) + 2)")
    return files.withColumns({"full": full, "base": base}).select(relative.alias("path"), F.col("content").cast("string").alias("content"))


def write_tree(files: DataFrame, root: str) -> int:
    """Sink of a planned tree: each (path, content) row as a file below ``root``; the number of files.

    Tasks write their own rows, so a repeated task writes the same bytes again.
    Paths that are absolute, empty or leave the root are an error, and so is one that
    two rows name, since either could be the last.
    """
    twice = files.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR path IS NULL OR path = ''").select("path").first()
    if twice:
        raise ValueError(f"{twice.path!r} is no path of one file")

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path} leaves the tree")
                target = f"{base.rstrip('/')}/{path}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(target) as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written = files.select(F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(run, "n bigint")
    return int(written.agg(F.sum("n")).first()[0] or 0)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as one side of joins that deal both sides by their keys.

    Before a side is computed, Spark guesses its size from the files read, so what
    explodes or is generated may be sent whole through the driver; this rules that out.
    """
    return df.hint("merge")


def dealt_by_size(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into parts whose number grows with the splits read, so that what a task holds does not."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, 4 * df.rdd.getNumPartitions()), *keys)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that the steps of a loop don't plan all steps before.

    The folder is spark.checkpoint.dir; a local session without one uses a temporary folder.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='confluo-')}")
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_removed, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit
        return
