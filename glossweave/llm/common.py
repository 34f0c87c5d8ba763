"""What the training-data operators share: folds, scratch tables and table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_memories: dict[str, dict] = {}


def remember(owner: str, table: dict) -> dict:
    """``table`` as what an operator remembers in a worker process from batch to batch."""
    _memories[owner] = table
    return table


def claim(owner: str) -> None:
    """Called as a task of ``owner`` begins: a worker that serves several operators keeps one memory at a time."""
    for other, table in _memories.items():
        if other != owner:
            table.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(column: str, folds: int) -> Column:
    """crc32 of an identifier's decimal text, modulo ``folds``; a null identifier is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="glossweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder, compressed by the session's codec or ``codec``, and read again: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` under the column names ``names``, with a column ``_row`` that tells its rows apart, the same each time tasks run.

    A Parquet table's rows have a file and a place in it; any other DataFrame is numbered and written first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if "_metadata" not in docs.columns and plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and plan.relation().fileFormat().toString() == "Parquet":
        place = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
        return docs.select("*", place).toDF(*names, "_row")
    return written(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id().cast("string")), "rows")


def digest_filter(digests: DataFrame, bits: int, probes: int) -> np.ndarray:
    """Bit filter over the column ``digest``: each seven bytes of a digest set one of ``bits`` (a power of two) bits.

    At most ``bits`` / 64 rows reach the driver; a filter beyond its capacity only lets more rows pass.
    """
    at = [F.conv(F.hex(F.substring("digest", 1 + 7 * k, 7)), 16, 10).cast("long").bitwiseAND(bits - 1) for k in range(probes)]
    spots = digests.select(F.explode(F.array(*at)).alias("at"))
    words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toPandas()
    out = np.zeros(bits // 64, dtype="<i8")
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


def passes(flags: bytes, digest: bytes, probes: int) -> bool:
    """Whether digest_filter() may have seen ``digest``."""
    last = len(flags) * 8 - 1
    for k in range(probes):
        at = int.from_bytes(digest[7 * k : 7 * k + 7], "big") & last
        if not flags[at >> 3] >> (at & 7) & 1:
            return False
    return True
