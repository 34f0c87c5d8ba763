"""Sinks: text files, upserts and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated part files, one for each partition."""
    df.write.mode("overwrite").csv(path, sep="\t", quote="", escape="")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both, of equal keys the one with the highest version; columns that one side lacks are null."""
    rows = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in keys and c != version]
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), *rest))
    return rows.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def write_corpus(df: DataFrame, path: str, mode: str = "append") -> None:
    """Corpus rows by source, so that a filter on the source prunes folders."""
    df.write.mode(mode).partitionBy("source_corpus").parquet(path)


def create_table(spark: SparkSession, name: str, schema: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def unprocessed(rows: DataFrame, done: DataFrame, key: str = "row_key") -> DataFrame:
    """Rows whose key is not among those done."""
    return rows.join(done.select(key), key, "left_anti")
