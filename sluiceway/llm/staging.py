"""Tables written to the shared folder, to cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sluiceway.session import new_scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame written once below ``spark.checkpoint.dir`` and read back."""
    spark = df.sparkSession
    path = new_scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
