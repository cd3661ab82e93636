"""Tables between the steps of one operator, in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scholia.session import ensure_checkpoint_dir


class Scratch:
    """Writes tables as Parquet, which cuts lineage as a checkpoint does in a fraction of the room, and deletes them when asked."""

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self._spark = spark
        self._folder = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._paths[name] = f"{self._folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self._paths[name])
        return self._spark.read.schema(df.schema).parquet(self._paths[name])

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing still to be computed reads."""
        for name in names:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
