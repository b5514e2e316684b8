"""Tables that iterative operators write to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Without one, a temporary folder on a single machine (tests), an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mapweave-"))
        found = sc.getCheckpointDir()
    return found


class Tables:
    """Tables of one run. A reread table, unlike a checkpoint, knows its true size: estimates of a checkpoint are those of the
    plan that made it, and over the rounds of a loop of joins they grow without end."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark).rstrip('/')}/mapweave-{uuid.uuid4().hex}"
        self.made: dict[str, list[str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table, reread. Of tables of one name, the last two stay."""
        paths = self.made.setdefault(name, [])
        paths.append(f"{self.folder}/{name}-{uuid.uuid4().hex}")
        df.write.parquet(paths[-1])
        if len(paths) > 2:
            self._delete(paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(paths[-1])

    def forget(self, *names: str) -> None:
        """Deletes the last table of each name: a try that did not work."""
        for name in names:
            self._delete(self.made[name].pop())

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def keep_only(self, *names: str) -> None:
        """Deletes all tables but the last of these names."""
        for name, paths in self.made.items():
            for path in paths[:-1] if name in names else paths:
                self._delete(path)
