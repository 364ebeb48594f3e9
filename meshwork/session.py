"""A session with the settings that the engine is tuned for (on a cluster, set them there), and the folder that its tasks share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "meshwork", memory: str = "8g") -> SparkSession:
    partitions = cpus if isinstance(cpus, int) else 8
    session = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.  Only a local master, as in tests, gets a temporary one
    where none is set; on a cluster that is an error, as executors would not see a folder of the driver."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="meshwork-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of a loop, written to the shared folder and read again; clear() deletes them.

    Unlike a checkpoint, a table that is read has the size of its files, so estimates don't multiply from round to round (a loop
    of joins over checkpoints has estimates of millions of digits in the end), and small tables are broadcast.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables, self.kept = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0, 1

    def path(self) -> str:
        self.tables += 1
        return f"{self.folder}/{self.tables}"

    def write(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_last(self) -> None:
        """Deletes all tables but the last, and lets Spark drop the shuffle files that nothing refers to any more, which otherwise stay
        until the driver happens to collect its garbage: a loop whose tables are large needs room for a round, not for all of them."""
        for number in range(self.kept, self.tables):
            delete_folder(self.spark, f"{self.folder}/{number}")
        self.kept = self.tables
        self.spark.sparkContext._jvm.System.gc()

    def clear(self) -> None:
        delete_folder(self.spark, self.folder)
