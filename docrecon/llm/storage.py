"""What operators write for themselves: tables in the folder that all executors share, and this package for Python workers."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecon.shipping import shared_folder, ship


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet and returns them as read back: lineage ends here, and a lost executor costs nothing.

    The files stay until the shared folder is cleared, as those of checkpoint() do.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator writes on its way and removes once its result is written itself. Within the block, Arrow
    batches hold batch_rows rows at most, so that a Python worker's memory does not follow the length of texts and sets."""

    BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark: SparkSession, batch_rows: int = 1000):
        self.spark, self.folder, self.batch_rows = spark, new_folder(spark, "scratch"), batch_rows

    def __enter__(self):
        self.before = self.spark.conf.get(self.BATCH)
        self.spark.conf.set(self.BATCH, str(min(self.batch_rows, int(self.before) if int(self.before) > 0 else self.batch_rows)))
        return self

    def __exit__(self, *_):
        self.spark.conf.set(self.BATCH, self.before)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has no more than max_rows rows, else for an ordinary join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow for functions of this package, which goes to the executors' Python workers first."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
