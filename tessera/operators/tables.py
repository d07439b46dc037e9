"""Tables that an operator writes to the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir).

    Where the setting is absent a local master (tests on one machine) gets a folder below the warehouse; on a cluster
    that is an error, since the driver's own disk is no shared folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch while an operator writes its own tables: texts lie in an executor and its Python workers at once.
BATCH = 8 << 20


@contextlib.contextmanager
def _arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of at most `size` bytes for the jobs inside; the session's setting is as before afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Table:
    """A table of an operator in the shared folder, with a way to drop it once all that reads it is written."""

    def __init__(self, df: DataFrame, rows: int = 0):
        """rows: of a file at most, for rows of many MB, which a writer holds until its file is done (0: any number)."""
        self.path = shared_folder(df.sparkSession)
        with _arrow_batches(df.sparkSession, BATCH):
            df.write.option("maxRecordsPerFile", rows).parquet(self.path)
        self.df = df.sparkSession.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        context = self.df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, rows: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors. rows: see Table."""
    return Table(df, rows).df
