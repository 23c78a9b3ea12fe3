"""Where intermediate tables go: the shared folder that the session's spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A local folder of its own only for a local session without one; a cluster needs a folder that all share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


#: Rows of an Arrow batch where texts go to Python workers. A worker holds a batch several times over, and Spark's default of 10,000 texts is some hundred MB.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ``BATCH_ROWS``, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Of rows of a MB each: Parquet looks at the size of a page and of a row group after 100 rows only, and buffers, compresses and reads them whole.
LARGE_ROWS = {"parquet.page.row.count.limit": "1", "parquet.block.row.count.limit": "8"}


def settled(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut the lineage: written once to the shared folder and read back, so that a lost executor loses nothing. ``options`` are the Parquet writer's."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, column: str, most: int | None = None, **options: str) -> DataFrame:
    """Written once in buckets by ``column``, sorted by it: joins and sums on it move the other side only, as often as they are made. There are ``most`` buckets at most; ``options`` are the Parquet writer's."""
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = n if most is None else max(1, min(n, most))
    df.repartition(n, column).write.bucketBy(n, column).sortBy(column).options(**options).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name, format="parquet")
    return spark.table(name)
