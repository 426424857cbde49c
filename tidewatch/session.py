"""Session settings the plans rely on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# The JIT compiles methods of up to 8000 bytes and interprets longer ones, some ten times slower. A filter on
# a score over many features can get longer. With this limit Spark runs such a stage operator by operator,
# whose generated methods are split and share common subexpressions.
JIT_METHOD_LIMIT = 8000

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_METHOD_LIMIT)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; in local mode one of its own if none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Compute a table once and cut its lineage: written to the shared folder and read back.

    As Parquet, so that later passes read only the columns they need and lost executors cost nothing. The write's shuffle
    files go with its end instead of whenever the driver's next garbage collection finds them unused.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """A lazy result may read the table as long as the session lives; it goes when the driver ends."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        except Exception:  # the JVM may be gone; the folder is then left to whoever clears it
            pass

    atexit.register(remove)
