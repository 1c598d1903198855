"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application.
_LOCAL_FOLDERS: dict[str, str] = {}

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the rows must then be shuffled once more.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Episodes grow some twentyfold when they are split into weeks, so keep small partitions apart.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the SQL options that the transformations rely on; all can change at run time."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("recurra")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # The setting can't be changed in a running session, so the folder is remembered beside it.
        application = spark.sparkContext.applicationId
        folder = _LOCAL_FOLDERS.get(application)
        if folder is None:
            folder = _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="recurra-")
    return folder


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    The written table cuts the lineage and outlives lost executors; later steps
    scan it with column pruning and, if partitioned, with partition pruning.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recurra/{name}-{uuid.uuid4().hex}"
    write_table(df, path, partition_by)
    return spark.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def fingerprint(spark: SparkSession, folder: str) -> int:
    """A number that changes with the names, sizes and times of the files in a folder and its subfolders."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    seen = []
    while files.hasNext():
        file = files.next()
        seen.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return hash(tuple(sorted(seen)))
