"""Session construction for local runs; on a cluster the caller brings its own session."""

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did."""
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (held, ROOT) if x)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows):
    """rows dealt out over all cores where the files give fewer splits; many files are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


#: Rows of one task in operators that hold what they count in memory.
TASK_ROWS = 500_000


def tasks_for(rows, task_rows: int = TASK_ROWS) -> int:
    """How many tasks bound the rows of each: the session's number, more for larger tables, which are counted."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // task_rows))
