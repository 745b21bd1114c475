"""Session helpers: a tuned builder and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", app: str = "dialoggraph",
                  shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session (tests, bench) may fall back to a temporary folder; on a
    cluster a machine-local folder would not survive the loss of its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="dialoggraph-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def spread_small(df: DataFrame, max_bytes: int = 1 << 30) -> DataFrame:
    """Spread a small input over all cores before heavy per-row work.

    A small table is often one file with one row group, which one task would read and
    then process alone.  Anything above ``max_bytes`` is read by many tasks anyway and is
    returned as it is, so no large table is ever shuffled for this.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= max_bytes else df


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written table.

    Used between the rounds of iterative operators, where the plan would otherwise
    grow with every round, and for tables that several branches of a plan read.  A lost
    executor costs a re-read, not a re-run, and the file sizes tell the optimizer which
    side of a later join is small.  ``codec`` is for tables of words, which zstd makes smaller.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return stored_table(spark, path, df.schema)


# Files are at most so many times smaller than the rows they hold.
PACKED = 64


def stored_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A written table, joined by merging if its rows would be too many to broadcast.

    Spark takes the size of the files for the size of the table.  Files of ids and class names are
    many times smaller than their rows, so a table just below the limit would reach the driver as
    hundreds of megabytes.
    """
    df = spark.read.schema(schema).parquet(path)
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if limit <= 0 or size * PACKED <= limit:
        return df
    if size <= limit and df.count() * (df._jdf.schema().defaultSize() + 32) <= limit:
        return df
    return df.hint("merge")
