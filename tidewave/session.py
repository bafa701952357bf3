"""Session set-up, table access, checkpoints and the one-row-per-key helper that every operator shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException


def build_session(app: str = "tidewave", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the engine expects: UTC, Arrow and adaptive execution with skew handling."""
    b = SparkSession.builder.appName(app).master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share, which `spark.checkpoint.dir` names.

    Where that is unset a temporary folder is made, for as long as this process lasts, if the session runs on this machine
    alone (tests, a laptop); on a cluster it is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidewave-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that the engine made, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the checkpoint folder, its lineage cut: for wide rows, which compress well and are read by column."""
    folder = new_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a side of two or three narrow columns up to which it may be broadcast (about 64 MB).
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast only when its counted `rows` stay within `limit`."""
    return F.broadcast(df) if rows <= limit else df


def one_row_per_key(df: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One physical row for each non-null `key`; rows of null key all stay.

    Wide columns are never shuffled: only (key, hash of the file's path, row number) is grouped, which names the surplus rows, and those are
    taken out by an anti join, broadcast while their counted number is within `broadcast_rows`. One of the rows
    is kept, the same in every run. Without file positions (data not read from files) rows are grouped whole.
    """
    try:
        placed = df.withColumns({"__file": F.xxhash64(F.col("_metadata.file_path")), "__row": F.col("_metadata.row_index")})
        placed.schema  # analysis
    except AnalysisException:
        nulls, rest = df.where(F.col(key).isNull()), df.where(F.col(key).isNotNull())
        return rest.dropDuplicates([key]).unionByName(nulls)
    at = F.struct("__file", "__row")
    again = placed.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"), F.min(at).alias("__at")).where("__n > 1").select(F.col(key).alias("__key"), "__at")
    again = checkpointed(again)
    again = broadcast_if_small(again, again.count(), broadcast_rows)
    surplus = (F.col(key) == F.col("__key")) & (at != F.col("__at"))
    return placed.join(again, surplus, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many tasks as there are cores, where a scan of a small table would give fewer.

    For work that is heavy for each row, over plans without a shuffle. Larger tables have more splits than cores and are not
    shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
