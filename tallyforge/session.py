"""Session factory and helpers that read cluster settings from the session."""

from __future__ import annotations

import atexit
import tempfile
from pathlib import PurePosixPath
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings every session of this engine relies on (cluster masters and sizes come from spark-submit).
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",
}


def get_spark(app: str = "tallyforge", master: str | None = None, **conf: str) -> SparkSession:
    """Active session, or a new one with REQUIRED plus ``conf``; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (REQUIRED | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the files.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset (tests, a local
    run) a folder of this machine is set. Reliable checkpoints survive the loss of executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallyforge-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """As ``materialize``, but as a compressed table in that folder, of which later steps read only the columns they need. Removed when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    except Exception:  # the session has ended before; the folder is the cluster's to clean
        pass


def is_uri(path) -> bool:
    """A path of another file system than the driver's own (``scheme://...``); such are left to Spark."""
    return "://" in str(path)


def suffix_of(path) -> str:
    return PurePosixPath(str(path).rstrip("/")).suffix.lower()


def broadcast_within(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint only when a known row count is within ``limit``; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
