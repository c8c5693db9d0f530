"""Session factory and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "spindrift", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass the cluster's own session instead."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names in spark.checkpoint.dir; only on one machine (a local master, as in
    tests) may a temporary folder stand in for it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spindrift-ckpt-"))


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own for written results, below the checkpoint folder. Writers of single files need it to be on
    the driver's file system."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/{uuid.uuid4()}"
    os.makedirs(path, exist_ok=True)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and return it read back: later jobs neither recompute
    the plan nor depend on any single executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
