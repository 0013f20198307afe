"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="marlstone-py-")) / "marlstone_src.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(Path(here.name) / p.relative_to(here)))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


#: Bytes up to which :func:`spread` moves a table.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than there are cores, over as many tasks as cores.

    Other tables have files and row groups enough and are read where they lie.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SPREAD_BYTES and len(df.inputFiles()) < cores else df


def work_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; one of our own only where that is
    unset and the driver is the only machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/marlstone-{sc.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written in :func:`work_dir` and read back; as it is where no such folder is set."""
    try:
        path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    except RuntimeError:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
