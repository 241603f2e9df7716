"""Session settings and the shipping of this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))


def local_session(cores: int | str = "*", app: str = "maskwright", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), "maskwright-checkpoints"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Adds the package as a zip to the job, once per session, so that Python workers can import it wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_maskwright_shipped", False):
        return
    path = os.path.join(sc._temp_dir, "maskwright.zip")  # the driver's own folder; Spark serves it to the executors
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(ROOT):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(ROOT)))
    sc.addPyFile(path)
    sc._maskwright_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes an intermediate table that a plan reads several times, and reads it back.

    ``checkpoint()`` keeps its files in the shared folder that the session names in ``spark.checkpoint.dir``; all executors can
    read them, so losing one costs nothing. A session on one machine (``local[...]``, as in tests) may name none and gets a folder of its own; on a
    cluster that raises.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session's checkpoints go to."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or os.path.join(sc._temp_dir, "checkpoints"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path beneath the checkpoint folder, for tables that are written and read again."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}/{name}"
