"""Session factory and the few helpers that touch shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BATCH = 1000
ROOT = Path(__file__).resolve().parent.parent

TEXTS = ("documents", "pages")

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive planning and Arrow transfer; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Local workers get the folder on their path. Elsewhere the sources travel as
    one zip through Spark's own file server, once per application, so executors
    need no folder in common with the driver.
    """
    sc = spark.sparkContext
    # Rows here are whole texts or sets: the default of 10,000 a batch would be too much memory at once.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    if is_local(spark):
        paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if str(ROOT) not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, paths)])
        return
    if getattr(sc, "_quillspark_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="quillspark-")).resolve() / "quillspark_src.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in (ROOT / "quillspark").rglob("*.py"):
            archive.write(path, path.relative_to(ROOT).as_posix())
    sc.addPyFile(str(target))
    sc._quillspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session has none (tests, notebooks) one is made on this
    machine; on a cluster a folder of one machine would lose data, so it raises.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(sc, "_quillspark_dir", None)
        if not folder:
            folder = sc._quillspark_dir = "file://" + tempfile.mkdtemp(prefix="quillspark-ckpt-")
            sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage.

    The table survives lost executors. It lives under the application's id and
    may be removed when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixture tables, as Spark reads it (any file system); a folder's schema is read once per session.

    Texts in fewer files than there are cores are dealt out to all of them, since
    a file of one row group is read by one task.
    """
    known = spark.__dict__.setdefault("_quillspark_tables", {})
    if (sf_dir, name) not in known:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        cores = spark.sparkContext.defaultParallelism
        known[sf_dir, name] = rows.repartition(cores) if name in TEXTS and len(rows.inputFiles()) < min(cores, 4) else rows
    return known[sf_dir, name]
