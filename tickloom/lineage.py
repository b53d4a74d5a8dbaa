"""Tables written in the folder that driver and executors share, to cut lineage and to know sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        atexit.register(shutil.rmtree, base[len("file://"):], True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_base(spark)}/tickloom-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder, as a URI where the shared folder is given as one."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has written in the shared folder. Results that weren't consumed yet are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends here, sizes are known, lost executors take nothing along."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors' Python, once an application: workers may not find it otherwise."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="tickloom-modules-")
    atexit.register(shutil.rmtree, folder, True)
    top = Path(__file__).resolve().parent
    with zipfile.ZipFile(f"{folder}/tickloom_modules.zip", "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(f"{folder}/tickloom_modules.zip")
    _shipped.add(application)
