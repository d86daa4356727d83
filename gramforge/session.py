"""Session helpers: where shared intermediate tables go, and how tables are read."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
#: folders of this process's applications
_owned: set[str] = set()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster names in ``spark.checkpoint.dir``; it is removed when the application ends.

    Only a local session (tests) that names none gets a folder of its own: on a cluster, executors don't share one.
    """
    base = spark.conf.get(_CHECKPOINT_KEY, None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="gramforge-")
            spark.sparkContext.setCheckpointDir(base)
    own = f"{base.rstrip('/')}/gramforge-{spark.sparkContext.applicationId}"
    if own not in _owned:
        _owned.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable for Python workers, once in an application.

    Nothing is sent where they find it already: it is on PYTHONPATH, or local workers run in its folder.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent
    root = str(package.parent)
    on_path = root in (os.path.abspath(x) for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x)
    if on_path or (os.getcwd() == root and spark.sparkContext.master.startswith("local[")):
        return
    archive = Path(tempfile.mkdtemp(prefix="gramforge-")) / f"{package.name}.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
