"""Session helpers: shared scratch tables, shipping the package, session building for tests."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and its master is this machine (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/twinlake"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see, as named by spark.checkpoint.dir."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{LOCAL_CHECKPOINTS}"
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; `drop` frees those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df once as Parquet and return a frame that reads it back: its lineage starts at the files."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


#: Bytes of one Arrow batch on its way to a Python worker, unless the session says otherwise. Spark's own default lets a
#: task hold many times as much, in memory that an executor's allocator keeps for good.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers that do not share the driver's folders; bound Arrow batches."""
    sc = spark.sparkContext
    if ARROW_BYTES[0] not in dict(sc.getConf().getAll()):
        spark.conf.set(ARROW_BYTES[0], str(ARROW_BYTES[1]))
    if getattr(sc, "_twinlake_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), "twinlake_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"twinlake/{f.relative_to(here)}")
    sc.addPyFile(path)
    sc._twinlake_shipped = True


def local_session(cores: int | str = "*", name: str = "twinlake", **conf: str) -> SparkSession:
    """A single-machine session with the settings the library is designed around."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{LOCAL_CHECKPOINTS}")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
