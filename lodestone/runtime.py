"""Session, code shipping and the shared scratch folder.

Intermediate tables are written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir``.  Such a table cuts lineage the way ``checkpoint()`` does, survives the loss
of any executor, and gives the planner true sizes, so whether a join side is broadcast is decided by
Spark from the bytes on disk and ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(name: str = "lodestone", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` decides.  Only on a local master, where one machine is the cluster, an own
    folder below the system's temporary folder stands in when the setting is absent.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.gettempdir()}/checkpoints/lodestone"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone_pkg.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._lodestone_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables of one operator call, below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Write ``df`` and return it as read back."""
        path, schema = self.path(name), df.schema
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
