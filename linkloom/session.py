"""Sessions and the shared folder in which iterative operators cut their lineage.

Intermediate tables are written as parquet below ``spark.checkpoint.dir``: they are columnar and compressed, every
executor can read them again after a loss, and a superseded round is deleted as soon as nothing refers to it.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_shipped: set[str] = set()


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("linkloom")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Hand the package to the executors' Python workers, once an application; they may lack the driver's import path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="linkloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(os.path.join(folder, "linkloom.zip"), "w") as packed:
        for base, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(os.path.join(folder, "linkloom.zip"))
    _shipped.add(sc.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        # Without this every test run would leave its tables behind.
        atexit.register(shutil.rmtree, _local_root[len("file://") :], ignore_errors=True)
    return _local_root


class Scratch:
    """Tables written during one operator call.

    ``save`` writes a DataFrame and returns it as read back, ``drop`` deletes a table that no later plan reads. Tables
    that the returned result still reads stay in the shared folder; its owner cleans that folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/linkloom-{label}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, tuple[str, DataFrame]] = {}
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n:04d}"
        df.write.option("compression", "zstd").parquet(path)
        # With the schema given no job has to infer it, and an empty table needs no file.
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = (path, back)
        return back

    def together(self, *tables: DataFrame) -> DataFrame:
        """Saved tables of one schema as a single scan, so that plans don't grow with the number of tables."""
        return self.spark.read.schema(tables[0].schema).parquet(*[self._paths[id(t)][0] for t in tables])

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path, _ = self._paths.pop(id(table), (None, None))
            if path:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
