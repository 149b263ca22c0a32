"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import atexit
import gc
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by all executors.

    It is the folder named by ``spark.checkpoint.dir``. Only where that is unset and the
    master is local (tests, benches on one machine) a temporary folder stands in.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="weftline-")
        root = f"{shared.rstrip('/')}/weftline-{uuid.uuid4().hex[:12]}"
        _ROOTS[app] = root
        atexit.register(_remove, spark, root)
    return _ROOTS[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the shared folder's own retention applies
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Give back what ended queries took of the driver's heap.

    The plans of many short queries are garbage as soon as these end, but until a full collection the JVM rather
    takes more memory from the machine than it gives any back.
    """
    gc.collect()  # Python's references to ended plans
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, by way of the shared folder: they need not
    have it installed nor run where the driver does."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here, buffer = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    if not os.path.isdir(here):  # the package itself comes from an archive that is already with the workers
        return
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(here)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    try:
        target = f"{work_root(spark)}/{os.path.basename(here)}.zip"
    except ValueError:  # no shared folder is named: the workers must have the package themselves
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
