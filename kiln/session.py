"""SparkSession construction and shared-storage locations.

Everything written by the library (staged files, rewritten tables, stream
checkpoints) lives under the folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent (local tests)
do we fall back to a fresh folder of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(master: str | None = None, app: str = "kiln", **conf: str) -> SparkSession:
    """Return (or build) a session with UTC time, ANSI mode and AQE on.

    Shuffle width is left to the cluster's configuration (AQE coalesces
    small partitions and splits skewed ones at run time); only a local
    master gets one shuffle partition per core.
    """
    builder = SparkSession.builder.appName(app)
    settings = dict(_DEFAULTS)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            cores = master[master.find("[") + 1:-1] if "[" in master else "1"
            settings["spark.sql.shuffle.partitions"] = str(os.cpu_count() if cores == "*" else cores)
    for k, v in {**settings, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    functions run there import it wherever the driver was started."""
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect ships artifacts through the client
        return
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="kiln-ship-"), "kiln.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Read ``spark.checkpoint.dir``.

    A private temporary folder is set only on a local master; on a cluster
    its executors could not see the driver's folder, so the setting is required.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        try:
            local = spark.sparkContext.master.split("[")[0] == "local"
        except Exception:  # noqa: BLE001 - Spark Connect: the server's storage is not ours
            local = False
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        current = tempfile.mkdtemp(prefix="kiln-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext (Spark Connect)
        pass
    return current


def staging_dir(spark: SparkSession, name: str = "stage") -> str:
    """A new, unique folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "kiln", f"{name}-{uuid.uuid4().hex[:12]}")
    local = local_path(path)
    if local is not None:
        os.makedirs(local, exist_ok=True)
    return path


def local_path(path: str) -> str | None:
    """The POSIX path of a local location (plain or file: URI), else None."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    return None if "://" in path else path


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a location, by the cluster's own file-system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return bool(fs.exists(p))
