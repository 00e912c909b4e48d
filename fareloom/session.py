"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators are written for. They are ordinary SQL options, so a cluster
# may override any of them; none is needed for right results except the time zone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # longer generated methods are never compiled by the JVM; above this Spark splits them
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "fareloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with ``SETTINGS``; keyword arguments are extra options (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; a cluster
    session is refused, because a machine-local folder is lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    # the setting can't be changed in a running session, so the folder is kept here
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="fareloom-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; it does not exist yet."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """``df`` written once to the scratch folder and read back, which cuts its lineage.

    Later uses and retries read the files; nothing depends on one executor's memory.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that come out of a generator, so that the planner keeps their expressions in one place.

    Otherwise what reads a column may hold its whole expression, once for each use, and a
    lambda or a JSON parser above it evaluates it without generated code.
    """
    for name, value in columns.items():
        df = df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
    return df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Workers import the modules of the functions they run; where the package is not
    installed on every machine, it comes with the application like any ``--py-files`` zip.
    """
    context = getattr(spark, "_sc", None)
    if context is None or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="fareloom-")), "fareloom-package.zip")
    with zipfile.ZipFile(path, "w") as bundle:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    bundle.write(whole, os.path.relpath(whole, os.path.dirname(package)))
    context.addPyFile(path)
