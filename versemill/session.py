"""Session helpers: table access, code shipping and shared scratch tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, bool] = {}
_scope: ContextVar[list[str] | None] = ContextVar("scratch", default=None)  # tables to delete at the end of the innermost `scratch` of this thread


def local_session(cpus: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the session comes from outside."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("versemill")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if _shipped.get(app):
        return
    path = Path(tempfile.mkdtemp(prefix="versemill-")) / "versemill_code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE)}")
    spark.sparkContext.addPyFile(str(path))
    _shipped[app] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; `sf_dir` may be any path that Spark's readers open."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Only a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="versemill-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    Within `scratch` the table goes at its end unless it is kept; else it stays until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    own = _scope.get()
    if own is not None and not keep:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """A scope at whose end the tables that `materialize` wrote in it are deleted: results must be written or collected before."""
    tables: list[str] = []
    before = _scope.set(tables)
    try:
        yield
    finally:
        _scope.reset(before)
        for path in tables:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bench_cpus() -> str:
    return os.environ.get("BENCH_CPUS", "8")
