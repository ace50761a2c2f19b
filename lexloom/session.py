"""Session defaults and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)


@atexit.register
def clear_written() -> None:
    """Delete the tables that cut() wrote and nobody discarded; called when Python ends."""
    while _WRITTEN:
        try:
            _delete(*_WRITTEN.pop())
        except Exception:  # noqa: BLE001 - the session is gone; the folder's owner cleans up
            return


def discard(*tables: DataFrame) -> None:
    """Delete tables of cut() that no later step reads: what was built on them must have been written by cut() itself."""
    for df in tables:
        path = getattr(df, "_lexloom_path", None)
        if path:
            _WRITTEN.remove((df.sparkSession, path))
            _delete(df.sparkSession, path)


def build_session(app: str = "lexloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine assumes: AQE with skew handling, UTC, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each application."""
    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="lexloom-code-"))
    atexit.register(shutil.rmtree, out, True)
    with zipfile.ZipFile(out / "lexloom.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(out / "lexloom.zip"))
    _SHIPPED.add(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    key = spark.sparkContext.applicationId
    if key not in _OWN_DIR:
        _OWN_DIR[key] = tempfile.mkdtemp(prefix="lexloom-")
        atexit.register(shutil.rmtree, _OWN_DIR[key], True)
    return "file://" + _OWN_DIR[key]


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    The result survives the loss of executors, is read column by column, and is
    computed once however many branches use it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._lexloom_path = path
    return table
