"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "casemill", **conf: str) -> SparkSession:
    """A local session with the settings the test-suite and the benchmark use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local runs without one, a temporary folder."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), "casemill-shared")
    os.makedirs(made, exist_ok=True)
    return "file://" + made


def own_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; ``clean`` removes it, at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/casemill-{spark.sparkContext.applicationId}"
    if path not in _MADE:
        _MADE.add(path)
        atexit.register(clean, spark)
    return path


def clean(spark: SparkSession) -> None:
    """Remove the tables that ``written`` made in this application. Results that still read them can't be computed again."""
    for path in list(_MADE):
        _MADE.discard(path)
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        else:
            try:
                there = spark._jvm.org.apache.hadoop.fs.Path(path)
                there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
            except Exception:  # noqa: BLE001, S110 - the application is already gone
                pass


_MADE: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of every executor (once per application)."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_casemill_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="casemill-")  # of the driver, which serves the file to the executors
        atexit.register(shutil.rmtree, folder, True)
        target = Path(folder) / "casemill.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"casemill/{p.relative_to(root)}")
        sc.addPyFile(str(target))
        sc._casemill_shipped = sc.applicationId
    return spark
