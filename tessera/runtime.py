"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessera-")
    path = os.path.join(folder, "tessera_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def scratch(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    One of our own, under the system's temporary folder, only where that is unset and all runs on this machine;
    on a cluster each executor would write to a disk of its own, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """The same rows from a Parquet table in the shared folder: lineage is cut and the plan runs once."""
    path = f"{scratch(df.sparkSession)}/tessera-{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lateral(rows: DataFrame, table_function, arg: str) -> DataFrame:
    """The rows that a Python table function makes of column ``arg`` of each row, with its other columns. Nothing is registered by name."""
    ship(rows.sparkSession)
    return rows.lateralJoin(table_function(F.col(arg).outer())).drop(arg)


#: Rows of a table that is set against all rows of another one.
FEW = 10_000


def few(df: DataFrame, what: str, most: int = FEW) -> DataFrame:
    """The table marked for broadcast, once it is seen to have at most ``most`` rows; ValueError beyond that."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"{what}: more than {most} rows")
    return F.broadcast(df)
