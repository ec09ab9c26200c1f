"""What a cluster shares: the folder for written tables, and this package for the executors' Python workers."""

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per session's context; further calls do nothing."""
    context = spark.sparkContext
    if any(name.startswith("docrecon-") for name in context._python_includes):
        return
    package = Path(__file__).resolve().parent
    made = Path(os.path.realpath(tempfile.mkdtemp(prefix="docrecon-"))) / f"docrecon-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(made, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(made))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session names it; a folder of our own only on a local master, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")
