"""Makes this package importable by the Python workers of a cluster that does not have it, and names the folder they share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    _DONE.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    folder = tempfile.mkdtemp(prefix="rillwork-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "rillwork_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for where, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    own = os.path.join(where, name)
                    out.write(own, os.path.relpath(own, root))
    spark.sparkContext.addPyFile(path)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the one that the cluster shares; without that name, on one machine only, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='rillwork-')}"
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
