"""Working folders that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> tempfile.TemporaryDirectory:
    """One folder for a local session without a setting; it goes when the process ends."""
    return tempfile.TemporaryDirectory(prefix="statloom-", ignore_cleanup_errors=True)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the shared folder named by ``spark.checkpoint.dir``.

    Where that setting is absent, a folder that ends with the process is used if the session itself is local, as in
    tests; on a cluster it is an error, because a machine-local folder would be lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = _own_folder().name
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
