"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings, valid on a session that already exists.
RUNTIME = {
    # every day, hour and minute bucket is a UTC bucket
    "spark.sql.session.timeZone": "UTC",
    # a merged payload key replaces the client's key of the same name
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "tallybrook", master: str | None = None,
                  **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder for stream checkpoints and intermediate tables.

    It lies under the shared folder the cluster names in ``spark.checkpoint.dir``.
    Only where that is unset and the master is local (tests, a laptop) is a temporary
    folder used, which goes when Python ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tallybrook-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return os.path.join(folder, name)
