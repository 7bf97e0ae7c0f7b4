"""The shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_OWN_ROOT: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset a folder of our own: a temporary one if there is one machine, else in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _OWN_ROOT:
            master = spark.sparkContext.master
            if master.startswith("local") and "cluster" not in master:
                own = tempfile.mkdtemp(prefix="quill-scratch-")
                atexit.register(shutil.rmtree, own, ignore_errors=True)
                _OWN_ROOT[app] = "file://" + own
            else:
                _OWN_ROOT[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        root = _OWN_ROOT[app]
    return root.rstrip("/")
