"""Folders that driver and executors share, and the package on the executors."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset a session of one machine
    (master local) gets a temporary folder; on a cluster, whose machines do not share such a
    folder, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/pulsegrid/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application."""
    sc = spark.sparkContext
    if not getattr(sc, "_pulsegrid_shipped", False):
        root = Path(__file__).resolve().parents[2]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/pulsegrid_{uuid.uuid4().hex[:8]}", "zip", root, "pulsegrid"))
        sc._pulsegrid_shipped = True
