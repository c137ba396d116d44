"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName("gaugeframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.conf.get("spark.master", "local").startswith("local")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder would be invisible to the other executors, so one is set, once a
    session, only where the setting is missing and the whole session is one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = f"{tempfile.gettempdir()}/checkpoints-{uuid.uuid4().hex[:8]}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/gaugeframe/{name}-{uuid.uuid4().hex[:12]}"


def check_warehouse(spark: SparkSession) -> None:
    """Saved tables must lie where every executor can reach them."""
    place = spark.conf.get("spark.sql.warehouse.dir", "")
    if not _is_local(spark) and (not place or place.startswith(("file:", "/"))) and not (spark.conf.get("spark.checkpoint.dir", "") or "").startswith(("file:", "/")):
        raise ValueError("spark.sql.warehouse.dir is a local folder: set it to one that every executor can reach")
