"""Session settings and the one way lineage is cut (reliable checkpoints)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin UTC (all times in this package are UTC) and make checkpoints possible."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    shared_root(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own; on
    a cluster a machine-local folder would not survive a lost executor, so the
    setting is required there.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if root is None and current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="tidebarge-")
    if current is None:
        sc.setCheckpointDir(root)
    return root or current


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: partition contents are fixed from here on, even if executors die."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str, *also: str) -> str:
    """A work column's name that neither ``df`` nor ``also`` uses, in any case."""
    taken = {c.lower() for c in (*df.columns, *also)}
    while f"__{name}" in taken:
        name += "_"
    return f"__{name}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
