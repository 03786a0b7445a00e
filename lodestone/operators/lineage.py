"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the session's ``spark.checkpoint.dir`` and read back, so that lost executors cost no replay.

    Only a local session without that setting gets a temporary folder; on a cluster it is an error, as executors could not share one."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint()


#: Most keys that are sent to every executor; more are joined by a shuffle of both sides.
FEW_KEYS = 200_000


def narrowed(rows: DataFrame, keys: DataFrame, on: list[str], most: int = FEW_KEYS) -> DataFrame:
    """The rows whose ``on`` columns are among ``keys``.  The keys are written and counted first; where they are few, wide rows (texts) stay where they are."""
    kept = checkpointed(keys.select(*on).distinct())
    return rows.join(F.broadcast(kept) if kept.count() <= most else kept, on, "left_semi")
