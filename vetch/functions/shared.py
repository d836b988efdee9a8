"""Cutting lineage: what is worked out in rounds is written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the folder in spark.checkpoint.dir and reads it from there from now on.

    Where that is unset, a local master gets a temporary folder; a cluster is refused, as its executors share no disk.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vetch-"))
    return df.checkpoint()
