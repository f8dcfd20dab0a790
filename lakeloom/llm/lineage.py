"""Cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(frame: DataFrame) -> str:
    """spark.checkpoint.dir; a temporary folder only on a local master where it is unset, as in tests. Unset on a cluster is an error."""
    context = frame.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: executors would write where nobody else reads")
        folder = tempfile.mkdtemp(prefix="lakeloom-")
    return folder


def written(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, and no lost executor can undo it."""
    path = f"{shared_folder(frame)}/lakeloom-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def fresh_names(frame: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of frame has."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out
