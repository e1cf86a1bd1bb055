"""Reliable staging of intermediate tables and size estimates shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return the table read from there.

    The folder is the session's ``spark.checkpoint.dir``; a temporary one is made
    only where the session names none (unit tests on one machine).
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts, counted (one scan of the text column): file sizes say little of texts that compress well."""
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
