"""Steps that build on each other: their results are kept in the shared checkpoint folder, so plans stay short and a lost executor costs little."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """`df`, computed once. The folder is the one that spark.checkpoint.dir names; only on one machine it may be one of our own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="seqloom-rounds-"))
    return df.checkpoint(eager=True)


def met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle and sort. Sizes of exploded and kept tables are guessed too low; a broadcast of one would go through the driver whole."""
    return left.join(right.hint("merge"), on, how)
