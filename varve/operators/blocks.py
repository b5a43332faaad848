"""Blocks inside a run: cuts by estimated size, restarts, filter segments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SIZE = 16 << 10


def block_cuts(entries: DataFrame, limit: int = BLOCK_SIZE) -> DataFrame:
    """entries (file_no, place, bytes) with block: a block closes once its entries reach `limit` bytes.

    What a block holds depends on where the one before closed, which no window expresses: a fold over each file, whose
    size the output split bounds.
    """

    def cut(file: pd.DataFrame) -> pd.DataFrame:
        file = file.sort_values("place")
        blocks, block, held = [], 0, 0
        for n in file["bytes"].tolist():
            blocks.append(block)
            held += n
            if held >= limit:
                block, held = block + 1, 0
        return file.assign(block=blocks)

    return entries.select("file_no", "place", "bytes").groupBy("file_no").applyInPandas(cut, "file_no long, place long, bytes long, block long")


def block_index(cut: DataFrame) -> DataFrame:
    """The sparse index of cut entries: each block's entries, bytes and last place."""
    return cut.groupBy("file_no", "block").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("place").alias("last_place"))
