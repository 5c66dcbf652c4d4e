"""Counting tables of a fixed size, summed over all rows in compressed pieces. Their size is a parameter, so what is
broadcast has a bound that doesn't depend on the data."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PIECE = 1 << 18


def pieces(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(number, compressed uint16 counts) of the pieces that aren't empty."""
    for k in range(0, len(counts), PIECE):
        part = counts[k : k + PIECE]
        if part.any():
            yield k // PIECE, zlib.compress(np.minimum(part.astype(np.int64), 65535).astype("<u2").tobytes(), 1)


def gather(rows: DataFrame, size: int) -> np.ndarray:
    """The sums of rows(piece int, blob binary) as one byte each: 0, and 1 + 11 * log2 of a count, rounded down."""

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(min(PIECE, size), np.int64)
        for rows in batches:
            for b in rows.blob:
                part = np.frombuffer(zlib.decompress(b), "<u2")
                total[: len(part)] += part
        level = np.where(total > 0, np.minimum(255, 1 + 11 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
        yield pd.DataFrame({"piece": [key[0]], "blob": [zlib.compress(level.tobytes(), 1)]})

    out = np.zeros(size, np.uint8)
    # size / PIECE rows of at most PIECE bytes, whatever the data
    for r in rows.select("piece", "blob").groupBy("piece").applyInPandas(add, "piece int, blob binary").collect():
        part = np.frombuffer(zlib.decompress(r["blob"]), np.uint8)
        out[r["piece"] * PIECE : r["piece"] * PIECE + len(part)] = part
    return out
