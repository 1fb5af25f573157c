"""Sums of long arrays over a table: tasks send stretches of partial sums, Spark adds each stretch up, and the driver gets one
sum, whatever the number of rows or tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Doubles that travel as one row.
STRETCH = 8192

PARTS = "slot int, stretch int, data binary"
COLUMNS = ["slot", "stretch", "data"]


def cut(slot: int, values: np.ndarray) -> list[tuple[int, int, bytes]]:
    """An array of doubles as rows of PARTS."""
    values = np.ascontiguousarray(values, np.float64).reshape(-1)
    return [(slot, i // STRETCH, values[i : i + STRETCH].tobytes()) for i in range(0, len(values), STRETCH)]


def added(parts: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """The sum of each slot and stretch."""

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["data"].iloc[0]) // 8)
        for d in pdf["data"]:
            total += np.frombuffer(d)
        return pd.DataFrame({"slot": [key[0]], "stretch": [key[1]], "data": [total.tobytes()]})

    found = parts.groupBy("slot", "stretch").applyInPandas(add, PARTS).collect()
    return {(r["slot"], r["stretch"]): np.frombuffer(r["data"]) for r in found}


def whole(found: dict[tuple[int, int], np.ndarray], slot: int, width: int) -> np.ndarray:
    """The sum of a slot; zeros where no task sent any."""
    parts = [found[slot, s] for s in range(-(-width // STRETCH)) if (slot, s) in found]
    return np.concatenate(parts) if parts else np.zeros(width)
