"""Names for columns that operators add for themselves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def free(*dfs: DataFrame, count: int = 1, other: Iterable[str] = ()) -> list[str]:
    """Column names that none of the frames has, and that are none of the others."""
    taken = {c.lower() for df in dfs for c in df.columns} | {c.lower() for c in other}
    out, i = [], 0
    while len(out) < count:
        if f"__{i}" not in taken:
            out.append(f"__{i}")
        i += 1
    return out
