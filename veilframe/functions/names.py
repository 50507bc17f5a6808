"""Columns by name, whatever characters it has, and names that clash with none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """The column of that very name."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_names(cols: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores until it clashes with none of cols (names compare without case)."""
    taken = {c.lower() for c in cols}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
