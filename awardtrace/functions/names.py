"""Columns by their exact names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A column by its exact name, also where that has dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_quoted(names: list[str]) -> list[Column]:
    return [quoted(n) for n in names]
