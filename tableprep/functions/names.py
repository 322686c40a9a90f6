"""Column references by exact name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """The column of that exact name, dots, blanks and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")
