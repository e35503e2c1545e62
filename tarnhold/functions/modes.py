"""Permission bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_mode(mode: Column, kind: Column, preserve: bool = False, umask: int = 0o022) -> Column:
    """The mode an entry gets: no special bits, at most 0755 (0644 without execute bits) unless preserved, under the umask."""
    given = F.coalesce(mode, F.when(kind == "directory", 0o755).otherwise(0o644))
    low = given.bitwiseAND(F.lit(0o777))
    if not preserve:
        top = F.when((kind == "directory") | (given.bitwiseAND(F.lit(0o111)) != 0), 0o755).otherwise(0o644)
        low = low.bitwiseAND(top)
    return low.bitwiseAND(F.lit(~umask & 0o777)).cast("int")


def octal(mode: Column) -> Column:
    return F.concat(F.lit("0o"), F.conv(mode.cast("string"), 10, 8))
