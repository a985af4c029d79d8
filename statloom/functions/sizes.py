"""Human-readable byte counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names in ascending order, each 1024 times the one before.
UNITS = ("bytes", "kB", "MB", "GB", "TB")


def size_pretty(size: Column) -> Column:
    """Bytes as text with the largest unit that still shows at least 10 of it.

    A unit is left for the next one from 10 240 of it; what is shown is rounded half up. Negative sizes keep
    their sign. NULL stays NULL.
    """
    magnitude = F.abs(size.cast("bigint"))

    def shown(power: int) -> Column:
        if power == 0:
            return magnitude
        half_units = F.shiftright(magnitude, 10 * power - 1)
        return F.shiftright(half_units + 1, 1)

    text = F.when(magnitude < 10 * 1024, F.concat(magnitude.cast("string"), F.lit(" " + UNITS[0])))
    for power in range(1, len(UNITS)):
        label = F.concat(shown(power).cast("string"), F.lit(" " + UNITS[power]))
        if power < len(UNITS) - 1:
            text = text.when(shown(power) < 10 * 1024, label)
        else:
            text = text.when(size.isNotNull(), label)
    return F.concat(F.when(size < 0, F.lit("-")).otherwise(F.lit("")), text)
