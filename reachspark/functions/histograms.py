"""Column arithmetic on frequency histograms held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def suffix_sums(h: Column) -> Column:
    """k+ values from exact-frequency values."""
    return F.transform(F.sequence(F.lit(1), F.size(h)), lambda k: F.aggregate(F.slice(h, k, F.size(h)), F.lit(0.0), lambda a, x: a + x))


def differences(kplus: Column) -> Column:
    """Exact-frequency values from k+ values; the last bucket stays."""
    return F.transform(kplus, lambda x, i: x - F.coalesce(F.get(kplus, i + 1), F.lit(0.0)))
