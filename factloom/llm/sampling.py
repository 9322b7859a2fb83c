"""Bounded, reproducible training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNIT = float(1 << 53)


def unit_hash(*columns: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(_UNIT)


def bounded_sample(df: DataFrame, stratum: str, key: str, per_stratum: int, bound: int) -> DataFrame:
    """About ``per_stratum`` rows of every stratum, never more than ``bound`` in all.

    With many strata each has about its part of ``bound`` instead.  All rows are
    counted; the rate of a stratum follows from its count, and a row is in the
    sample when the hash of its key falls below that rate.  If that is more than
    ``bound`` rows, those stay whose hash is the smallest part of their rate.  So the sample does not
    depend on the order or the partitions of the input.
    """
    counts = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    if not counts:
        return df.limit(0)
    wanted = min(per_stratum, bound / len(counts.keys() - {None} or counts))
    rate = F.lit(0.0)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        if value is not None:
            rate = F.when(F.col(stratum) == F.lit(value), F.lit(min(1.0, wanted / n))).otherwise(rate)
    return df.where(unit_hash(key) < rate).orderBy(unit_hash(key) / rate, F.xxhash64(*df.columns)).limit(bound)
